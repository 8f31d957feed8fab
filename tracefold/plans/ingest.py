"""Registered queries of flattening, sinks and the stream source, each with its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import app_id
from ..operators import rollup as ru
from ..sources import fixtures as fx
from ..sources import nested, otlp, rollup_job, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _query(name: str, sql: str, *ctes: str):
    def add(build):
        QUERIES[name] = build
        SQL[name] = f"WITH {', '.join(ctes)} {sql}"
        return build

    return add


@_query(
    "s01_flatten_traces",
    "SELECT trace_id, span_id, parent_span_id, name, kind, status_code, start_us, start_us + dur_us AS end_us, dur_us, service, app_id || '-x' AS app_id, msg_size::VARCHAR AS msg_size, kind AS abc, 'new' AS host, 'lib.spans' AS scope_name FROM spans",
    fx.SPANS_SQL,
)
def flat_traces(spark: SparkSession, d: str) -> DataFrame:
    x = otlp.flatten_traces(nested.traces(fx.spans_by_order(spark, d), "ok"))
    a = F.col("attributes")
    return x.select("trace_id", "span_id", "parent_span_id", "name", "kind", "status_code", "start_us", "end_us", "dur_us", "service", "app_id", a["messaging.message_body_size"].alias("msg_size"), a["a.b_c"].alias("abc"), F.col("resource")["host"].alias("host"), "scope_name")


_BUCKETS = "array_to_string(bucket_counts, ',')"


@_query(
    "s02_flatten_metrics",
    f"""SELECT ts_us, 'app.value' AS name, 'gauge' AS type, value, event_type, shard, service, app_id || '-x' AS app_id, '' AS unit, NULL AS temporality, NULL AS counts, NULL::INT AS n_bounds, NULL::BIGINT AS count FROM gauges
 UNION ALL SELECT ts_us, 'app.load', 'gauge', -value, event_type, shard, service, app_id || '-x', '', NULL, NULL, NULL, NULL FROM gauges
 UNION ALL SELECT ts_us, 'app.events', 'counter', value, event_type, shard, 'svc-' || shard, app || '-x', '1', 'cumulative', NULL, NULL, NULL FROM co
 UNION ALL SELECT ts_us, 'app.value.hist', 'histogram', value, event_type, NULL, 'unknown', 'app-h-x', 'ms', 'delta', {_BUCKETS}, 6, cnt FROM hist
 UNION ALL SELECT ts_us, 'app.value.summary', 'summary', value, event_type, NULL, 'unknown', 'app-h-x', 'ms', NULL, NULL, NULL, cnt FROM hist""",
    fx.GAUGES_SQL,
    fx.COUNTERS_SQL,
    "co AS (SELECT *, 'app-' || (shard::INT % 5) AS app FROM counters)",
    fx.HISTOGRAMS_SQL,
)
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    gauges = fx.gauges(spark, d)
    load = gauges.withColumn("name", F.lit("app.load")).withColumn("value", -F.col("value"))
    hist = fx.histograms(spark, d).withColumn("unit", F.lit("ms")).withColumn("service", F.lit("")).withColumn("app_id", F.lit("app-h"))
    summary = hist.withColumn("name", F.lit("app.value.summary")).drop("bucket_counts", "explicit_bounds")
    rows = nested.metrics(gauges, "gauge").unionByName(nested.metrics(load, "sum", temporality="delta")).unionByName(nested.metrics(fx.counters(spark, d), "sum", True, "cumulative"))
    rows = rows.unionByName(nested.metrics(hist, "histogram", temporality="delta")).unionByName(nested.metrics(summary, "summary"))
    counts = F.array_join(F.transform("bucket_counts", lambda n: n.cast("string")), ",")
    label = F.col("labels")
    return otlp.flatten_metrics(rows).select(
        "ts_us", "name", "type", "value", label["event_type"].alias("event_type"), label["shard"].alias("shard"), "service", "app_id", "unit", "temporality",
        counts.alias("counts"), F.when(F.col("explicit_bounds").isNotNull(), F.size("explicit_bounds")).alias("n_bounds"), "count",
    )


@_query(
    "s03_flatten_logs",
    "SELECT ts_us, severity, body, CASE severity WHEN 'INFO' THEN '' ELSE trace_id END AS trace_id, CASE severity WHEN 'INFO' THEN '' ELSE 'o' || log_id END AS span_id, CASE severity WHEN 'ERROR' THEN 17 WHEN 'WARN' THEN 13 ELSE 9 END AS severity_number, service, app_id || '-x' AS app_id, event_type, user_id::VARCHAR AS user_id FROM logs",
    fx.LOGS_SQL,
)
def flat_logs(spark: SparkSession, d: str) -> DataFrame:
    x = otlp.flatten_logs(nested.logs(fx.logs(spark, d)))
    return x.select("ts_us", "severity", "body", "trace_id", "span_id", "severity_number", "service", "app_id", F.col("attributes")["event_type"].alias("event_type"), F.col("attributes")["user_id"].alias("user_id"))


@_query("s05_app_ids", "SELECT CASE kind WHEN 'Client' THEN app_id || '--y' ELSE app_id || '--x-' END AS app, count(*) AS n FROM spans GROUP BY 1", fx.SPANS_SQL)
def app_ids(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("kind") == "Client", "").otherwise(F.concat("app_id", F.lit(' /"<x>#')))
    both = F.create_map(F.lit("app_id"), named, F.lit("app.id"), F.concat("app_id", F.lit("|*y")))
    return fx.spans(spark, d).groupBy(app_id(both).alias("app")).agg(F.count(F.lit(1)).alias("n"))


@_query("s06_partitioned_sink", "SELECT app_id, make_timestamp(ts_us)::DATE::VARCHAR AS day, count(*) AS n, round(sum(value), 3) AS value FROM gauges GROUP BY 1, 2", fx.GAUGES_SQL)
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    out = _folder(spark, "signal")
    sinks.write_signal(fx.gauges(spark, d).select("app_id", "ts_us", "value"), out, "ts_us")
    return spark.read.parquet(out).groupBy("app_id", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    rows = [("trace", fx.spans(spark, d), "start_us"), ("metric", fx.gauges(spark, d), "ts_us"), ("log", fx.logs(spark, d), "ts_us")]
    parts = [x.select(F.lit(signal).alias("signal"), "app_id", F.col(at).alias("ts_us")) for signal, x, at in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SIGNALS = "sg AS (SELECT 'trace' AS signal, app_id, start_us AS ts_us FROM spans UNION ALL SELECT 'metric', app_id, ts_us FROM gauges UNION ALL SELECT 'log', app_id, ts_us FROM logs)"


@_query("s07_routed_sink", "SELECT signal AS folder, signal, app_id, count(*) AS n, max(ts_us) AS last FROM sg GROUP BY 1, 2, 3", fx.SPANS_SQL, fx.GAUGES_SQL, fx.LOGS_SQL, _SIGNALS)
def routed_sink(spark: SparkSession, d: str) -> DataFrame:
    source, out = _folder(spark, "signals"), _folder(spark, "routed")
    rows = _signals(spark, d)
    rows.write.parquet(source)
    writers = {s: partial(_append, path=f"{out}/{s}") for s in ("trace", "metric", "log")}
    sinks.route_signals(sinks.read_stream(spark, source, rows.schema), writers, f"{out}/progress").awaitTermination()
    read = [spark.read.schema(rows.schema).parquet(f"{out}/{s}").withColumn("folder", F.lit(s)) for s in writers]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("folder", "signal", "app_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last"))


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


@_query("s08_stream_source", "SELECT signal, app_id, count(*) AS n, min(ts_us) AS first FROM sg GROUP BY 1, 2", fx.SPANS_SQL, fx.GAUGES_SQL, fx.LOGS_SQL, _SIGNALS)
def stream_source(spark: SparkSession, d: str) -> DataFrame:
    source, out = _folder(spark, "source"), _folder(spark, "streamed")
    rows = _signals(spark, d)
    rows.write.parquet(source)
    stream = sinks.read_stream(spark, source, rows.schema, files_per_trigger=4)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").groupBy("signal", "app_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first"))


@_query("s09_rollup_sink", f"SELECT '5m' AS tier, app_id, ts_us // {fx.HOUR} * {fx.HOUR} AS ts_us, count(*) AS n, max(value) AS value FROM gauges GROUP BY 2, 3", fx.GAUGES_SQL)
def rollup_sink(spark: SparkSession, d: str) -> DataFrame:
    """The second run writes its hours again, so that each of them is there once."""
    out = _folder(spark, "rollup")
    hour = (F.floor(F.col("ts_us") / fx.HOUR) * fx.HOUR).alias("ts_us")
    rolled = fx.gauges(spark, d).groupBy("app_id", hour).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value")).withColumn("tier", F.lit("5m"))
    sinks.write_rollup(rolled, out)
    sinks.write_rollup(rolled.where(F.col("app_id") != "app-0"), out)
    return spark.read.parquet(out).select("tier", "app_id", "ts_us", "n", "value")


_BOUNDS = f"bounds AS (SELECT min(ts_us) // {6 * fx.HOUR} * {6 * fx.HOUR} AS lo FROM gauges)"


@_query("s10_mixed_range", f"SELECT event_type, lo + (ts_us - lo) // {6 * fx.HOUR} * {6 * fx.HOUR} AS t, round(avg(value), 9) AS avg, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, count(*)::DOUBLE AS count FROM gauges, bounds GROUP BY 1, 2", fx.GAUGES_SQL, _BOUNDS)
def mixed_range(spark: SparkSession, d: str) -> DataFrame:
    """All steps of the table, with the split an hour into the step in its middle: the rows are those of raw samples."""
    raw, step = fx.gauges(spark, d), 6 * fx.HOUR
    lo, hi = raw.agg(F.min("ts_us"), F.max("ts_us")).first()
    lo = (lo or 0) // step * step
    split = ru.split_point(lo + ((hi or 0) - lo) // 2 // step * step + fx.HOUR + ru.READY + ru.TICK)
    x = ru.mixed_range(raw, ru.rollup_gauge(raw, labels=True), lo, (hi or 0) + 1, step, split, "avg", "sum", "min", "max", "count", by=("event_type",))
    return x.select("event_type", "t", F.round("avg", 9).alias("avg"), F.round("sum", 6).alias("sum"), "min", "max", "count")


@_query("r04_rollup_job", f"SELECT app_id, ts_us // {fx.HOUR} * {fx.HOUR} AS hour, count(DISTINCT (event_type, shard, ts_us // 300000000)) AS n_rows, count(*) AS n, min(value) AS min, max(value) AS max FROM gauges WHERE ts_us // {fx.HOUR} * {fx.HOUR} + {3 * fx.HOUR} <= (SELECT max(ts_us) FROM gauges) GROUP BY 1, 2", fx.GAUGES_SQL)
def incremental_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The tier after a run half-way through the table and one at its end, which adds the hours since."""
    out = _folder(spark, "job")
    points = fx.gauges(spark, d)
    none = {"temporality": "string", "count": "long", "bucket_counts": "array<long>", "explicit_bounds": "array<double>"}
    sinks.write_signal(points.select("app_id", "ts_us", "name", "type", "value", "labels", *(F.lit(None).cast(t).alias(c) for c, t in none.items())), f"{out}/points", "ts_us")
    lo, hi = points.agg(F.min("ts_us"), F.max("ts_us")).first()
    for now in ((lo + hi) // 2, hi) if hi is not None else ():
        rollup_job.run(spark, f"{out}/points", f"{out}/tier", f"{out}/done", now)
    if hi is None:
        return spark.createDataFrame([], "app_id string, hour long, n_rows long, n long, min double, max double")
    tier = spark.read.parquet(f"{out}/tier")
    return tier.groupBy(F.col("app_id").cast("string").alias("app_id"), (F.floor(F.col("ts_us") / fx.HOUR) * fx.HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))
