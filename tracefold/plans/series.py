"""Registered queries of series operators over whole tables: sets, offsets, cumulative and unequal histograms, span metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import histograms as h
from ..operators import metrics as m
from ..operators import rollup as ru
from ..operators import traces as tr
from ..sources import fixtures as fx
from ..streaming import generators as ge

DAY = fx.DAY
#: Month that the metric tables cover.
FIRST, LAST = 1_704_067_200_000_000, 1_704_067_200_000_000 + 31 * DAY
SPAN_STEP = 30 * DAY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SERIES = "'event_type=' || event_type || ',shard=' || shard AS series"
_NOW = f"now_ AS (SELECT {_SERIES}, arg_max(value, ts_us) AS value FROM counters WHERE ts_us <= {LAST} GROUP BY 1)"
_THEN = f"then_ AS (SELECT {_SERIES}, arg_max(value, ts_us) AS value FROM counters WHERE ts_us + {10 * DAY} <= {LAST} GROUP BY 1)"


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str, *ctes: str) -> None:
    QUERIES[name] = build
    SQL[name] = f"WITH {', '.join(ctes)} {sql}"


def _now(spark: SparkSession, d: str) -> DataFrame:
    return m.instant(fx.counters(spark, d), LAST, None).select("series", "value")


def _then(spark: SparkSession, d: str) -> DataFrame:
    return m.instant(m.offset(fx.counters(spark, d), 10 * DAY), LAST, None).select("series", "value")


def _set(op: str):
    def build(spark: SparkSession, d: str) -> DataFrame:
        return m.set_operation(_now(spark, d).where("value <= 2"), _then(spark, d).where("value > 1"), op, ("series",))

    return build


_add("m33_offset", _then, "SELECT * FROM then_", fx.COUNTERS_SQL, _THEN)
_add("m33_comparison", lambda spark, d: _now(spark, d).where("value > 2"), "SELECT * FROM now_ WHERE value > 2", fx.COUNTERS_SQL, _NOW)
_add("m33_and", _set("and"), "SELECT * FROM now_ WHERE value <= 2 AND series IN (SELECT series FROM then_ WHERE value > 1)", fx.COUNTERS_SQL, _NOW, _THEN)
_add("m33_or", _set("or"), "SELECT * FROM now_ WHERE value <= 2 UNION ALL SELECT * FROM then_ WHERE value > 1 AND series NOT IN (SELECT series FROM now_ WHERE value <= 2)", fx.COUNTERS_SQL, _NOW, _THEN)
_add("m13_bottomk", lambda spark, d: m.top(_now(spark, d), 5, bottom=True), "SELECT * FROM now_ ORDER BY value, series LIMIT 5", fx.COUNTERS_SQL, _NOW)


def _arithmetic(op: str):
    def build(spark: SparkSession, d: str) -> DataFrame:
        return m.arithmetic(_now(spark, d), _then(spark, d), op, ("series",))

    return build


for _name, _op in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
    _add(f"m31_{_name}", _arithmetic(_op), f"SELECT series, n.value {_op} t.value AS value FROM now_ n JOIN then_ t USING (series)", fx.COUNTERS_SQL, _NOW, _THEN)


_add("m01_instant_lookback", lambda spark, d: m.instant(fx.counters(spark, d), FIRST + 10 * DAY, 6 * fx.HOUR).select("series", "value", "ts_us"), f"SELECT {_SERIES}, arg_max(value, ts_us) AS value, max(ts_us) AS ts_us FROM counters WHERE ts_us <= {FIRST + 10 * DAY} AND ts_us > {FIRST + 10 * DAY - 6 * fx.HOUR} GROUP BY 1", fx.COUNTERS_SQL)


# histograms
def _points(spark: SparkSession, d: str) -> DataFrame:
    return fx.histograms(spark, d).withColumn("event_type", F.col("labels")["event_type"])


def _growing(spark: SparkSession, d: str) -> DataFrame:
    """The same points as cumulative ones."""
    w = W.partitionBy("event_type").orderBy("ts_us")
    x = _points(spark, d)
    buckets = F.array(*[F.sum(F.col("bucket_counts")[i]).over(w) for i in range(len(fx.BOUNDS) + 1)])
    return x.select("ts_us", "name", "labels", "event_type", "explicit_bounds", buckets.alias("bucket_counts"), F.sum("value").over(w).alias("value"), F.sum("count").over(w).alias("count"), F.lit("cumulative").alias("temporality"))


_SUMS = ", ".join(f"sum(bucket_counts[{i}]) OVER w" for i in range(1, len(fx.BOUNDS) + 2))
_GROWING = f"cu AS (SELECT event_type, ts_us, [{_SUMS}] AS bc, sum(value) OVER w AS value, sum(cnt) OVER w AS cnt FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY ts_us))"
_text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
_rolled = lambda x: ru.rollup_histogram(x, DAY).select("series", "t", _text("bucket_counts").alias("counts"), F.size("explicit_bounds").alias("n_bounds"), F.round("value", 2).alias("value"), "count")

_add(
    "r03_rollup_delta", lambda spark, d: _rolled(_points(spark, d)),
    "SELECT 'event_type=' || event_type AS series, t, string_agg(n::BIGINT::VARCHAR, ',' ORDER BY pos) AS counts, 6 AS n_bounds, any_value(value) AS value, any_value(count) AS count FROM (SELECT event_type, t, pos, sum(n) AS n, round(sum(value), 2) AS value, sum(cnt)::BIGINT AS count FROM u GROUP BY 1, 2, 3) GROUP BY 1, 2",
    fx.HISTOGRAMS_SQL, f"u AS (SELECT event_type, ts_us // {DAY} * {DAY} AS t, i AS pos, bucket_counts[i] AS n, value, cnt FROM hist, range(1, 8) AS r(i))",
)
_add(
    "r03_rollup_cumulative", lambda spark, d: _rolled(_growing(spark, d)),
    "SELECT 'event_type=' || event_type AS series, t, string_agg(greatest(b[i] - a[i], 0)::BIGINT::VARCHAR, ',' ORDER BY i) AS counts, 6 AS n_bounds, round(any_value(v), 2) AS value, any_value(c)::BIGINT AS count FROM e, range(1, 8) AS r(i) GROUP BY 1, 2",
    fx.HISTOGRAMS_SQL, _GROWING, f"e AS (SELECT event_type, ts_us // {DAY} * {DAY} AS t, arg_min(bc, ts_us) AS a, arg_max(bc, ts_us) AS b, arg_max(value, ts_us) - arg_min(value, ts_us) AS v, max(cnt) - min(cnt) AS c FROM cu GROUP BY 1, 2)",
)
_add(
    "m19_snapshots_cumulative", lambda spark, d: h.snapshots(_growing(spark, d), "count", FIRST, LAST, DAY, "event_type", delta=False),
    "SELECT event_type, t, arg_max(cnt, ts_us)::DOUBLE AS value FROM cu JOIN st ON ts_us <= t GROUP BY 1, 2", fx.HISTOGRAMS_SQL, _GROWING, f"st AS (SELECT unnest(range({FIRST}, {LAST} + 1, {DAY})) AS t)",
)


def _unequal(spark: SparkSession, d: str) -> DataFrame:
    """Points of odd hours end after three bounds."""
    odd = F.floor(F.col("ts_us") / fx.HOUR) % 2 == 1
    x = _points(spark, d)
    return x.withColumn("explicit_bounds", F.when(odd, F.slice("explicit_bounds", 1, 3)).otherwise(F.col("explicit_bounds"))).withColumn("bucket_counts", F.when(odd, F.slice("bucket_counts", 1, 4)).otherwise(F.col("bucket_counts")))


_add(
    "m21_merge_unequal",
    lambda spark, d: h.merge(_unequal(spark, d), "event_type").select("event_type", _text("bucket_counts").alias("counts"), F.array_join(F.transform("explicit_bounds", lambda b: b.cast("int").cast("string")), ",").alias("bounds")),
    f"SELECT event_type, string_agg(n::BIGINT::VARCHAR, ',' ORDER BY i) AS counts, '{','.join(str(int(b)) for b in fx.BOUNDS)}' AS bounds FROM (SELECT event_type, i, sum(bucket_counts[i]) AS n FROM hist, range(1, 8) AS r(i) WHERE i <= 4 OR ts_us // {fx.HOUR} % 2 = 0 GROUP BY 1, 2) GROUP BY 1",
    fx.HISTOGRAMS_SQL,
)


# metrics derived from spans
_RED = f"red AS (SELECT app_id, service, name, kind, status_code, start_us // {DAY} * {DAY} AS t, count(*) AS calls, sum(dur_us)::BIGINT AS us FROM spans GROUP BY ALL)"


def _red(spark: SparkSession, d: str) -> DataFrame:
    return ge.red_metrics(fx.spans(spark, d), DAY)


_add(
    "m35_span_metric_quantile", lambda spark, d: m.span_metric_series(_red(spark, d), SPAN_STEP, "quantile_over_time", 0.95).withColumn("value", F.round("value", 9)),
    f"SELECT service, t // {SPAN_STEP} * {SPAN_STEP} AS t, round(quantile_cont(us / 1000, 0.95) / 1000, 9) AS value FROM red GROUP BY 1, 2", fx.SPANS_SQL, _RED,
)
_add(
    "m35_span_metric_rate", lambda spark, d: m.span_metric_series(_red(spark, d), SPAN_STEP, "rate", by=("service", "kind")),
    f"SELECT service, kind, t // {SPAN_STEP} * {SPAN_STEP} AS t, sum(calls)::DOUBLE AS value FROM red GROUP BY 1, 2, 3", fx.SPANS_SQL, _RED,
)
_add(
    "m28_exemplar_series", lambda spark, d: tr.exemplars(_red(spark, d).where("status_code = 'Error'"), fx.spans(spark, d), "traces_spanmetrics_calls_total"),
    "SELECT 'traces_spanmetrics_calls_total' AS metric, service, arg_max(trace_id, (start_us, trace_id)) AS trace_id, max(start_us) AS start_us FROM spans WHERE service IN (SELECT service FROM red WHERE status_code = 'Error') GROUP BY 2", fx.SPANS_SQL, _RED,
)
_add(
    "f02_spelled_values",
    lambda spark, d: _red(spark, d).withColumn("labels", F.create_map(F.lit("span_kind"), "kind", F.lit("status_code"), "status_code")).where(f.label_matchers(F.col("labels"), ("span.kind", "=", "SPAN_KIND_SERVER"), ("statusCode", "!=", "2"))).groupBy("service", "kind", "status_code").agg(F.sum("calls").alias("calls")),
    "SELECT service, kind, status_code, count(*) AS calls FROM spans WHERE kind = 'Server' AND status_code <> 'Error' GROUP BY 1, 2, 3", fx.SPANS_SQL,
)
