"""Telemetry derived from the order and event tables, in Spark and as SQL text for checks.

Every order is a trace; its lines are client, server, database and producer spans. Clients of third lines carry a database's name but
no system, those of fifth lines a messaging system; servers of seventh lines start 10 s after their client. Events are gauge samples, counter
samples that start again at midnight, hourly delta histograms, and log records.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dealing import dealt

BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
HOUR = 3_600_000_000
DAY = 24 * HOUR


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of the derived tables of an input folder, where ``store`` has written them.
_STORED: dict[str, str] = {}


def _derived(build):
    """Reads a table that is stored, else derives it."""

    @wraps(build)
    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{_STORED[sf_dir]}/{build.__name__}") if sf_dir in _STORED else build(spark, sf_dir)

    return table


def store(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the derived tables once; later reads of ``sf_dir`` take them from ``folder``."""
    for build in (spans, gauges, counters, histograms, logs):
        build(spark, sf_dir).write.parquet(f"{folder}/{build.__name__}")
    _STORED[sf_dir] = folder


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str, str]:
    """Orders, their numbered lines, the SQL of an order's span and of the array of a line's spans."""
    lines = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr(
        "*",
        "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as ln",
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ok"), _micros("o_orderdate").alias("t0"), F.floor("o_totalprice").alias("total"), "o_orderstatus", "o_orderpriority", F.concat(F.lit("app-"), F.col("o_custkey") % 5).alias("app_id")
    )
    void = "cast(null as string)"

    def span(level, parent, name, kind, service, start, dur, status, method=void, db=(void, void), msg=(void, void, void)):
        return (
            f"named_struct('trace_id', concat('t', ok), 'span_id', {level}, 'parent_span_id', {parent}, 'name', {name}, 'kind', '{kind}', 'service', {service}, 'start_us', {start}, "
            f"'dur_us', cast({dur} as bigint), 'status_code', {status}, 'app_id', app_id, 'http_method', {method}, 'db_system', {db[0]}, 'db_name', {db[1]}, 'msg_system', {msg[0]}, 'msg_dest', {msg[1]}, 'msg_size', {msg[2]})"
        )

    root = span("concat('o', ok)", "''", "concat('POST /', o_orderpriority)", "Server", "'gateway'", "t0", "total", "if(o_orderstatus = 'P', 'Error', 'Ok')", "'POST'")
    failed = "if(l_returnflag = 'R', 'Error', 'Ok')"
    key = "concat(ok, '_', ln)"
    service = "concat('supplier-', l_suppkey % 10)"
    client = span(f"concat('c', {key})", "concat('o', ok)", "'CALL supplier'", "Client", "'gateway'", "t0 + ln * 1000", "floor(l_extendedprice / 10)", failed, "'GET'", db=(void, "if(l_linenumber = 3, 'cache', null)"), msg=("if(l_linenumber = 5, 'rabbit', null)", void, void))
    server = span(f"concat('s', {key})", f"concat('c', {key})", "concat('GET /part/', l_linenumber)", "Server", service, "t0 + ln * 1000 + 200 + if(l_linenumber = 7, 10000000, 0)", "floor(l_extendedprice / 20)", failed, "'GET'")
    db = span(f"concat('d', {key})", f"concat('s', {key})", "'SELECT part'", "Client", service, "t0 + ln * 1000 + 300", "floor(l_quantity * 100)", "'Ok'", db=("'mysql'", "concat('shard', l_partkey % 4)"))
    sent = span(f"concat('m', {key})", f"concat('s', {key})", "'send orders'", "Producer", service, "t0 + ln * 1000 + 400", "floor(l_quantity * 10)", "'Ok'", msg=("'kafka'", "'orders'", "cast(floor(l_quantity) * 64 as string)"))
    below = f"concat(array({client}, {server}), if(l_linestatus = 'F', array({db}), array()), if(l_returnflag = 'A', array({sent}), array()))"
    return orders, lines, root, below


def _canonical(flat: DataFrame, *more: str) -> DataFrame:
    """Spans with maps of attributes, resource and events; ``more`` columns come last."""
    names = {"http.method": "http_method", "db.system": "db_system", "db.name": "db_name", "messaging.system": "msg_system", "messaging.destination.name": "msg_dest", "messaging.message.body.size": "msg_size"}
    attributes = F.map_filter(F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    return flat.select(
        "trace_id", "span_id", "parent_span_id", "name", "kind", "status_code", F.lit("").alias("status_message"), "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"), "dur_us", "service", "app_id",
        attributes.alias("attributes"), F.create_map(F.lit("service.name"), F.col("service"), F.lit("app_id"), F.col("app_id")).alias("resource"),
        F.when(F.col("db_system").isNotNull(), F.array(F.struct(F.col("start_us").alias("time_us"), F.lit("db.query").alias("name"), F.create_map(F.lit("db.name"), F.col("db_name")).alias("attributes")))).otherwise(F.array().cast("array<struct<time_us: bigint, name: string, attributes: map<string, string>>>")).alias("events"),
        *more,
    )


@_derived
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over lines joined with their orders; each line explodes into its spans."""
    orders, lines, root, below = _sources(spark, sf_dir)
    joined = lines.join(orders, lines["l_orderkey"] == orders["ok"]).selectExpr(f"explode({below}) as s").select("s.*")
    return _canonical(orders.selectExpr(f"{root} as s").select("s.*").unionByName(joined))


def spans_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``spans`` with their order's key as ``ok``, dealt by it: what groups by ``ok`` as well moves no span. An order's own span
    comes with its first line, or alone."""
    orders, lines, root, below = _sources(spark, sf_dir)
    joined = orders.join(lines.hint("merge"), orders["ok"] == lines["l_orderkey"], "left")  # a broadcast of lines would leave orders as they lie
    every = f"concat(if(coalesce(ln, 1) = 1, array({root}), array()), if(ln is null, array(), {below}))"
    return _canonical(joined.selectExpr("ok", f"explode({every}) as s").select("s.*", "ok"), "ok")


@_derived
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        _micros("ts").alias("ts_us"), F.lit("app.value").alias("name"), F.lit("gauge").alias("type"), "value", F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 10).cast("string")).alias("labels"),
        F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service"), F.concat(F.lit("app-"), F.col("user_id") % 5).alias("app_id"), F.lit("").alias("unit"),
    )


@_derived
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts_us", _micros("ts"))
    e = e.withColumn("shard", F.col("user_id") % 10).withColumn("value", F.expr(f"cast(row_number() over (partition by event_type, shard, floor(ts_us / {DAY}) order by ts_us) as double)"))
    return e.select(
        "ts_us", F.lit("app.events").alias("name"), F.lit("counter").alias("type"), "value", F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("shard"), F.col("shard").cast("string")).alias("labels"),
        F.concat(F.lit("svc-"), F.col("shard")).alias("service"), F.concat(F.lit("app-"), F.col("user_id") % 5).alias("app_id"), F.lit("1").alias("unit"),
    )


@_derived
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta points per event type and hour."""
    e = read(spark, sf_dir, "events").withColumn("hour", F.floor(_micros("ts") / HOUR) * HOUR)
    edges = [float("-inf"), *BOUNDS, float("inf")]
    counts = [F.count(F.when((F.col("value") > lo) & (F.col("value") <= hi), 1)) for lo, hi in zip(edges, edges[1:])]
    g = e.groupBy("event_type", "hour").agg(F.array(*counts).alias("bucket_counts"), F.sum(F.floor(F.col("value") * 100)).alias("cents"), F.count(F.lit(1)).alias("count"))
    return g.select(
        F.col("hour").alias("ts_us"), F.lit("app.value.hist").alias("name"), F.lit("histogram").alias("type"), (F.col("cents") / 100).alias("value"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"),
        "bucket_counts", F.array(*[F.lit(b) for b in BOUNDS]).alias("explicit_bounds"), "count", F.lit("delta").alias("temporality"),
    )


@_derived
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    body = F.concat(F.lit("event="), F.col("event_type"), F.lit(" user="), F.col("user_id"), F.lit(" cents="), F.floor(F.col("value") * 100))
    return e.select(
        F.col("event_id").alias("log_id"), _micros("ts").alias("ts_us"), severity.alias("severity"), F.when(severity == "ERROR", 17).when(severity == "WARN", 13).otherwise(9).alias("severity_number"), body.alias("body"), F.col("props").alias("json_body"),
        F.concat(F.lit("t"), F.col("event_id")).alias("trace_id"), F.concat(F.lit("o"), F.col("event_id")).alias("span_id"), F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service"), F.concat(F.lit("app-"), F.col("user_id") % 5).alias("app_id"),
        F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string")).alias("attributes"),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal, app_id, day, rows, bytes) of the three signals."""
    day = lambda c: F.floor(F.col(c) / DAY)
    parts = [("trace", spans(spark, sf_dir), "start_us"), ("metric", gauges(spark, sf_dir), "ts_us"), ("log", logs(spark, sf_dir), "ts_us")]
    out = None
    for signal, df, at in parts:
        x = df.groupBy("app_id", day(at).alias("day")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(signal).alias("signal"), "app_id", "day", "n_rows", (F.col("n_rows") * 100).alias("n_bytes"))
        out = x if out is None else out.unionByName(x)
    return out


#: The same tables as DuckDB common table expressions, with attributes as plain columns.
SPANS_SQL = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ln FROM lineitem),
j AS (SELECT *, epoch_us(o_orderdate) AS t0, o_orderkey || '_' || ln AS k, 'supplier-' || (l_suppkey % 10) AS svc, CASE WHEN l_returnflag = 'R' THEN 'Error' ELSE 'Ok' END AS st, 'app-' || (o_custkey % 5) AS app FROM li JOIN orders ON l_orderkey = o_orderkey),
spans AS MATERIALIZED (
 SELECT 't' || o_orderkey AS trace_id, 'o' || o_orderkey AS span_id, '' AS parent_span_id, 'POST /' || o_orderpriority AS name, 'Server' AS kind, 'gateway' AS service, epoch_us(o_orderdate) AS start_us, floor(o_totalprice)::BIGINT AS dur_us,
  CASE WHEN o_orderstatus = 'P' THEN 'Error' ELSE 'Ok' END AS status_code, 'app-' || (o_custkey % 5) AS app_id, 'POST' AS http_method, NULL AS db_system, NULL AS db_name, NULL AS msg_system, NULL::BIGINT AS msg_size FROM orders
 UNION ALL SELECT 't' || o_orderkey, 'c' || k, 'o' || o_orderkey, 'CALL supplier', 'Client', 'gateway', t0 + ln * 1000, floor(l_extendedprice / 10)::BIGINT, st, app, 'GET', NULL, CASE WHEN l_linenumber = 3 THEN 'cache' END, CASE WHEN l_linenumber = 5 THEN 'rabbit' END, NULL FROM j
 UNION ALL SELECT 't' || o_orderkey, 's' || k, 'c' || k, 'GET /part/' || l_linenumber, 'Server', svc, t0 + ln * 1000 + 200 + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END, floor(l_extendedprice / 20)::BIGINT, st, app, 'GET', NULL, NULL, NULL, NULL FROM j
 UNION ALL SELECT 't' || o_orderkey, 'd' || k, 's' || k, 'SELECT part', 'Client', svc, t0 + ln * 1000 + 300, floor(l_quantity * 100)::BIGINT, 'Ok', app, NULL, 'mysql', 'shard' || (l_partkey % 4), NULL, NULL FROM j WHERE l_linestatus = 'F'
 UNION ALL SELECT 't' || o_orderkey, 'm' || k, 's' || k, 'send orders', 'Producer', svc, t0 + ln * 1000 + 400, floor(l_quantity * 10)::BIGINT, 'Ok', app, NULL, NULL, NULL, 'kafka', floor(l_quantity)::BIGINT * 64 FROM j WHERE l_returnflag = 'A')
"""
GAUGES_SQL = "gauges AS (SELECT epoch_us(ts) AS ts_us, value, event_type, (user_id % 10)::VARCHAR AS shard, 'svc-' || (user_id % 10) AS service, 'app-' || (user_id % 5) AS app_id FROM events)"
COUNTERS_SQL = f"counters AS (SELECT epoch_us(ts) AS ts_us, event_type, (user_id % 10)::VARCHAR AS shard, row_number() OVER (PARTITION BY event_type, user_id % 10, epoch_us(ts) // {DAY} ORDER BY ts)::DOUBLE AS value FROM events)"
_COUNTS = ", ".join(f"count(CASE WHEN value > {lo} AND value <= {hi} THEN 1 END)" for lo, hi in zip(["'-inf'::DOUBLE", *BOUNDS], [*BOUNDS, "'inf'::DOUBLE"]))
HISTOGRAMS_SQL = f"hist AS (SELECT event_type, epoch_us(ts) // {HOUR} * {HOUR} AS ts_us, [{_COUNTS}] AS bucket_counts, sum(floor(value * 100))::BIGINT / 100 AS value, count(*) AS cnt FROM events GROUP BY 1, 2)"
LOGS_SQL = """logs AS (SELECT event_id AS log_id, epoch_us(ts) AS ts_us, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity,
 'event=' || event_type || ' user=' || user_id || ' cents=' || floor(value * 100)::BIGINT AS body, props, 't' || event_id AS trace_id, 'svc-' || (user_id % 10) AS service, 'app-' || (user_id % 5) AS app_id, event_type, user_id, floor(value * 100)::BIGINT AS cents FROM events)"""
