"""Registered queries over the derived telemetry tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import metric_labels, sanitize_attributes, series_key, time_bucket
from ..operators import filters as f
from ..operators import histograms as h
from ..operators import logs as lg
from ..operators import metrics as m
from ..operators import retention as rt
from ..operators import rollup as ru
from ..operators import structure as st
from ..operators import traces as tr
from ..sources import fixtures as fx
from ..streaming import generators as ge
from . import ingest, series

HOUR, DAY = fx.HOUR, fx.DAY
#: Window of the metric and log queries: five days of January 2024, every six hours, looking back twelve.
START, END, STEP, RANGE = 1_704_153_600_000_000, 1_704_153_600_000_000 + 5 * DAY, 6 * HOUR, 12 * HOUR
#: Window of the trace queries: 1996, by 30 days.
T0, T1, TSTEP = 820_454_400_000_000, 820_454_400_000_000 + 12 * 30 * DAY, 30 * DAY

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Queries over a range: source and ``build(rows, start, end)``; below they get the range of their whole table.
_RANGED: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def _add(name: str, build, sql: str, *ctes: str, recursive: bool = False) -> None:
    _QUERIES[name] = build
    _SQL[name] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes) + " " if ctes else "") + sql


def _ranged(name: str, source: str, build) -> None:
    if getattr(build, "__defaults__", None) and build.__code__.co_varnames[1:3] == ("a", "b"):
        _RANGED[name] = (source, build)


def _s(name: str, build, sql: str, *more: str, recursive: bool = False) -> None:
    """A query over spans."""
    _ranged(name, "s", build)
    _add(name, lambda spark, d: build(fx.spans(spark, d)), sql, fx.SPANS_SQL, *more, recursive=recursive)


def _g(name: str, build, sql: str, *more: str) -> None:
    _ranged(name, "g", build)
    _add(name, lambda spark, d: build(fx.gauges(spark, d)), sql, fx.GAUGES_SQL, *more)


def _c(name: str, build, sql: str, *more: str) -> None:
    _ranged(name, "c", build)
    _add(name, lambda spark, d: build(m.with_series(fx.counters(spark, d))), sql, fx.COUNTERS_SQL, *more)


def _h(name: str, build, sql: str, *more: str) -> None:
    _ranged(name, "h", build)
    _add(name, lambda spark, d: build(fx.histograms(spark, d).withColumn("event_type", F.col("labels")["event_type"])), sql, fx.HISTOGRAMS_SQL, *more)


def _l(name: str, build, sql: str, *more: str) -> None:
    _ranged(name, "l", build)
    _add(name, lambda spark, d: build(fx.logs(spark, d)), sql, fx.LOGS_SQL, *more)


_by = lambda col: F.col("labels")[col].alias(col)
_SERIES = "'event_type=' || event_type || ',shard=' || shard"


def _error():
    return F.col("status_code") == "Error"


def _server():
    return F.col("kind") == "Server"


def _client():
    return F.col("kind") == "Client"



# sources and keys
_s("s04_sanitize_attributes", lambda s: s.select("span_id", F.explode(sanitize_attributes(F.create_map(F.lit("a.b.c.d"), F.col("name"), F.lit("plain"), F.col("kind")))).alias("k", "v")),
   "SELECT span_id, 'a.b_c_d' AS k, name AS v FROM spans UNION ALL SELECT span_id, 'plain', kind FROM spans")
_g("s04_metric_labels", lambda g: g.select("ts_us", F.explode(metric_labels(F.create_map(F.lit("x.y.z"), F.floor("value").cast("long")))).alias("k", "v")), "SELECT ts_us, 'x_y_z' AS k, floor(value)::BIGINT::VARCHAR AS v FROM gauges")
_g("s10_tiered_scan", lambda g: ru.tiered(g.select("ts_us", "value"), ru.rollup_gauge(g).select(F.col("t").alias("ts_us"), "value"), START + DAY).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("v")),
   f"SELECT '5m' AS tier, count(*) AS n, round(sum(v), 3) AS v FROM (SELECT avg(value) AS v, ts_us // 300000000 * 300000000 AS t FROM gauges GROUP BY event_type, shard, t) WHERE t < {START + DAY} UNION ALL SELECT 'raw', count(*), round(sum(value), 3) FROM gauges WHERE ts_us >= {START + DAY}")

# filters
_s("f01_time_range", lambda s: f.time_range(s.withColumn("day", F.floor(F.col("start_us") / DAY)), "start_us", T0, T0 + 5 * DAY, "day").select("span_id", "start_us"), f"SELECT span_id, start_us FROM spans WHERE start_us BETWEEN {T0} AND {T0 + 5 * DAY}")
_g("f02_label_matchers", lambda g: g.where(f.label_matchers(F.col("labels"), ("eventType", "=~", "c.*|error"), ("shard", "!~", "[0-3]"), ("region", "!=", "eu"))).groupBy(_by("event_type"), _by("shard")).agg(F.count(F.lit(1)).alias("n")),
   "SELECT event_type, shard, count(*) AS n FROM gauges WHERE (event_type LIKE 'c%' OR event_type = 'error') AND shard NOT IN ('0','1','2','3') GROUP BY 1, 2")
_add("f04_metric_names", lambda spark, d: fx.gauges(spark, d).select("name", "ts_us").unionByName(fx.counters(spark, d).select("name", "ts_us")).where(f.metric_names(F.col("name"), ("=", "app.value"), ("=~", "app\\.ev.+"))).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
     "SELECT 'app.value' AS name, count(*) AS n FROM events UNION ALL SELECT 'app.events', count(*) FROM events")
_s("f06_span_condition", lambda s: s.where(f.all_of(f.span_condition("kind", "=", "server"), f.span_condition("status", "=", "STATUS_CODE_ERROR"), f.span_condition("duration", ">", 3000), f.span_condition("name", "=~", "GET /part/[1-3]"))).select("trace_id", "span_id"),
   "SELECT trace_id, span_id FROM spans WHERE kind = 'Server' AND status_code = 'Error' AND dur_us > 3000 AND regexp_matches(name, '^GET /part/[1-3]$')")
_s("f08_or_groups", lambda s: s.where(f.any_of(f.all_of(f.span_condition("kind", "=", "Client"), f.span_condition(".db.name", "=", "shard1")), f.span_condition("span.messaging.system", "=", "kafka"))).groupBy("service").agg(F.count(F.lit(1)).alias("n")),
   "SELECT service, count(*) AS n FROM spans WHERE (kind = 'Client' AND db_name = 'shard1') OR msg_system = 'kafka' GROUP BY 1")
_s("f09_exists", lambda s: s.groupBy(f.span_condition("span.db.system", "!=", None).alias("has_db"), f.span_condition("span.http.method", "=", None).alias("no_http")).agg(F.count(F.lit(1)).alias("n")), "SELECT db_system IS NOT NULL AS has_db, http_method IS NULL AS no_http, count(*) AS n FROM spans GROUP BY 1, 2")
_s("f10_or_negation", lambda s: s.where(f.any_of(~f.span_condition("service", "=", "gateway"), f.span_condition("name", "!~", "CALL.*|POST.*"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM spans WHERE service <> 'gateway' OR NOT regexp_matches(name, '^(CALL.*|POST.*)$') GROUP BY 1")
_s("f11_event_filter", lambda s: s.where(f.has_event("db.query", db__name="shard2")).groupBy("service").agg(F.count(F.lit(1)).alias("n")), "SELECT service, count(*) AS n FROM spans WHERE db_name = 'shard2' GROUP BY 1")
_s("f12_roots", lambda s: s.where(f.is_root() & f.span_condition("name", "=", "POST /1-URGENT")).select("trace_id"), "SELECT trace_id FROM spans WHERE parent_span_id = '' AND name = 'POST /1-URGENT'")
_s("f13_duration", lambda s: s.where(f.duration_between(1000, 1500)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM spans WHERE dur_us BETWEEN 1000 AND 1500 GROUP BY 1")
_s("f14_trace_duration", lambda s: f.trace_duration_between(s, 100_000, 200_000).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")), "SELECT trace_id, count(*) AS n FROM spans GROUP BY 1 HAVING max(start_us + dur_us) - min(start_us) BETWEEN 100000 AND 200000")
_l("f15_stream_selector", lambda x: x.where(f.stream_selector(("service_name", "=~", "svc-[1-4]"), ("level", "!=", "INFO"), ("event_type", "!~", "sign.*"))).groupBy("service", "severity").agg(F.count(F.lit(1)).alias("n")), "SELECT service, severity, count(*) AS n FROM logs WHERE service IN ('svc-1','svc-2','svc-3','svc-4') AND severity <> 'INFO' AND event_type NOT LIKE 'sign%' GROUP BY 1, 2")
_l("f16_line_filters", lambda x: x.where(f.line_filter("|=", "user=1") & f.line_filter("!=", "click") & f.line_filter("|~", "cents=[0-9]{4}") & f.line_filter("!~", "(?i)ERROR") & f.line_filter("|=", "")).select("log_id"), "SELECT log_id FROM logs WHERE contains(body, 'user=1') AND NOT contains(body, 'click') AND regexp_matches(body, 'cents=[0-9]{4}') AND NOT contains(body, 'error')")
_l("f17_full_text", lambda x: x.where(f.full_text("Error user")).groupBy("service").agg(F.count(F.lit(1)).alias("n")), "SELECT service, count(*) AS n FROM logs WHERE event_type = 'error' GROUP BY 1")
_l("f18_log_equality", lambda x: x.where(F.col("severity").isin("ERROR", "WARN") & (F.col("app_id") == "app-1")).select("log_id", "severity"), "SELECT log_id, severity FROM logs WHERE severity IN ('ERROR', 'WARN') AND app_id = 'app-1'")
_l("f19_extracted_filter", lambda x: x.withColumn("x", lg.logfmt_fields(F.col("body"))).where(f.extracted_filter(F.col("x"), "event", "=~", "cl.*") & f.extracted_filter(F.col("x"), "nope", "!=", "1")).select("log_id"), "SELECT log_id FROM logs WHERE event_type LIKE 'cl%'")

# traces
_s("t01_search", lambda s: tr.search(s, _error(), 50, 5), "SELECT trace_id, last_us, total FROM (SELECT trace_id, max(start_us) AS last_us, count(*) OVER () AS total FROM spans WHERE status_code = 'Error' GROUP BY 1) ORDER BY last_us DESC, trace_id LIMIT 50 OFFSET 5")
_s("t02_summaries", lambda s: tr.summaries(s, F.col("kind") == "Client", 3).select("trace_id", "root_name", "root_service", "start_us", "duration_ms", "n_spans", F.array_join("matched", ",").alias("matched")),
   "SELECT trace_id, root_name, root_service, start_us, duration_ms, n_spans, matched FROM (SELECT trace_id, arg_min(name, (parent_span_id <> '', start_us, span_id)) AS root_name, arg_min(service, (parent_span_id <> '', start_us, span_id)) AS root_service, min(start_us) AS start_us, (max(start_us + dur_us) - min(start_us)) / 1000 AS duration_ms, count(*) AS n_spans FROM spans GROUP BY 1) JOIN (SELECT trace_id, string_agg(span_id, ',' ORDER BY n) AS matched FROM (SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_us, span_id) AS n FROM spans WHERE kind = 'Client') WHERE n <= 3 GROUP BY 1) USING (trace_id)")
_s("t03_spans_of_matching", lambda s: tr.spans_of_matching(s, F.col("dur_us") > 400_000).select("trace_id", "span_id"), "SELECT trace_id, span_id FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE dur_us > 400000)")
_s("t04_by_id", lambda s: tr.by_id(s, "t1", "t7", "t12").select("trace_id", "span_id", "start_us"), "SELECT trace_id, span_id, start_us FROM spans WHERE trace_id IN ('t1', 't7', 't12')")
_s("t05_durations", tr.durations, "SELECT trace_id, max(start_us + dur_us) - min(start_us) AS duration_us FROM spans GROUP BY 1")
_s("t06_services", tr.services, "SELECT service, count(*) AS n_spans FROM spans GROUP BY 1")
_s("t07_operations", lambda s: tr.operations(s, "supplier-3"), "SELECT DISTINCT name, kind FROM spans WHERE service = 'supplier-3'")
_s("t08_service_dependencies", tr.dependencies, "SELECT p.service AS parent, c.service AS child, count(*) AS calls FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service <> c.service GROUP BY 1, 2")
_s("t09_co_occurrence", tr.co_occurrence, "SELECT a.service AS service_a, b.service AS service_b, count(*) AS n_traces FROM (SELECT DISTINCT trace_id, service FROM spans) a JOIN (SELECT DISTINCT trace_id, service FROM spans) b ON a.trace_id = b.trace_id AND a.service < b.service GROUP BY 1, 2")
_FAILED, _SENT = "kind = 'Server' and status_code = 'Error'", "kind = 'Producer'"
_UP = "up AS (SELECT trace_id, parent_span_id AS a, span_id AS b, 1 AS d FROM spans WHERE parent_span_id <> '' UNION ALL SELECT up.trace_id, s.parent_span_id, up.b, up.d + 1 FROM up JOIN spans s ON s.trace_id = up.trace_id AND s.span_id = up.a WHERE s.parent_span_id <> '')"
_s("t10_descendants", lambda s: st.descendants(s, _FAILED, _SENT), "SELECT up.trace_id, a, b FROM up JOIN spans x ON x.trace_id = up.trace_id AND x.span_id = a JOIN spans y ON y.trace_id = up.trace_id AND y.span_id = b WHERE x.kind = 'Server' AND x.status_code = 'Error' AND y.kind = 'Producer'", _UP, recursive=True)
_s("t11_children", lambda s: st.children(s.where(_client()), s.where(_server() & _error())), "SELECT c.trace_id, p.span_id AS a, c.span_id AS b FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.kind = 'Client' AND c.kind = 'Server' AND c.status_code = 'Error'")
_s("t12_siblings", lambda s: st.siblings(s.where(F.col("name") == "SELECT part"), s.where(F.col("kind") == "Producer")), "SELECT x.trace_id, x.span_id AS a, y.span_id AS b FROM spans x JOIN spans y ON x.trace_id = y.trace_id AND x.parent_span_id = y.parent_span_id AND x.span_id <> y.span_id WHERE x.name = 'SELECT part' AND y.kind = 'Producer'")
_s("t13_not_child", lambda s: st.not_related(st.children(s.where(_server() & _error()), s.where(F.col("kind") == "Producer")), s.where(_server() & _error()), s.where(F.col("kind") == "Producer")), "SELECT x.trace_id, x.span_id AS a, y.span_id AS b FROM spans x JOIN spans y ON x.trace_id = y.trace_id AND y.parent_span_id <> x.span_id WHERE x.kind = 'Server' AND x.status_code = 'Error' AND y.kind = 'Producer'")
_s("t14_any_structure", lambda s: st.any_structure(st.child_spans(s.where(_server()), s.where(F.col("kind") == "Producer")), st.sibling_spans(s.where(F.col("kind") == "Producer"), s.where(F.col("name") == "SELECT part"))), "SELECT trace_id, span_id FROM spans y WHERE kind = 'Producer' UNION SELECT y.trace_id, y.span_id FROM spans y JOIN spans x ON x.trace_id = y.trace_id AND x.parent_span_id = y.parent_span_id WHERE y.name = 'SELECT part' AND x.kind = 'Producer'")
_A = "x.kind = 'Server' AND x.status_code = 'Error'"
_s("t10_descendant_spans", lambda s: st.descendant_spans(s, _FAILED, _SENT), f"SELECT DISTINCT up.trace_id, b AS span_id FROM up JOIN spans x ON x.trace_id = up.trace_id AND x.span_id = a JOIN spans y ON y.trace_id = up.trace_id AND y.span_id = b WHERE {_A} AND y.kind = 'Producer'", _UP, recursive=True)
_s("t12_sibling_spans", lambda s: st.sibling_spans(s.where(_client()), s.where(_client() & _error())), "SELECT trace_id, span_id FROM spans y WHERE kind = 'Client' AND status_code = 'Error' AND EXISTS (SELECT 1 FROM spans x WHERE x.trace_id = y.trace_id AND x.parent_span_id = y.parent_span_id AND x.span_id <> y.span_id AND x.kind = 'Client')")
_s("t13_not_child_spans", lambda s: st.not_child_spans(s.where(_FAILED), s.where(_SENT)), f"SELECT trace_id, span_id FROM spans y WHERE kind = 'Producer' AND EXISTS (SELECT 1 FROM spans x WHERE x.trace_id = y.trace_id AND x.span_id <> y.span_id AND x.span_id <> y.parent_span_id AND {_A})")
_s("t13_not_descendant", lambda s: st.not_descendant_spans(s, _FAILED, "kind = 'Client'"), f"SELECT y.trace_id, y.span_id FROM spans y JOIN (SELECT trace_id, count(*) AS marks FROM spans x WHERE {_A} GROUP BY 1) m ON m.trace_id = y.trace_id LEFT JOIN (SELECT up.trace_id, b, count(*) AS above FROM up JOIN spans x ON x.trace_id = up.trace_id AND x.span_id = a WHERE {_A} GROUP BY 1, 2) u ON u.trace_id = y.trace_id AND u.b = y.span_id WHERE y.kind = 'Client' AND m.marks > coalesce(above, 0)", _UP, recursive=True)
_PATH = "pa AS (SELECT trace_id, span_id, parent_span_id, [(start_us, span_id)] AS p, 0 AS d FROM spans WHERE parent_span_id = '' UNION ALL SELECT s.trace_id, s.span_id, s.parent_span_id, list_append(pa.p, (s.start_us, s.span_id)), pa.d + 1 FROM pa JOIN spans s ON s.trace_id = pa.trace_id AND s.parent_span_id = pa.span_id)"
_NEST = "ns AS (SELECT trace_id, span_id, parent_span_id, 2 * row_number() OVER (PARTITION BY trace_id ORDER BY p) - 1 - d AS lft, d, (SELECT count(*) FROM up WHERE up.trace_id = pa.trace_id AND up.a = pa.span_id) + 1 AS s FROM pa)"
_s("t15_nested_sets", lambda s: st.nested_sets(s), "SELECT n.trace_id, n.span_id, n.lft, n.lft + 2 * n.s - 1 AS rgt, coalesce(q.lft, -1) AS parent FROM ns n LEFT JOIN ns q ON q.trace_id = n.trace_id AND q.span_id = n.parent_span_id", _UP, _PATH, _NEST, recursive=True)
_s("t16_select", lambda s: tr.select_fields(s.where(F.col("kind") == "Client"), db=f.attribute("span.db.name"), svc=f.attribute("resource.service.name"), ev=f.attribute("event.db.name"), dur=F.col("dur_us")), "SELECT trace_id, span_id, db_name AS db, service AS svc, CASE WHEN db_system IS NOT NULL THEN db_name END AS ev, dur_us AS dur FROM spans WHERE kind = 'Client'")
_s("t17_count_by", lambda s: tr.count_by(s, _client(), F.col("service")), "SELECT trace_id, service, count(*) AS n FROM spans WHERE kind = 'Client' GROUP BY 1, 2")
_TG = f"g AS (SELECT unnest(range({T0}, {T1}, {TSTEP})) AS t)"
_s("t18_rate", lambda s, a=T0, b=T1: tr.rate_over_time(s, _error(), a, b, TSTEP, "service"), f"SELECT l.service, g.t, count(x.span_id) / {TSTEP / 1e6} AS value FROM g CROSS JOIN (SELECT DISTINCT service FROM spans WHERE status_code = 'Error' AND start_us >= {T0} AND start_us < {T1}) l LEFT JOIN spans x ON x.service = l.service AND x.status_code = 'Error' AND x.start_us >= g.t AND x.start_us < g.t + {TSTEP} GROUP BY 1, 2", _TG)
_s("t19_quantiles", lambda s, a=T0, b=T1: tr.quantiles_over_time(s, _server(), a, b, TSTEP).select("t", "p", F.round("value", 9).alias("value")), f"SELECT t, p, round(v / 1e6, 9) AS value FROM (SELECT (start_us - {T0}) // {TSTEP} * {TSTEP} + {T0} AS t, unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS p, unnest(quantile_cont(dur_us, [0.5, 0.95, 0.99])) AS v FROM spans WHERE kind = 'Server' AND start_us >= {T0} AND start_us < {T1} GROUP BY 1)")
_s("t20_histogram", lambda s, a=T0, b=T1: tr.histogram_over_time(s, _server(), a, b, TSTEP), f"SELECT (start_us - {T0}) // {TSTEP} * {TSTEP} + {T0} AS t, pow(2, ceil(log2(dur_us))) / 1e6 AS bucket, count(*) AS n FROM spans WHERE kind = 'Server' AND dur_us > 0 AND start_us >= {T0} AND start_us < {T1} GROUP BY 1, 2")
_s("t21_tag_keys", tr.tag_keys, "SELECT DISTINCT 'span' AS scope, unnest(list_filter([CASE WHEN http_method IS NOT NULL THEN 'http.method' END, CASE WHEN db_system IS NOT NULL THEN 'db.system' END, CASE WHEN db_name IS NOT NULL THEN 'db.name' END, CASE WHEN msg_system IS NOT NULL THEN 'messaging.system' END, CASE WHEN msg_size IS NOT NULL THEN 'messaging.destination.name' END, CASE WHEN msg_size IS NOT NULL THEN 'messaging.message.body.size' END], lambda x: x IS NOT NULL)) AS tag FROM spans UNION SELECT 'resource', unnest(['service.name', 'app_id']) UNION SELECT 'event', 'db.name'")
_s("t22_tag_values", lambda s: tr.tag_values(s, f.attribute(".db.name"), F.col("service") == "supplier-2"), "SELECT DISTINCT db_name AS value FROM spans WHERE service = 'supplier-2' AND db_name IS NOT NULL")
_s("t23_roots", tr.roots, "SELECT DISTINCT name, service FROM spans WHERE parent_span_id = ''")
_STATS = "count(*) AS n, sum(dur_us)::BIGINT AS total_us, avg(dur_us) AS avg_us, min(dur_us) AS min_us, max(dur_us) AS max_us, count_if(status_code = 'Error')::BIGINT AS errors, count_if(status_code = 'Error') / count(*) AS error_rate"
_s("t24_service_statistics", lambda s: tr.statistics(s, "service"), f"SELECT trace_id, service, {_STATS} FROM spans GROUP BY 1, 2")
_s("t25_operation_statistics", lambda s: tr.statistics(s, "service", "name"), f"SELECT trace_id, service, name, {_STATS} FROM spans GROUP BY 1, 2, 3")
_PAIR = "SELECT service, name, row_number() OVER (PARTITION BY service, name ORDER BY start_us, span_id) AS nth, dur_us FROM spans WHERE trace_id ="
_one = lambda s, i: s.where(F.col("trace_id") == i)
_s("t26_trace_diff", lambda s: tr.compare(_one(s, "t3"), _one(s, "t9")).withColumn("nth", F.col("nth").cast("long")), f"SELECT service, name, nth, a.dur_us AS dur_a, b.dur_us AS dur_b, CASE WHEN b.dur_us IS NULL THEN 'removed' WHEN a.dur_us IS NULL THEN 'added' ELSE 'matched' END AS state, b.dur_us - a.dur_us AS delta_us FROM ({_PAIR} 't3') a FULL JOIN ({_PAIR} 't9') b USING (service, name, nth)")
_s("t27_service_diff", lambda s: tr.compare_services(_one(s, "t3"), _one(s, "t9")), "SELECT service, n_a, dur_a, n_b, dur_b, CASE WHEN n_b IS NULL THEN 'only_a' WHEN n_a IS NULL THEN 'only_b' ELSE 'both' END AS state FROM (SELECT service, count(*) AS n_a, sum(dur_us)::BIGINT AS dur_a FROM spans WHERE trace_id = 't3' GROUP BY 1) FULL JOIN (SELECT service, count(*) AS n_b, sum(dur_us)::BIGINT AS dur_b FROM spans WHERE trace_id = 't9' GROUP BY 1) USING (service)")
_s("t28_tree_rows", lambda s: st.tree_rows(s), "SELECT s.trace_id, s.span_id, (start_us - lo) * 100 / greatest(hi - lo, 1) AS offset_pct, dur_us * 100 / greatest(hi - lo, 1) AS width_pct, coalesce(u.d, 0)::INT AS depth FROM spans s JOIN (SELECT trace_id, min(start_us) AS lo, max(start_us + dur_us) AS hi FROM spans GROUP BY 1) USING (trace_id) LEFT JOIN (SELECT trace_id, b, max(d) AS d FROM up GROUP BY 1, 2) u ON u.trace_id = s.trace_id AND u.b = s.span_id", _UP, recursive=True)
_s("t29_list_items", tr.list_items, "SELECT trace_id, sum(n)::BIGINT AS n_spans, count(*) AS n_services, bool_or(bad) AS has_error, string_agg(service, ',' ORDER BY n DESC, service) AS services FROM (SELECT trace_id, service, count(*) AS n, bool_or(status_code = 'Error') AS bad FROM spans GROUP BY 1, 2) GROUP BY 1")
_s("t30_graph_nodes", tr.graph_nodes, "SELECT trace_id, service, count(*) AS n, count_if(status_code = 'Error')::BIGINT AS errors FROM spans GROUP BY 1, 2")

# metrics
_c("m01_instant", lambda c: m.instant(c, END, None), f"SELECT 'app.events' AS name, {_SERIES} AS series, max(ts_us) AS ts_us, arg_max(value, ts_us) AS value FROM counters WHERE ts_us <= {END} GROUP BY 2")
_B = f"(ts_us - {START}) // {STEP} * {STEP} + {START} AS t"
_IN = f"ts_us >= {START} AND ts_us < {END}"
_r9 = lambda *cs: [F.round(c, 9).alias(c) for c in cs]
_g("m02_range_aggregate", lambda g, a=START, b=END: m.range_aggregate(g, a, b, STEP, "avg", "sum", "max", "min", "count", "stddev", "stdvar", "last", "first", "p50", "p90", "p95", "p99", by=("event_type",)).select("event_type", "t", *_r9("avg", "sum", "max", "min", "count", "stddev", "stdvar", "last", "first", "p50", "p90", "p95", "p99")),
   f"SELECT event_type, {_B}, round(avg(value), 9) AS avg, round(sum(value), 9) AS sum, max(value) AS max, min(value) AS min, count(*)::DOUBLE AS count, round(stddev_pop(value), 9) AS stddev, round(var_pop(value), 9) AS stdvar, arg_max(value, ts_us) AS last, arg_min(value, ts_us) AS first, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM gauges WHERE {_IN} GROUP BY 1, 2")
_g("m03_missing_labels", lambda g, a=START, b=END: m.range_aggregate(g.withColumn("labels", F.when(F.col("labels")["shard"] == "1", F.map_filter("labels", lambda k, v: k != "shard")).otherwise(F.col("labels"))), a, b, STEP, "count", by=("shard",), keep_missing=True), f"SELECT nullif(shard, '1') AS shard, {_B}, count(*)::DOUBLE AS count FROM gauges WHERE {_IN} GROUP BY 1, 2")
_FG = f"p AS (SELECT event_type, (ts_us - {START}) // {HOUR} * {HOUR} + {START} AS t, max(value) AS v FROM gauges WHERE {_IN} AND shard = '1' GROUP BY 1, 2), gr AS (SELECT event_type, unnest(range({START}, {END}, {HOUR})) AS t FROM (SELECT DISTINCT event_type FROM p)), fl AS (SELECT gr.event_type, gr.t, v, CASE WHEN v IS NOT NULL THEN gr.t END AS held FROM gr LEFT JOIN p ON p.event_type = gr.event_type AND p.t = gr.t)"
_hourly = lambda g: m.range_aggregate(g.where(F.col("labels")["shard"] == "1"), START, END, HOUR, "max", by=("event_type",)).withColumnRenamed("max", "value")
_g("m04_fill_zero", lambda g: m.fill(_hourly(g), ["event_type"], START, END, HOUR, "0"), "SELECT event_type, t, coalesce(v, 0) AS value FROM fl", _FG)
_g("m04_fill_previous", lambda g: m.fill(_hourly(g), ["event_type"], START, END, HOUR, "previous"), "SELECT event_type, t, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t) AS value FROM fl", _FG)
_g("m04_fill_linear", lambda g: m.fill(_hourly(g), ["event_type"], START, END, HOUR, "linear").withColumn("value", F.round("value", 9)), "SELECT event_type, t, round(coalesce(v, v0 + (v1 - v0) * (t - t0) / (t1 - t0)), 9) AS value FROM (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(held IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(held IGNORE NULLS) OVER a AS t1 FROM fl WINDOW b AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", _FG)
_c("m06_raw", lambda c, a=START, b=START + DAY: m.raw(c, a, b), f"SELECT 'app.events' AS name, {_SERIES} AS series, ts_us, value FROM counters WHERE ts_us BETWEEN {START} AND {START + DAY}")
_g("m07_density", lambda g: m.density(g, HOUR), f"SELECT ts_us // {HOUR} * {HOUR} AS t, count(*) AS n FROM gauges GROUP BY 1")
_RT = f"""w AS (SELECT {_SERIES} AS series, ts_us, value, lag(ts_us) OVER k AS pt, lag(value) OVER k AS pv, lead(ts_us) OVER k AS nt, lead(value) OVER k AS nv FROM counters WINDOW k AS (PARTITION BY event_type, shard ORDER BY ts_us)),
st AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS t),
x AS (SELECT *, CASE WHEN value < pv THEN pv ELSE 0 END AS reset, row_number() OVER (PARTITION BY series, t ORDER BY ts_us) AS i FROM w JOIN st ON ts_us BETWEEN t - {RANGE} AND t),
g AS (SELECT series, t, count(*) AS n, arg_min(value, ts_us) AS v0, arg_max(value, ts_us) AS v1, min(ts_us) AS t0, max(ts_us) AS t1, sum(CASE WHEN i > 1 THEN reset ELSE 0 END) AS resets, arg_min(coalesce(pt, -1), ts_us) AS p0t, arg_min(coalesce(pv, -1), ts_us) AS p0v, arg_min(coalesce(nt, -1), ts_us) AS n0t, arg_min(coalesce(nv, -1), ts_us) AS n0v, arg_max(coalesce(pt, -1), ts_us) AS p1t, arg_max(coalesce(pv, -1), ts_us) AS p1v, regr_slope(value, (ts_us - {START}) / 1e6) AS slope, avg(value) AS av, min(value) AS mi, max(value) AS ma, sum(value) AS su FROM x GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n > 1 THEN greatest(v1 - v0 + resets, 0) WHEN p0t >= 0 THEN v0 - p0v + CASE WHEN v0 < p0v THEN p0v ELSE 0 END WHEN n0t >= 0 THEN n0v - v0 + CASE WHEN n0v < v0 THEN v0 ELSE 0 END END AS inc, CASE WHEN n > 1 THEN t1 - t0 WHEN p0t >= 0 THEN t0 - p0t ELSE n0t - t0 END / 1e6 AS span FROM g),
q AS (SELECT *, CASE WHEN span > 0 THEN inc / span * greatest({RANGE / 1e6} / span, 1) END AS rate FROM r)"""
_rates = lambda c, a=START, b=END: m.rates(c, a, b, STEP, RANGE)
_c("m08_rate", lambda c, a=START, b=END: _rates(c, a, b).select("series", "t", "n", *_r9("rate")), "SELECT series, t, n, round(rate, 9) AS rate FROM q", _RT)
_c("m09_increase", lambda c, a=START, b=END: _rates(c, a, b).select("series", "t", "increase"), "SELECT series, t, inc AS increase FROM q", _RT)
_c("m10_irate", lambda c, a=START, b=END: _rates(c, a, b).select("series", "t", *_r9("irate")), "SELECT series, t, round(CASE WHEN n > 1 THEN (v1 - p1v) / ((t1 - p1t) / 1e6) END, 9) AS irate FROM q", _RT)
_c("m11_rate_instant", lambda c: m.rates(c, END, END, STEP, RANGE).select("series", *_r9("rate")), f"SELECT series, round(rate, 9) AS rate FROM q WHERE t = {END}", _RT)
_c("m12_vector_aggregate", lambda c: m.across(m.instant(c, END, None).withColumn("kind", F.substring_index("series", ",", 1)), "sum", by=("kind",), at=()), f"SELECT 'event_type=' || event_type AS kind, sum(v) AS value FROM (SELECT event_type, shard, arg_max(value, ts_us) AS v FROM counters WHERE ts_us <= {END} GROUP BY 1, 2) GROUP BY 1")
_c("m13_matrix_aggregate", lambda c, a=START, b=END: m.across(_rates(c, a, b), "max", "increase"), "SELECT t, max(inc) AS value FROM q GROUP BY 1", _RT)
_c("m13_without", lambda c, a=START, b=END: m.across(_rates(c, a, b).withColumn("event_type", F.substring_index("series", ",", 1)).withColumn("shard", F.substring_index("series", ",", -1)), "sum", "increase", without=("shard",), labels=("event_type", "shard")), "SELECT split_part(series, ',', 1) AS event_type, t, sum(inc) AS value FROM q GROUP BY 1, 2", _RT)
_c("m14_topk", lambda c: m.top(m.instant(c, END, None).select("series", "value"), 7), f"SELECT {_SERIES} AS series, arg_max(value, ts_us) AS value FROM counters WHERE ts_us <= {END} GROUP BY 1 ORDER BY value DESC, series LIMIT 7")
_c("m15_topk_range", lambda c, a=START, b=END: m.top_series(_rates(c, a, b).select("series", "t", F.col("increase").alias("value")), 5), "SELECT series, t, inc AS value FROM q WHERE series IN (SELECT series FROM q GROUP BY 1 ORDER BY max(inc) DESC, series LIMIT 5)", _RT)
_UN = "u AS (SELECT event_type, ts_us, unnest(range(0, 7)) AS pos, unnest([5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le, unnest(bucket_counts) AS n, value, cnt FROM hist)"
_QT = "hs AS (SELECT {k}, pos, le, sum(n) AS n FROM {u} WHERE pos < 6 GROUP BY {k}, pos, le), hm AS (SELECT {k}, sum(value) AS total, sum(cnt) AS points FROM {h} GROUP BY {k}), hc AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY pos) AS upto, coalesce(lag(le) OVER (PARTITION BY {k} ORDER BY pos), 0) AS low FROM hs JOIN hm USING ({k})), hh AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY pos) AS i FROM hc WHERE upto >= 0.9::DOUBLE * points AND n > 0)"
_SEL = "SELECT {k}, round(CASE WHEN points = 0 THEN 0 WHEN i IS NULL THEN total / points ELSE low + (le - low) * (0.9::DOUBLE * points - (upto - n)) / n END, 9) AS value FROM hm LEFT JOIN (SELECT {k}, i, low, le, upto, n FROM hh WHERE i = 1) USING ({k})"
_h("m16_quantile", lambda x: h.quantile(x, 0.9, "event_type").withColumn("value", F.round("value", 9)), _SEL.format(k="event_type"), _UN, _QT.format(k="event_type", u="u", h="hist"))
_HS = f"st AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS t), us AS (SELECT u.*, t FROM u JOIN st ON ts_us BETWEEN t - {RANGE} AND t), hst AS (SELECT hist.*, t FROM hist JOIN st ON ts_us BETWEEN t - {RANGE} AND t)"
_h("m17_quantile_range", lambda x, a=START, b=END: h.quantile_over_time(x, 0.9, a, b, STEP, RANGE, "event_type").withColumn("value", F.round("value", 9)), _SEL.format(k="event_type, t"), _UN, _HS, _QT.format(k="event_type, t", u="us", h="hst"))
_h("m18_heatmap", lambda x, a=START, b=END: h.heatmap(x, a, b, STEP, RANGE, "event_type").withColumn("value", F.round("value", 9)), f"SELECT event_type, t, le, round(sum(sum(n)) OVER (PARTITION BY event_type, t ORDER BY pos) / {RANGE / 1e6}, 9) AS value FROM us GROUP BY event_type, t, le, pos", _UN, _HS)
_h("m19_snapshots", lambda x: h.snapshots(x, "count", START, END, STEP, "event_type"), "SELECT event_type, t, sum(cnt)::DOUBLE AS value FROM hist JOIN st ON ts_us <= t GROUP BY 1, 2", f"st AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS t)")
_h("m20_expand", lambda x: h.expand(x, "event_type"), "SELECT event_type, ts_us, le, sum(n) OVER (PARTITION BY event_type, ts_us ORDER BY pos)::BIGINT AS value FROM u", _UN)
_h("m21_merge", lambda x: h.merge(x, "event_type").select("event_type", F.array_join(F.transform("bucket_counts", lambda c: c.cast("string")), ",").alias("counts"), F.size("explicit_bounds").alias("n_bounds")), "SELECT event_type, string_agg(n::VARCHAR, ',' ORDER BY pos) AS counts, 6 AS n_bounds FROM (SELECT event_type, pos, sum(n)::BIGINT AS n FROM u GROUP BY 1, 2) GROUP BY 1", _UN)
_g("m22_label_combinations", lambda g: m.label_combinations(g, "event_type", "shard"), "SELECT DISTINCT event_type, shard FROM gauges")
_g("m23_names", m.names, "SELECT DISTINCT 'app.value' AS name FROM gauges")
_g("m24_label_names", lambda g: m.label_names(g, "app.value"), "SELECT DISTINCT unnest(['event_type', 'shard']) AS label FROM gauges")
_g("m25_label_values", lambda g: m.label_values(g, "event_type", "app.value"), "SELECT DISTINCT event_type AS value FROM gauges")
_c("m26_series", lambda c: m.series_list(c.where(F.col("labels")["event_type"] == "click"), c.where(F.col("labels")["shard"] == "2")), f"SELECT DISTINCT 'app.events' AS name, {_SERIES} AS series FROM counters WHERE event_type = 'click' OR shard = '2'")
_c("m27_metadata", m.metadata, "SELECT DISTINCT 'app.events' AS name, 'counter' AS type, 'none' AS unit FROM counters")
_s("m28_exemplars", tr.newest_trace_per_service, "SELECT service, arg_max(trace_id, (start_us, trace_id)) AS trace_id, max(start_us) AS start_us FROM spans GROUP BY 1")
_g("m29_downsample", lambda g, a=START, b=END: m.downsample(g, a, b, STEP, "mean", ("event_type",), "0").withColumn("value", F.round("value", 9)), f"SELECT e.event_type, s.t, round(coalesce(v, 0), 9) AS value FROM (SELECT DISTINCT event_type FROM gauges WHERE {_IN}) e CROSS JOIN (SELECT unnest(range({START}, {END}, {STEP})) AS t) s LEFT JOIN (SELECT event_type, {_B}, avg(value) AS v FROM gauges WHERE {_IN} GROUP BY 1, 2) x ON x.event_type = e.event_type AND x.t = s.t")
_c("m31_arithmetic", lambda c, a=START, b=END: m.arithmetic_of(_rates(c, a, b), "increase", "n", "/").select("series", "t", F.round("value", 9).alias("value")), "SELECT series, t, round(inc / n, 9) AS value FROM q", _RT)
_c("m32_delta", lambda c, a=START, b=END: _rates(c, a, b).select("series", "t", "delta", "idelta", F.round("deriv", 7).alias("deriv")), "SELECT series, t, CASE WHEN n > 1 THEN v1 - v0 END AS delta, CASE WHEN n > 1 THEN v1 - p1v END AS idelta, CASE WHEN n > 1 THEN round(slope, 7) END AS deriv FROM q", _RT)
_c("m33_over_time", lambda c, a=START, b=END: _rates(m.offset(c, 0), a, b).select("series", "t", *_r9("avg_over_time"), "min_over_time", "max_over_time", "sum_over_time", "count_over_time", "last_over_time"), "SELECT series, t, round(av, 9) AS avg_over_time, mi AS min_over_time, ma AS max_over_time, su AS sum_over_time, n::DOUBLE AS count_over_time, v1 AS last_over_time FROM q", _RT)
_c("m33_unless", lambda c: m.set_operation(m.instant(c, END, None).select("series", "value"), m.instant(m.offset(c, DAY), END, None).where("value > 1").select("series", "value"), "unless", ("series",)), f"SELECT {_SERIES} AS series, arg_max(value, ts_us) AS value FROM counters WHERE ts_us <= {END} GROUP BY 1 HAVING series NOT IN (SELECT {_SERIES} AS series FROM counters WHERE ts_us <= {END - DAY} GROUP BY 1 HAVING arg_max(value, ts_us) > 1)")
_s("m35_span_metric_series", lambda s: ge.red_metrics(s, TSTEP).groupBy("service", "t").agg(F.sum("calls").alias("calls"), (F.sum("calls") / (TSTEP / 1e6)).alias("rate")), f"SELECT service, start_us // {TSTEP} * {TSTEP} AS t, count(*) AS calls, count(*) / {TSTEP / 1e6} AS rate FROM spans GROUP BY 1, 2")

# rollup and catalogue
_T5 = "ts_us // 300000000 * 300000000 AS t"
_g("r01_rollup_gauge", lambda g: ru.rollup_gauge(g).select("name", "series", "t", *_r9("value", "min", "max", "sum"), "count"), f"SELECT 'app.value' AS name, {_SERIES} AS series, {_T5}, round(avg(value), 9) AS value, min(value) AS min, max(value) AS max, round(sum(value), 9) AS sum, count(*) AS count FROM gauges GROUP BY 2, 3")
_c("r02_rollup_counter", ru.rollup_counter, f"SELECT 'app.events' AS name, {_SERIES} AS series, {_T5}, arg_max(value, ts_us) AS value, arg_min(value, ts_us) AS first, arg_max(value, ts_us) AS last, sum(value) AS sum, count(*) AS count FROM counters GROUP BY 2, 3")
_h("r03_rollup_histogram", lambda x: ru.rollup_histogram(x, DAY).select("series", "t", F.array_join(F.transform("bucket_counts", lambda c: c.cast("string")), ",").alias("counts")), f"SELECT 'event_type=' || event_type AS series, t, string_agg(n::VARCHAR, ',' ORDER BY pos) AS counts FROM (SELECT event_type, ts_us // {DAY} * {DAY} AS t, pos, sum(n)::BIGINT AS n FROM u GROUP BY 1, 2, 3) GROUP BY 1, 2", _UN)
_g("r04_ready_hours", lambda g: ru.ready_hours(g, g.where(F.col("ts_us") < START).select("app_id", time_bucket(F.col("ts_us"), HOUR).alias("hour")).distinct(), END), f"SELECT DISTINCT app_id, ts_us // {HOUR} * {HOUR} AS hour FROM gauges WHERE ts_us // {HOUR} * {HOUR} + {3 * HOUR} <= {END} AND ts_us >= {START}")
_g("r04_watermark", lambda g: ru.watermark(g.select("app_id", time_bucket(F.col("ts_us"), HOUR).alias("hour"))), f"SELECT app_id, max(hour) AS watermark FROM (SELECT app_id, hour, hour - (row_number() OVER (PARTITION BY app_id ORDER BY hour) - 1) * {HOUR} AS run, min(hour) OVER (PARTITION BY app_id) AS fst FROM (SELECT DISTINCT app_id, ts_us // {HOUR} * {HOUR} AS hour FROM gauges)) WHERE run = fst GROUP BY 1")
_g("r05_merged_tiers", lambda g: ru.tiered(m.with_series(g).select("series", "ts_us", "value"), ru.rollup_gauge(g).select("series", F.col("t").alias("ts_us"), "value"), START).groupBy("series", "tier").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last"), F.round(F.sum("value"), 3).alias("v")),
   f"SELECT {_SERIES} AS series, '5m' AS tier, count(*) AS n, max(t) AS last, round(sum(v), 3) AS v FROM (SELECT event_type, shard, ts_us // 300000000 * 300000000 AS t, avg(value) AS v FROM gauges GROUP BY ALL) WHERE t < {START} GROUP BY 1 UNION ALL SELECT {_SERIES}, 'raw', count(*), max(ts_us), round(sum(value), 3) FROM gauges WHERE ts_us >= {START} GROUP BY 1")
_flat = lambda c: c.select("app_id", "name", "type", "unit", F.array_join("label_keys", ",").alias("label_keys"), F.array_join("services", ",").alias("services"), "last_seen", "n")
_CAT = "SELECT app_id, 'app.value' AS name, 'gauge' AS type, '' AS unit, 'event_type,shard' AS label_keys, string_agg(DISTINCT service, ',' ORDER BY service) AS services, max(ts_us) AS last_seen, count(*) AS n FROM gauges GROUP BY 1"
_g("r06_catalog_upsert", lambda g: _flat(ru.upsert_catalog(ru.catalog(g.where(F.col("ts_us") < START)), ru.catalog(g.where(F.col("ts_us") >= START)))), _CAT)
_g("r07_prune_catalog", lambda g: _flat(ru.prune_catalog(ru.catalog(g), END)), f"SELECT * FROM ({_CAT}) WHERE last_seen >= {END}")

# logs
_l("l01_search", lambda x: lg.search(x, F.col("severity") == "ERROR", 40, 3).select("log_id", "ts_us", "body", "total"), "SELECT log_id, ts_us, body, count(*) OVER () AS total FROM logs WHERE severity = 'ERROR' ORDER BY ts_us DESC, log_id DESC LIMIT 40 OFFSET 3")
_l("l02_any_search", lambda x: lg.any_search(x.where(f.line_filter("|=", "click")), x.where(F.col("service") == "svc-1"), limit=60).select("ts_us", "body"), "SELECT DISTINCT ts_us, body FROM logs WHERE event_type = 'click' OR service = 'svc-1' ORDER BY ts_us DESC, body LIMIT 60")
_l("l03_context", lambda x: lg.context(x, 500, 6, 4).select("log_id", "ts_us"), "SELECT log_id, ts_us FROM (SELECT *, row_number() OVER (ORDER BY ts_us, log_id) AS i FROM logs WHERE service = (SELECT service FROM logs WHERE log_id = 500)) WHERE i BETWEEN (SELECT i - 6 FROM (SELECT log_id, row_number() OVER (ORDER BY ts_us, log_id) AS i FROM logs WHERE service = (SELECT service FROM logs WHERE log_id = 500)) WHERE log_id = 500) AND (SELECT i + 4 FROM (SELECT log_id, row_number() OVER (ORDER BY ts_us, log_id) AS i FROM logs WHERE service = (SELECT service FROM logs WHERE log_id = 500)) WHERE log_id = 500)")
_l("l04_statistics", lambda x: lg.statistics(x, DAY), f"SELECT 'total' AS facet, '' AS key, count(*) AS n FROM logs UNION ALL SELECT 'severity', severity, count(*) FROM logs GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM logs GROUP BY 2 UNION ALL SELECT 'time', (ts_us // {DAY} * {DAY})::VARCHAR, count(*) FROM logs GROUP BY 2")
_l("l05_count_over_time", lambda x, a=START, b=END: lg.count_over_time(x, a, b, STEP, "service", top=4), f"SELECT service, {_B}, count(*) AS n FROM logs WHERE {_IN} AND service IN (SELECT service FROM logs WHERE {_IN} GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 4) GROUP BY 1, 2")
_l("l06_rates", lambda x, a=START, b=END: lg.rates(x, a, b, STEP, "severity"), f"SELECT severity, {_B}, count(*) AS n, count(*) / {STEP / 1e6} AS rate, sum(strlen(body))::BIGINT AS n_bytes, sum(strlen(body)) / {STEP / 1e6} AS bytes_rate FROM logs WHERE {_IN} GROUP BY 1, 2")
_l("l07_outer_aggregate", lambda x, a=START, b=END: m.across(lg.count_over_time(x, a, b, STEP, "service", "severity"), "max", "n", by=("severity",)).withColumn("value", F.col("value").cast("long")), f"SELECT severity, t, max(n) AS value FROM (SELECT severity, service, {_B}, count(*) AS n FROM logs WHERE {_IN} GROUP BY 1, 2, 3) GROUP BY 1, 2")
_l("l08_instant", lambda x: lg.instant_count(x, END, HOUR, "severity"), f"SELECT severity, count(*) AS n FROM logs WHERE ts_us > {END - HOUR} AND ts_us <= {END} GROUP BY 1")
_l("l09_merge_results", lambda x, a=START, b=END: lg.merge_results(lg.count_over_time(x.where(F.col("severity") == "ERROR"), a, b, STEP, "service"), lg.count_over_time(x.where(F.col("severity") == "WARN"), a, b, STEP, "service"), by=("service",)), f"SELECT service, {_B}, count(*) AS n FROM logs WHERE {_IN} AND severity IN ('ERROR', 'WARN') GROUP BY 1, 2")
_l("l10_volume", lambda x: lg.volume(x, "service", 5), "SELECT service, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, service LIMIT 5")
_l("l11_label_values", lambda x: lg.label_values(x, "severity"), "SELECT DISTINCT severity AS value FROM logs")
_l("l12_json_fields", lambda x: x.select("log_id", lg.json_fields(F.col("json_body"))["k"].alias("k")), "SELECT log_id, json_extract_string(props, '$.k') AS k FROM logs")
_l("l13_logfmt_fields", lambda x: x.withColumn("x", lg.logfmt_fields(F.col("body"))).select("log_id", F.col("x")["event"].alias("event"), F.col("x")["user"].alias("usr"), F.col("x")["cents"].alias("cents")), "SELECT log_id, event_type AS event, user_id::VARCHAR AS usr, cents::VARCHAR AS cents FROM logs")
_l("l14_unpack", lambda x: x.select("log_id", F.coalesce(lg.unpack(F.when(F.col("log_id") % 2 == 0, F.col("json_body")).otherwise(F.col("body")))["k"], lg.unpack(F.col("body"))["event"]).alias("v")), "SELECT log_id, CASE WHEN log_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type END AS v FROM logs")
_l("l15_line_format", lambda x: lg.line_format(x, "{{.event}}/{{ .user }}", lg.logfmt_fields(F.col("body"))).select("log_id", "line"), "SELECT log_id, event_type || '/' || user_id AS line FROM logs")
_l("l16_contains_flag", lambda x: lg.contains_flag(x, "is_click", "event=click").where("is_click").select("log_id"), "SELECT log_id FROM logs WHERE event_type = 'click'")
_l("l17_detected_fields", lg.detected_fields, "SELECT 'event_type' AS field, 'string' AS kind, count(DISTINCT event_type) AS cardinality FROM logs UNION ALL SELECT 'user_id', 'number', count(DISTINCT user_id) FROM logs")
_l("l18_field_counts", lambda x: lg.field_counts(x, "severity", "service"), "SELECT 'severity' AS field, severity AS value, count(*) AS n FROM logs GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM logs GROUP BY 2")
_l("l19_streams", lambda x: lg.streams(x, 5).withColumn("nth", F.col("nth").cast("long")), "SELECT service, severity, nth, log_id, ts_us, body FROM (SELECT *, row_number() OVER (PARTITION BY service, severity ORDER BY ts_us DESC, log_id DESC) AS nth FROM logs) WHERE nth <= 5")
_add("l20_logs_of_traces", lambda spark, d: lg.of_spans(fx.logs(spark, d), fx.spans(spark, d).where(_error())).select("log_id", "trace_id"), "SELECT log_id, trace_id FROM logs WHERE trace_id IN (SELECT trace_id FROM spans WHERE status_code = 'Error')", fx.SPANS_SQL, fx.LOGS_SQL)

# streaming generators, batch form
_counts = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
_BK = " || ',' || ".join(f"count(CASE WHEN dur_us / 1000 > {lo} AND dur_us / 1000 <= {hi} THEN 1 END)" for lo, hi in zip(["'-inf'::DOUBLE", *ge.RED_LATENCY_BOUNDS_MS], ge.RED_LATENCY_BOUNDS_MS))
_s("w01_red_metrics", lambda s: ge.red_metrics(s, DAY).withColumn("bucket_counts", _counts("bucket_counts")), f"SELECT app_id, service, name, kind, status_code, start_us // {DAY} * {DAY} AS t, count(*) AS calls, sum(dur_us)::BIGINT AS latency_us, {_BK} AS bucket_counts FROM spans GROUP BY ALL")
_PEERS = """pe AS MATERIALIZED (SELECT x.*, CASE WHEN x.db_system IS NOT NULL THEN x.db_name WHEN x.kind = 'Producer' THEN 'kafka/orders' WHEN x.kind = 'Client' AND x.msg_system IS NULL THEN s.service WHEN x.kind = 'Server' THEN c.service END AS peer,
 CASE WHEN x.db_system IS NOT NULL THEN 'db_attribute' WHEN x.kind = 'Producer' THEN 'messaging_attribute' WHEN c.service IS NOT NULL THEN 'paired' WHEN s.service IS NOT NULL THEN CASE WHEN x.msg_system IS NULL THEN 'paired' END WHEN x.kind = 'Client' OR (x.kind = 'Server' AND x.parent_span_id <> '') THEN 'expired' END AS peer_source
 FROM spans x LEFT JOIN (SELECT trace_id, parent_span_id, service, start_us FROM spans WHERE kind = 'Server') s ON x.kind = 'Client' AND x.db_system IS NULL AND s.trace_id = x.trace_id AND s.parent_span_id = x.span_id AND abs(s.start_us - x.start_us) < 10000000
 LEFT JOIN (SELECT trace_id, span_id, service, start_us FROM spans WHERE kind = 'Client' AND db_system IS NULL) c ON x.kind = 'Server' AND c.trace_id = x.trace_id AND c.span_id = x.parent_span_id AND abs(c.start_us - x.start_us) < 10000000)"""


def _buckets_sql(value: str, when: str, bounds: tuple[float, ...]) -> str:
    return " || ',' || ".join(f"count(CASE WHEN {when} AND {value} > {lo} AND {value} <= {hi} THEN 1 END)" for lo, hi in zip(["'-inf'::DOUBLE", *bounds], bounds))


_SECONDS = {"client": "kind = 'Client'", "server": "kind = 'Server' AND msg_system IS NULL", "message": "(kind = 'Producer' OR (kind <> 'Client' AND msg_system IS NOT NULL))"}
_HISTOGRAMS = ", ".join([f"sum(CASE WHEN {w} THEN dur_us ELSE 0 END)::BIGINT AS {k}_us, count(CASE WHEN {w} THEN 1 END) AS {k}_n, {_buckets_sql('dur_us / 1e6', w, ge.GRAPH_LATENCY_BOUNDS)} AS {k}_buckets" for k, w in _SECONDS.items()])
_KEPT = ["app_id", "client", "server", "connection", "t", "requests", "failed", *(f"{k}_{x}" for k in _SECONDS for x in ("us", "n")), "message_bytes", "size_n"]
_s("w02_service_graph", lambda s: ge.service_graph(ge.edges(ge.pair_peers(ge.edge_columns(s))), DAY).select(*_KEPT, *(_counts(f"{k}_buckets").alias(f"{k}_buckets") for k in (*_SECONDS, "size"))),
   f"SELECT app_id, CASE WHEN kind = 'Server' THEN peer ELSE service END AS client, CASE WHEN kind = 'Server' THEN service ELSE peer END AS server, CASE WHEN msg_system IS NOT NULL THEN 'messaging_system' WHEN db_system IS NOT NULL OR db_name IS NOT NULL THEN 'database' ELSE 'unset' END AS connection, start_us // {DAY} * {DAY} AS t, count_if(kind <> 'Client')::BIGINT AS requests, count_if(kind <> 'Client' AND status_code = 'Error')::BIGINT AS failed, {_HISTOGRAMS}, sum(CASE WHEN kind <> 'Client' THEN coalesce(msg_size, 0) ELSE 0 END)::BIGINT AS message_bytes, count(CASE WHEN kind <> 'Client' THEN msg_size END) AS size_n, {_buckets_sql('msg_size', "kind <> 'Client'", ge.GRAPH_SIZE_BOUNDS)} AS size_buckets FROM pe WHERE peer IS NOT NULL GROUP BY ALL", _PEERS)
_CALLS = f"cl AS (SELECT service, kind, start_us // {TSTEP} * {TSTEP} AS t, count(*) AS calls FROM spans GROUP BY ALL)"
_calls = lambda s: ge.red_metrics(s, TSTEP).groupBy("service", "kind", "t").agg(F.sum("calls").alias("calls"))
_s("w04_cumulative", lambda s: ge.cumulative(_calls(s), ["service", "kind"], "calls"), "SELECT service, kind, t, sum(calls) OVER (PARTITION BY service, kind ORDER BY t)::BIGINT AS calls FROM cl", _CALLS)
_s("w04_cumulative_idle", lambda s: ge.cumulative(_calls(s), ["service", "kind"], "calls", cycles=1, step_us=TSTEP), "SELECT service, kind, t, sum(calls) OVER (PARTITION BY service, kind, life ORDER BY t)::BIGINT AS calls FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY service, kind ORDER BY t) AS life FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY service, kind ORDER BY t), 0) > " + str(TSTEP) + " AS gap FROM cl))", _CALLS)
_s("w05_evict_stale", lambda s: ge.evict_stale(ge.red_metrics(s, DAY).select("app_id", "service", "name", "t", "calls"), ["app_id", "service", "name"], T1, 5, DAY).groupBy("app_id", "service", "name").agg(F.sum("calls").alias("calls")), f"SELECT app_id, service, name, count(*) AS calls FROM spans GROUP BY 1, 2, 3 HAVING max(start_us // {DAY} * {DAY}) >= {T1 - 5 * DAY}")
_s("w06_limit_series", lambda s: ge.limit_series(_calls(s), ["service", "kind"], 9), "SELECT cl.* FROM cl JOIN (SELECT service, kind, min(t) AS f FROM cl GROUP BY 1, 2 ORDER BY f, service, kind LIMIT 9) USING (service, kind)", _CALLS)
_s("w07_pair_peers", lambda s: ge.pair_peers(s).select("trace_id", "span_id", "service", "kind", "peer", "peer_source"), "SELECT trace_id, span_id, service, kind, peer, peer_source FROM pe", _PEERS)
_s("w08_database_peer", lambda s: s.where(ge.database_peer().isNotNull()).groupBy(ge.database_peer().alias("peer")).agg(F.count(F.lit(1)).alias("n")), "SELECT db_name AS peer, count(*) AS n FROM spans WHERE db_system IS NOT NULL GROUP BY 1")
_s("w09_messaging_peer", lambda s: s.where(ge.messaging_peer().isNotNull()).groupBy(ge.messaging_peer().alias("peer")).agg(F.count(F.lit(1)).alias("n")), "SELECT 'kafka/orders' AS peer, count(*) AS n FROM spans WHERE kind = 'Producer' GROUP BY 1")
_add("w10_enrich_by_token", lambda spark, d: ge.enrich_by_token(fx.logs(spark, d).select("log_id", F.concat(F.lit("tok"), F.col("attributes")["user_id"].cast("long") % 7).alias("token")), fx.read(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("tok"), "n_nationkey").alias("token"), F.col("n_name").alias("app"))), "SELECT log_id, n_name AS app FROM logs JOIN nation ON n_nationkey = user_id % 7 WHERE n_nationkey < 5", fx.LOGS_SQL)

# retention and usage
_PARTS = f"pt AS (SELECT 'trace' AS signal, app_id, start_us // {DAY} AS day, count(*) AS n_rows FROM spans GROUP BY 2, 3 UNION ALL SELECT 'metric', app_id, ts_us // {DAY}, count(*) FROM gauges GROUP BY 2, 3 UNION ALL SELECT 'log', app_id, ts_us // {DAY}, count(*) FROM logs GROUP BY 2, 3), er AS (SELECT DISTINCT signal, app_id, CASE WHEN signal = 'trace' AND app_id = 'app-1' THEN 3 WHEN signal = 'log' AND app_id = 'app-2' THEN 5 WHEN signal = 'metric' THEN 20 WHEN signal = 'trace' THEN 7 ELSE 14 END AS days, CASE WHEN (signal = 'trace' AND app_id = 'app-1') OR (signal = 'log' AND app_id = 'app-2') THEN 'override' WHEN signal = 'metric' THEN 'default' ELSE 'built-in' END AS origin FROM pt), nd AS (SELECT signal, max(day) AS today FROM pt GROUP BY 1), ex AS (SELECT pt.* FROM pt JOIN er USING (signal, app_id) JOIN nd USING (signal) WHERE day < today - days)"


def _rules(spark: SparkSession, p: DataFrame) -> DataFrame:
    overrides = spark.createDataFrame([("trace", "app-1", 3), ("log", "app-2", 5)], "signal string, app_id string, days int")
    return rt.effective(p, overrides, spark.createDataFrame([("metric", 20)], "signal string, days int"))


def _old(spark: SparkSession, p: DataFrame) -> DataFrame:
    return rt.expired(p, _rules(spark, p), p.groupBy("signal").agg(F.max("day").alias("today")))


def _p(name: str, build, sql: str) -> None:
    _add(name, lambda spark, d: build(spark, fx.partitions(spark, d)), sql, fx.SPANS_SQL, fx.GAUGES_SQL, fx.LOGS_SQL, _PARTS)


_p("x01_effective_retention", _rules, "SELECT signal, app_id, days, origin FROM er")
_p("x02_expired_partitions", _old, "SELECT signal, app_id, day, n_rows, n_rows * 100 AS n_bytes FROM ex")
_p("x03_purge_estimate", lambda spark, p: rt.purge_estimate(_old(spark, p)), "SELECT signal, app_id, count(*) AS n_partitions, sum(n_rows)::BIGINT AS n_rows FROM ex GROUP BY 1, 2")
_p("x04_boundary", lambda spark, p: rt.boundary(p), "SELECT signal, min(day) AS oldest, max(day) AS newest, false AS is_empty FROM pt GROUP BY 1")
_USE = "SELECT signal, app_id, n_bytes, CASE WHEN n_bytes / 4000000 >= 0.9 THEN 'critical' WHEN n_bytes / 4000000 >= 0.75 THEN 'warning' ELSE 'ok' END AS alert FROM (SELECT '*' AS signal, '*' AS app_id, sum(n_rows)::BIGINT * 100 AS n_bytes FROM pt UNION ALL SELECT signal, '*', sum(n_rows)::BIGINT * 100 FROM pt GROUP BY 1 UNION ALL SELECT '*', app_id, sum(n_rows)::BIGINT * 100 FROM pt GROUP BY 2)"
_p("x05_usage", lambda spark, p: rt.usage(p, 4_000_000), _USE)
_p("x06_daily", lambda spark, p: rt.daily(p, 0, START // DAY + 30), "SELECT day, coalesce(sum(n_rows) FILTER (signal = 'trace'), 0)::BIGINT * 100 AS trace_bytes, coalesce(sum(n_rows) FILTER (signal = 'metric'), 0)::BIGINT * 100 AS metric_bytes, coalesce(sum(n_rows) FILTER (signal = 'log'), 0)::BIGINT * 100 AS log_bytes FROM pt GROUP BY 1")


# queries over a range take whole tables: from the step of the least time to the step after the greatest one
_SOURCES = {
    "s": (fx.spans, "spans", fx.SPANS_SQL), "g": (fx.gauges, "gauges", fx.GAUGES_SQL), "c": (lambda spark, d: m.with_series(fx.counters(spark, d)), "counters", fx.COUNTERS_SQL),
    "h": (lambda spark, d: fx.histograms(spark, d).withColumn("event_type", F.col("labels")["event_type"]), "hist", fx.HISTOGRAMS_SQL), "l": (fx.logs, "logs", fx.LOGS_SQL),
}


def whole_range(rows: DataFrame, at: str, step: int) -> tuple[int, int]:
    """Start and end of the steps that cover a table; the start of the epoch for an empty one."""
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    return ((lo or 0) // step * step, (hi or 0) // step * step + step)


def _whole(name: str, source: str, build, sql: str) -> None:
    """``sql`` names its start and end as {lo} and {hi}."""
    read, table, table_sql = _SOURCES[source]
    at, step = ("start_us", TSTEP) if source == "s" else ("ts_us", STEP)

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = read(spark, d)
        return build(rows, *whole_range(rows, at, step))

    bounds = f"{table_sql}, bounds AS (SELECT coalesce(min({at}), 0) // {step} * {step} AS lo, coalesce(max({at}), 0) // {step} * {step} + {step} AS hi FROM {table})"
    _QUERIES[name] = run
    _SQL[name] = sql.replace(table_sql, bounds).replace("{lo}", "(SELECT lo FROM bounds)").replace("{hi}", "(SELECT hi FROM bounds)")


for _name, (_source, _build) in _RANGED.items():
    _ends = (T0, T1) if _source == "s" else (START, START + DAY) if _name == "m06_raw" else (START, END)
    _whole(_name, _source, _build, _SQL[_name].replace(str(_ends[0]), "{lo}").replace(str(_ends[1]), "{hi}"))

_K = ["event_type", "shard"]
_FW = f"WITH {fx.GAUGES_SQL}, p AS (SELECT event_type, shard, (ts_us - {{lo}}) // {HOUR} * {HOUR} + {{lo}} AS t, max(value) AS v FROM gauges GROUP BY ALL), gr AS (SELECT event_type, shard, unnest(range({{lo}}, {{hi}}, {HOUR})) AS t FROM (SELECT DISTINCT event_type, shard FROM p)), fl AS (SELECT gr.*, v, CASE WHEN v IS NOT NULL THEN gr.t END AS held FROM gr LEFT JOIN p USING (event_type, shard, t)) "
_hours = lambda g, a, b, how: m.fill(m.range_aggregate(g, a, b, HOUR, "max", by=("event_type", "shard")).withColumnRenamed("max", "value"), _K, a, b, HOUR, how)
_whole("m04_fill_zero", "g", lambda g, a, b: _hours(g, a, b, "0"), _FW + "SELECT event_type, shard, t, coalesce(v, 0) AS value FROM fl")
_whole("m04_fill_previous", "g", lambda g, a, b: _hours(g, a, b, "previous"), _FW + "SELECT event_type, shard, t, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type, shard ORDER BY t) AS value FROM fl")
_whole("m04_fill_linear", "g", lambda g, a, b: _hours(g, a, b, "linear").withColumn("value", F.round("value", 9)), _FW + "SELECT event_type, shard, t, round(coalesce(v, v0 + (v1 - v0) * (t - t0) / (t1 - t0)), 9) AS value FROM (SELECT *, last_value(v IGNORE NULLS) OVER o AS v0, last_value(held IGNORE NULLS) OVER o AS t0, first_value(v IGNORE NULLS) OVER n AS v1, first_value(held IGNORE NULLS) OVER n AS t1 FROM fl WINDOW o AS (PARTITION BY event_type, shard ORDER BY t), n AS (PARTITION BY event_type, shard ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | ingest.QUERIES | series.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | ingest.SQL | series.SQL
