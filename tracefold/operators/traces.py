"""Trace search, summaries, services, dependencies, statistics and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dealing import dealt
from .filters import is_root


def _root_order() -> Column:
    """A trace's root: its root span, else its earliest one."""
    return F.struct((~is_root()).alias("inner"), "start_us", "span_id")


def search(spans: DataFrame, condition: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest traces with a matching span, with the number of all matching traces; page and number come from one shuffle of one scan."""
    found = spans.where(condition).groupBy("trace_id").agg(F.max("start_us").alias("last_us"))
    total = found.agg(F.count("last_us").alias("total"))
    return found.orderBy(F.desc("last_us"), "trace_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def summaries(spans: DataFrame, condition: Column, per_trace: int = 3) -> DataFrame:
    """Per matching trace: root name and service, start, duration in ms, span count and its first matching spans."""
    per_trace = max(1, min(100, per_trace))
    hits = spans.where(condition).withColumn("nth", F.row_number().over(W.partitionBy("trace_id").orderBy("start_us", "span_id"))).where(F.col("nth") <= per_trace)
    hits = hits.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("nth", "span_id"))).alias("s")).select("trace_id", F.col("s.span_id").alias("matched"))
    whole = spans.groupBy("trace_id").agg(
        F.min_by("name", _root_order()).alias("root_name"), F.min_by("service", _root_order()).alias("root_service"), F.min("start_us").alias("start_us"), ((F.max("end_us") - F.min("start_us")) / 1000).alias("duration_ms"), F.count(F.lit(1)).alias("n_spans")
    )
    return whole.join(hits, "trace_id")


def spans_of_matching(spans: DataFrame, condition: Column) -> DataFrame:
    """All spans of the traces with a matching span. The spans are read and dealt once; each trace is looked through twice where it stands."""
    x = dealt(spans.where("trace_id is not null").withColumn("__hit", condition), "trace_id")
    return x.withColumn("__hit", F.bool_or("__hit").over(W.partitionBy("trace_id"))).where("__hit").drop("__hit")


def by_id(spans: DataFrame, *trace_ids: str) -> DataFrame:
    return spans.where(F.col("trace_id").isin(*trace_ids)).orderBy("trace_id", "start_us", "span_id")


def durations(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg((F.max("end_us") - F.min("start_us")).alias("duration_us"))


def services(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service").agg(F.count(F.lit(1)).alias("n_spans"))


def operations(spans: DataFrame, service: str) -> DataFrame:
    return spans.where(F.col("service") == service).select("name", "kind").distinct()


def dependencies(spans: DataFrame) -> DataFrame:
    """Calls from one service to another, from parent and child spans."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("parent"))
    child = spans.select("trace_id", "parent_span_id", F.col("service").alias("child"))
    return child.join(parent, ["trace_id", "parent_span_id"]).where("parent <> child").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("calls"))


def co_occurrence(spans: DataFrame) -> DataFrame:
    """Traces per unordered pair of services; pairs come from each trace's own short list of services."""
    per = spans.groupBy("trace_id").agg(F.sort_array(F.collect_set("service")).alias("s"))
    pairs = per.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("service_a"), F.col("p.b").alias("service_b")).agg(F.count(F.lit(1)).alias("n_traces"))


def select_fields(spans: DataFrame, **fields: Column) -> DataFrame:
    return spans.select("trace_id", "span_id", *(c.alias(n) for n, c in fields.items()))


def count_by(spans: DataFrame, condition: Column, *by: Column) -> DataFrame:
    return spans.where(condition).groupBy("trace_id", *by).agg(F.count(F.lit(1)).alias("n"))


def _steps(df: DataFrame, start: int, end: int, step: int) -> Column:
    return F.floor((F.col("start_us") - start) / step) * step + start


def rate_over_time(spans: DataFrame, condition: Column, start: int, end: int, step: int, *by: str, per_second: bool = True) -> DataFrame:
    """Matching spans per step and labels; steps without spans are 0."""
    hits = spans.where(condition & (F.col("start_us") >= start) & (F.col("start_us") < end)).groupBy(*by, _steps(spans, start, end, step).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    labels = hits.select(*by).distinct() if by else spans.sparkSession.range(1).select()
    grid = labels.withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(step))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(hits, [*by, "t"], "left").select(*by, "t", (n / (step / 1e6) if per_second else n).alias("value"))


def quantiles_over_time(spans: DataFrame, condition: Column, start: int, end: int, step: int, quantiles=(0.5, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """One series per quantile of the duration in seconds."""
    q = F.array(*[F.lit(x) for x in quantiles])
    value = F.percentile("dur_us", q) if exact else F.percentile_approx("dur_us", q)
    x = spans.where(condition & (F.col("start_us") >= start) & (F.col("start_us") < end)).groupBy(_steps(spans, start, end, step).alias("t")).agg(value.alias("v"))
    return x.select("t", F.explode(F.arrays_zip(q.alias("p"), F.col("v"))).alias("z")).select("t", F.col("z.p").alias("p"), (F.col("z.v") / 1e6).alias("value"))


def histogram_over_time(spans: DataFrame, condition: Column, start: int, end: int, step: int) -> DataFrame:
    """Spans per step and power-of-two duration bucket; the bucket is its upper bound in seconds."""
    x = spans.where(condition & (F.col("dur_us") > 0) & (F.col("start_us") >= start) & (F.col("start_us") < end))
    return x.groupBy(_steps(spans, start, end, step).alias("t"), (F.pow(F.lit(2.0), F.ceil(F.log2("dur_us"))) / 1e6).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def tag_keys(spans: DataFrame) -> DataFrame:
    keys = lambda scope, m: spans.select(F.lit(scope).alias("scope"), F.explode(F.map_keys(m)).alias("tag")).distinct()
    events = spans.select(F.explode("events").alias("e")).select(F.lit("event").alias("scope"), F.explode(F.map_keys("e.attributes")).alias("tag")).distinct()
    return keys("span", "attributes").unionByName(keys("resource", "resource")).unionByName(events)


def tag_values(spans: DataFrame, value: Column, condition: Column) -> DataFrame:
    return spans.where(condition & value.isNotNull()).select(value.alias("value")).distinct()


def roots(spans: DataFrame) -> DataFrame:
    return spans.where(is_root()).select("name", "service").distinct()


def statistics(spans: DataFrame, *by: str) -> DataFrame:
    """Count, total, average, extremes, errors and error rate of durations."""
    errors = F.count_if(F.col("status_code") == "Error")
    return spans.groupBy("trace_id", *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dur_us").alias("total_us"), F.avg("dur_us").alias("avg_us"), F.min("dur_us").alias("min_us"), F.max("dur_us").alias("max_us"), errors.alias("errors"), (errors / F.count(F.lit(1))).alias("error_rate")
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans of two sets paired by service, name and order of start."""
    w = W.partitionBy("service", "name").orderBy("start_us", "span_id")
    side = lambda df, x: df.select("service", "name", F.row_number().over(w).alias("nth"), F.col("dur_us").alias(f"dur_{x}"))
    both = side(a, "a").join(side(b, "b"), ["service", "name", "nth"], "full_outer")
    state = F.when(F.col("dur_b").isNull(), "removed").when(F.col("dur_a").isNull(), "added").otherwise("matched")
    return both.withColumn("state", state).withColumn("delta_us", F.col("dur_b") - F.col("dur_a"))


def compare_services(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda df, x: df.groupBy("service").agg(F.count(F.lit(1)).alias(f"n_{x}"), F.sum("dur_us").alias(f"dur_{x}"))
    both = side(a, "a").join(side(b, "b"), "service", "full_outer")
    return both.withColumn("state", F.when(F.col("n_b").isNull(), "only_a").when(F.col("n_a").isNull(), "only_b").otherwise("both"))


def list_items(spans: DataFrame) -> DataFrame:
    """Per trace: spans, services, errors and services by span count."""
    per = spans.groupBy("trace_id", "service").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status_code") == "Error").alias("bad"))
    return per.groupBy("trace_id").agg(
        F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_services"), F.bool_or("bad").alias("has_error"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "service"))), lambda s: s["service"]), ",").alias("services")
    )


def graph_nodes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id", "service").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") == "Error").alias("errors"))


def newest_trace_per_service(spans: DataFrame) -> DataFrame:
    """Exemplars: the newest trace of each service."""
    return spans.groupBy("service").agg(F.max_by("trace_id", F.struct("start_us", "trace_id")).alias("trace_id"), F.max("start_us").alias("start_us"))


def exemplars(series: DataFrame, spans: DataFrame, metric: str, label: str = "service") -> DataFrame:
    """The newest trace of each service that the series of a metric made from spans names; none for other metrics."""
    named = series.select(F.col(label).alias("service")).where("service <> ''").distinct()
    newest = newest_trace_per_service(spans.where(F.lit(metric.startswith("traces_"))))
    return newest.join(named, "service", "left_semi").select(F.lit(metric).alias("metric"), F.col("service").alias(label), "trace_id", "start_us")
