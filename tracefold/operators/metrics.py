"""Metric selection, aggregation, rates and series arithmetic. Samples are (ts_us, name, value, labels, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import series_key, time_bucket
from .panes import Grid, windows
from .running import running

LOOKBACK = 300_000_000
#: Steps of a chunk of filled values.
FILL_STEPS = 512


def with_series(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series", series_key(F.col("labels")))


def instant(samples: DataFrame, at: int, lookback: int | None = LOOKBACK) -> DataFrame:
    """Newest sample of every series up to ``at``, not older than ``lookback``; None takes the whole history."""
    x = samples.where(F.col("ts_us") <= at)
    if lookback is not None:
        x = x.where(F.col("ts_us") > at - lookback)
    return with_series(x).groupBy("name", "series").agg(F.max("ts_us").alias("ts_us"), F.max_by("value", "ts_us").alias("value"))


AGGREGATES = {
    "avg": lambda v, t: F.avg(v), "sum": lambda v, t: F.sum(v), "max": lambda v, t: F.max(v), "min": lambda v, t: F.min(v), "count": lambda v, t: F.count(v).cast("double"), "stddev": lambda v, t: F.stddev_pop(v), "stdvar": lambda v, t: F.var_pop(v),
    "last": lambda v, t: F.max_by(v, t), "first": lambda v, t: F.min_by(v, t), "p50": lambda v, t: F.percentile(v, 0.5), "p90": lambda v, t: F.percentile(v, 0.9), "p95": lambda v, t: F.percentile(v, 0.95), "p99": lambda v, t: F.percentile(v, 0.99),
}


def range_aggregate(samples: DataFrame, start: int, end: int, step: int, *functions: str, by: tuple[str, ...] = (), keep_missing: bool = False) -> DataFrame:
    """Aggregates per step and labels; rows without a ``by`` label go unless they are kept as null."""
    x = samples.where((F.col("ts_us") >= start) & (F.col("ts_us") < end))
    x = x.select("ts_us", "value", *(F.col("labels")[k].alias(k) for k in by), time_bucket(F.col("ts_us"), step, start).alias("t"))
    if not keep_missing:
        x = x.dropna(subset=list(by)) if by else x
    return x.groupBy(*by, "t").agg(*(AGGREGATES[f]("value", "ts_us").alias(f) for f in functions))


def fill(points: DataFrame, keys: list[str], start: int, end: int, step: int, how: str, value: str = "value") -> DataFrame:
    """A full grid of steps; holes become null, 0, the previous value or a line between neighbours; ``none`` leaves them out."""
    if how == "none":
        return points
    series = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    grid = series.withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(step))))
    x = grid.join(points.select(*keys, "t", value), [*keys, "t"], "left")
    if how == "0":
        return x.withColumn(value, F.coalesce(value, F.lit(0.0)))
    chunk = FILL_STEPS * step
    if how == "previous":
        return running(x, keys, "t", chunk, lasts=(value,))
    if how == "linear" and (end - start) // step >= 3:
        at = F.when(F.col(value).isNotNull(), F.col("t"))
        x = x.withColumn("v0", F.col(value)).withColumn("t0", at).withColumn("v1", F.col(value)).withColumn("t1", at)
        x = running(x, keys, "t", chunk, lasts=("v0", "t0"), nexts=("v1", "t1"))
        line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
        return x.withColumn(value, F.coalesce(F.col(value), line)).drop("v0", "t0", "v1", "t1")
    return x


def raw(samples: DataFrame, start: int, end: int) -> DataFrame:
    return with_series(samples).where(F.col("ts_us").between(start, end)).select("name", "series", "ts_us", "value").orderBy("series", "ts_us")


def density(samples: DataFrame, step: int) -> DataFrame:
    return samples.groupBy(time_bucket(F.col("ts_us"), step).alias("t")).agg(F.count(F.lit(1)).alias("n"))


def _with_neighbours(samples: DataFrame, first: int, last: int, keys: tuple[str, ...], reach: int | None) -> DataFrame:
    """Samples in [first, last] and of every series the newest one before and the oldest one after."""
    x = samples.select(*keys, "ts_us", "value")
    if reach is not None:
        x = x.where(F.col("ts_us").between(first - reach, last + reach))
    sample = F.struct("ts_us", "value")
    before = x.where(F.col("ts_us") < first).groupBy(*keys).agg(F.max(sample).alias("s"))
    after = x.where(F.col("ts_us") > last).groupBy(*keys).agg(F.min(sample).alias("s"))
    return x.where(F.col("ts_us").between(first, last)).unionByName(before.unionByName(after).select(*keys, "s.ts_us", "s.value"))


def rates(samples: DataFrame, start: int, end: int, step: int, window: int, keys: tuple[str, ...] = ("series",), reach: int | None = None) -> DataFrame:
    """(keys, t, n, increase, rate, irate, delta, idelta, deriv, and *_over_time values) per series and step.

    Windows are closed; counters may reset; a single sample borrows its neighbour, the previous one first. A rate is raised to the whole window where samples span less of it.
    Samples are sorted within panes of the grid only (see ``panes``); a neighbour outside the range is looked for as far as ``reach``, or in the whole history.
    """
    grid, keys = Grid(start, end, step, window), list(keys)
    ts = F.col("ts_us")
    x = _with_neighbours(samples.where("value is not null"), grid.first, grid.last, tuple(keys), reach)
    x = x.withColumn("pane", F.when(ts < grid.first, -1).when(ts > grid.last, 2**62).otherwise(grid.pane(ts)))
    near = W.partitionBy(*keys, "pane").orderBy("ts_us", "value")
    x = x.select("*", F.lag("ts_us").over(near).alias("pt"), F.lag("value").over(near).alias("pv"), F.when(grid.inside(ts), (ts - grid.origin(F.floor(F.col("pane") / grid.length))) / 1e6).alias("s"))
    v, s = F.col("value"), F.col("s")
    sums = {"n": F.count(F.lit(1)), "total": F.sum(v), "resets": F.sum(F.when(v < F.col("pv"), F.col("pv")).otherwise(0.0)), "sx": F.sum(s), "sxx": F.sum(s * s), "sxy": F.sum(s * v)}
    x = x.groupBy(*keys, "pane").agg(*(c.alias(k) for k, c in sums.items()), F.min("value").alias("least"), F.max("value").alias("most"), F.min(F.struct("ts_us", "value")).alias("a"), F.max(F.struct("ts_us", "value", "pt", "pv")).alias("b"))
    order = W.partitionBy(*keys).orderBy("pane")
    x = x.withColumn("p", F.lag("b").over(order)).withColumn("f", F.lead("a").over(order)).where(F.col("pane").between(0, 2**61))
    a, b, p, f = (F.col(c) for c in "abpf")
    # a reset between panes counts in the later one; the window's first pane has none
    x = x.withColumn("between", F.when(a["value"] < p["value"], p["value"]).otherwise(0.0)).withColumn("resets", F.col("resets") + F.col("between"))
    x = x.withColumn("second", F.when(b["pt"].isNotNull(), F.struct(b["pt"].alias("ts_us"), b["pv"].alias("value"))).otherwise(F.struct(p["ts_us"].alias("ts_us"), p["value"].alias("value"))))
    x = windows(x, keys, grid, dict.fromkeys(sums, "sum") | {"least": "min", "most": "max"}, first=("a", "p", "f", "between"), last=("b", "second"), apart=("n", "total", "sx", "sxx", "sxy"))
    n, two, second = F.col("n"), F.col("n") > 1, F.col("second")
    one = F.when(p.isNotNull(), a["value"] - p["value"] + F.when(a["value"] < p["value"], p["value"]).otherwise(0.0)).when(f.isNotNull(), f["value"] - a["value"] + F.when(f["value"] < a["value"], a["value"]).otherwise(0.0))
    increase = F.when(two, b["value"] - a["value"] + F.col("resets") - F.col("between")).otherwise(one)
    span = F.when(two, b["ts_us"] - a["ts_us"]).when(p.isNotNull(), a["ts_us"] - p["ts_us"]).otherwise(f["ts_us"] - a["ts_us"]) / 1e6
    x = x.withColumn("increase", F.when(increase.isNotNull(), F.greatest(increase, F.lit(0.0)))).withColumn("span", span)
    # regression sums are about the start of their block, near the samples; those of the later block move to the earlier one's
    late, d = (lambda c: F.col(f"{c}_late")), (grid.origin(F.col("home") + 1) - grid.origin(F.col("home"))) / 1e6
    sx = F.col("sx_early") + late("sx") + late("n") * d
    sxx = F.col("sxx_early") + late("sxx") + 2 * d * late("sx") + late("n") * d * d
    sxy = F.col("sxy_early") + late("sxy") + d * late("total")
    x = x.withColumn("spread", n * sxx - sx * sx).withColumn("common", n * sxy - sx * F.col("total"))
    rise = (b["value"] - a["value"]) / ((b["ts_us"] - a["ts_us"]) / 1e6)
    slope = F.when(n == 2, F.when(b["ts_us"] > a["ts_us"], rise)).when(two & (F.col("spread") > 0), F.col("common") / F.col("spread"))
    apart = (b["ts_us"] - second["ts_us"]) / 1e6
    return x.select(
        *keys, "t", "n", "increase", F.when(F.col("span") > 0, F.col("increase") / F.col("span") * F.greatest(F.lit(window / 1e6) / F.col("span"), F.lit(1.0))).alias("rate"),
        F.when(two & (apart > 0), (b["value"] - second["value"]) / apart).alias("irate"), F.when(two, b["value"] - a["value"]).alias("delta"), F.when(two, b["value"] - second["value"]).alias("idelta"),
        slope.alias("deriv"), (F.col("total") / n).alias("avg_over_time"), F.col("least").alias("min_over_time"), F.col("most").alias("max_over_time"),
        F.col("total").alias("sum_over_time"), n.cast("double").alias("count_over_time"), b["value"].alias("last_over_time"),
    )


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def across(points: DataFrame, function: str, value: str = "value", by: tuple[str, ...] = (), at: tuple[str, ...] = ("t",), without: tuple[str, ...] | None = None, labels: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate across series, per timestamp if ``at`` names one; NaN and infinities are skipped, count counts series."""
    keys = tuple(x for x in labels if x not in without) if without is not None else by
    v = F.lit(1.0) if function == "count" else _finite(F.col(value))
    out = F.count(v).cast("double") if function == "count" else AGGREGATES[function](v, F.lit(0))
    return points.groupBy(*keys, *at).agg(out.alias("value"))


def top(points: DataFrame, k: int, value: str = "value", bottom: bool = False, tie: str = "series") -> DataFrame:
    """topk / bottomk of an instant vector."""
    return points.orderBy(F.asc(value) if bottom else F.desc(value), tie).limit(k)


def top_series(points: DataFrame, k: int, key: str = "series", value: str = "value", bottom: bool = False) -> DataFrame:
    """topk / bottomk over a range: whole series, ranked by their extreme value."""
    best = points.groupBy(key).agg((F.min if bottom else F.max)(value).alias("best")).orderBy(F.asc("best") if bottom else F.desc("best"), key).limit(k)
    return points.join(best, key, "left_semi")


def label_combinations(samples: DataFrame, *labels: str) -> DataFrame:
    return samples.select(*(F.col("labels")[k].alias(k) for k in labels)).distinct()


def names(samples: DataFrame) -> DataFrame:
    return samples.select("name").distinct()


def label_names(samples: DataFrame, name: str) -> DataFrame:
    return samples.where(F.col("name") == name).select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_values(samples: DataFrame, label: str, name: str | None = None) -> DataFrame:
    x = samples if name is None else samples.where(F.col("name") == name)
    return x.select(F.col("labels")[label].alias("value")).where("value is not null").distinct()


def series_list(*selections: DataFrame) -> DataFrame:
    out = None
    for s in selections:
        x = with_series(s).select("name", "series")
        out = x if out is None else out.unionByName(x)
    return out.dropDuplicates()


def metadata(samples: DataFrame) -> DataFrame:
    unit = F.max_by("unit", "ts_us")
    return samples.groupBy("name").agg(F.max_by("type", "ts_us").alias("type"), F.when(unit.isin("", "1"), F.lit("none")).otherwise(unit).alias("unit"))


def downsample(samples: DataFrame, start: int, end: int, step: int, function: str, tags: tuple[str, ...] = (), fill_with: str = "null") -> DataFrame:
    """InfluxQL-shaped select: a function per time() step and tags, with fill."""
    x = range_aggregate(samples, start, end, step, {"mean": "avg"}.get(function, function), by=tags).withColumnRenamed({"mean": "avg"}.get(function, function), "value")
    return fill(x, list(tags), start, end, step, fill_with)


def arithmetic(left: DataFrame, right: DataFrame, op: str, on: tuple[str, ...]) -> DataFrame:
    """Series matched on labels and time; a zero divisor gives null."""
    a, b = F.col("value"), F.col("other")
    x = left.select(*on, "value").join(right.select(*on, F.col("value").alias("other")), list(on))
    result = {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[op]
    return x.select(*on, result.alias("value"))


def arithmetic_of(points: DataFrame, left: str, right: str, op: str) -> DataFrame:
    """``points`` with ``value`` from two of its columns: what one query plan holds already needs no match."""
    a, b = F.col(left), F.col(right)
    return points.withColumn("value", {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[op])


def set_operation(left: DataFrame, right: DataFrame, op: str, on: tuple[str, ...]) -> DataFrame:
    """and, or, unless."""
    if op == "or":
        return left.unionByName(right.join(left, list(on), "left_anti"))
    return left.join(right, list(on), "left_semi" if op == "and" else "left_anti")


def offset(samples: DataFrame, by_us: int) -> DataFrame:
    return samples.withColumn("ts_us", F.col("ts_us") + by_us)


def span_metric_series(red: DataFrame, step: int, function: str, q: float = 0.0, by: tuple[str, ...] = ("service",)) -> DataFrame:
    """(by, t, value) from RED points (t, calls, latency_us) instead of spans: rates and counts add calls; a quantile over time
    is the highest of p50, p90, p95 and p99 not above ``q`` of the points' latency, below p50 and for histograms the mean, in seconds."""
    x = red.withColumn("t", time_bucket(F.col("t"), step))
    if function in ("quantile_over_time", "histogram_over_time"):
        held = next((p for p in (0.99, 0.95, 0.9, 0.5) if q >= p), None) if function == "quantile_over_time" else None
        ms = F.col("latency_us") / 1000
        value = (F.percentile(ms, held) if held else F.avg(ms)) / 1000
    else:
        value = F.sum("calls").cast("double")
    return x.groupBy(*by, "t").agg(value.alias("value"))
