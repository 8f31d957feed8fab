"""Histogram operators: bucket rows, merges, quantiles, heatmaps, cumulative parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panes import Grid, slide
from .running import running

#: Steps of a chunk of running values.
STEPS = 512


def bucket_rows(points: DataFrame, *keys: str) -> DataFrame:
    """One row per bucket with its bound (infinite for the overflow bucket) and count."""
    x = points.select(*keys, "explicit_bounds", F.posexplode("bucket_counts").alias("pos", "n"))
    return x.select(*keys, "pos", F.coalesce(F.get("explicit_bounds", F.col("pos")), F.lit(float("inf"))).alias("le"), "n")


def expand(points: DataFrame, *keys: str, le: float | None = None) -> DataFrame:
    """Cumulative count per bound and point."""
    x = bucket_rows(points, *keys, "ts_us").withColumn("value", F.sum("n").over(W.partitionBy(*keys, "ts_us").orderBy("pos")))
    x = x.select(*keys, "ts_us", "le", "value")
    return x if le is None else x.where(F.col("le") == le)


def _summed(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, le, n): counts summed by place; the longest bounds hold for all, of equally long ones the largest."""
    bounds = points.groupBy(*keys).agg(F.max(F.struct(F.size("explicit_bounds").alias("k"), "explicit_bounds")).alias("b"))
    counts = points.select(*keys, F.posexplode("bucket_counts").alias("pos", "n")).groupBy(*keys, "pos").agg(F.sum("n").alias("n"))
    return counts.join(bounds, list(keys)).select(*keys, "pos", F.coalesce(F.get("b.explicit_bounds", F.col("pos")), F.lit(float("inf"))).alias("le"), "n")


def merge(points: DataFrame, *keys: str) -> DataFrame:
    """Element-wise sum of bucket counts; the longest bounds hold."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "le", "n")))
    return _summed(points, *keys).groupBy(*keys).agg(rows.alias("b")).select(*keys, F.col("b.n").alias("bucket_counts"), F.filter("b.le", lambda x: x != float("inf")).alias("explicit_bounds"))


def quantile(points: DataFrame, q: float, *keys: str) -> DataFrame:
    """Linear within the bucket that holds the rank, its lower bound if that is empty; the mean above the last bound; 0 without counts. Points are deltas."""
    means = points.groupBy(*keys).agg(F.sum("value").alias("total"), F.sum("count").alias("points"))
    return _quantile(_summed(points, *keys), means, q, *keys)


def _quantile(summed: DataFrame, means: DataFrame, q: float, *keys: str) -> DataFrame:
    """From bucket counts (keys, pos, le, n) and the points' sums (keys, total, points)."""
    w = W.partitionBy(*keys).orderBy("pos")
    x = summed.where(F.col("le") != float("inf")).withColumn("upto", F.sum("n").over(w)).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).join(means, list(keys))
    x = x.withColumn("rank", F.col("points") * q)
    hit = x.where(F.col("upto") >= F.col("rank")).groupBy(*keys).agg(F.min(F.struct("pos", "le", "low", "n", "upto", "rank")).alias("h"))
    h = F.col("h")
    inside = F.when(h["n"] == 0, h["low"]).otherwise(h["low"] + (h["le"] - h["low"]) * (h["rank"] - (h["upto"] - h["n"])) / h["n"])
    out = means.join(hit, list(keys), "left")
    return out.select(*keys, F.when(F.col("points") == 0, 0.0).when(h.isNotNull(), inside).otherwise(F.col("total") / F.col("points")).alias("value"))


def quantile_over_time(points: DataFrame, q: float, start: int, end: int, step: int, window: int, *keys: str) -> DataFrame:
    """The same over a sliding window per step: bucket sums of panes are merged, no point is copied."""
    grid = Grid(start, end, step, window)
    x = points.withColumn("b", F.struct(F.size("explicit_bounds").alias("k"), "explicit_bounds"))
    whole = slide(x, list(keys), grid, total=("sum", "value"), points=("sum", "count"), b=("max", "b"))
    whole = whole.withColumn("b", F.col("b.explicit_bounds"))
    counts = slide(x.select(*keys, "ts_us", F.posexplode("bucket_counts").alias("pos", "n")), [*keys, "pos"], grid, n=("sum", "n"))
    summed = counts.join(whole.select(*keys, "t", "b"), [*keys, "t"]).select(*keys, "t", "pos", F.coalesce(F.get("b", F.col("pos")), F.lit(float("inf"))).alias("le"), "n")
    return _quantile(summed, whole.select(*keys, "t", "total", "points"), q, *keys, "t")


def heatmap(points: DataFrame, start: int, end: int, step: int, window: int, *keys: str) -> DataFrame:
    """Cumulative rate per bound and step, from bucket sums of panes."""
    x = slide(bucket_rows(points, *keys, "ts_us"), [*keys, "pos", "le"], Grid(start, end, step, window), n=("sum", "n"))
    w = W.partitionBy(*keys, "t").orderBy("pos")
    return x.select(*keys, "t", "le", (F.sum("n").over(w) / (window / 1e6)).alias("value"))


def snapshots(points: DataFrame, column: str, start: int, end: int, step: int, *keys: str, delta: bool = True) -> DataFrame:
    """Cumulative ``column`` as of each step: the running sum of deltas, else the newest value.

    Points are brought to one row per series and step first; values then run over steps in two levels.
    """
    ts, v = F.col("ts_us"), F.col(column).cast("double")
    nth = F.greatest(F.ceil((ts - start) / step), F.lit(0))
    value = F.sum(v) if delta else F.max_by(v, F.when(v.isNotNull(), ts))
    held = points.where(ts <= end).groupBy(*keys, nth.alias("k")).agg(value.alias("value"))
    grid = held.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((end - start) // step).cast("long"))))
    x = held.unionByName(grid, allowMissingColumns=True).groupBy(*keys, "k").agg(F.max("value").alias("value")).where(F.col("k") <= (end - start) // step)
    x = running(x, list(keys), "k", STEPS, sums=("value",)) if delta else running(x, list(keys), "k", STEPS, lasts=("value",))
    return x.where("value is not null").select(*keys, (F.col("k") * step + start).alias("t"), "value")
