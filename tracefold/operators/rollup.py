"""Five-minute rollups, their progress, tier routing, and the metric catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import series_key, time_bucket

TIER = 300_000_000
HOUR = 3_600_000_000
SERVICES_KEPT = 20


def _bucketed(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series", series_key(F.col("labels"))).withColumn("t", time_bucket(F.col("ts_us"), TIER))


def _labels(labels: bool) -> list[Column]:
    return [F.any_value("labels").alias("labels")] if labels else []


def rollup_gauge(samples: DataFrame, keys: tuple[str, ...] = ("name", "series"), labels: bool = False) -> DataFrame:
    values = [F.avg("value").alias("value"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count")]
    return _bucketed(samples).groupBy(*keys, "t").agg(*values, *_labels(labels))


def rollup_counter(samples: DataFrame, keys: tuple[str, ...] = ("name", "series"), labels: bool = False) -> DataFrame:
    values = [F.max_by("value", "ts_us").alias("value"), F.min_by("value", "ts_us").alias("first"), F.max_by("value", "ts_us").alias("last"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count")]
    return _bucketed(samples).groupBy(*keys, "t").agg(*values, *_labels(labels))


def rollup_histogram(points: DataFrame, step: int = TIER, keys: tuple[str, ...] = ("name", "series"), labels: bool = False) -> DataFrame:
    """Delta histograms per series and step: bucket_counts, explicit_bounds, value and count.

    Deltas add up. Cumulative points, also those of no stated temporality, give their last minus their first one, buckets not
    below zero; a step with any of them takes these alone.
    """
    keys = [*keys, "t"]
    x = points.withColumn("series", series_key(F.col("labels"))).withColumn("t", time_bucket(F.col("ts_us"), step))
    delta = F.coalesce("temporality", F.lit("")) == "delta"
    point = F.struct("ts_us", "count", "value", "bucket_counts")
    bounded = F.when(F.size("explicit_bounds") > 0, F.struct("ts_us", "explicit_bounds"))
    g = x.groupBy(*keys).agg(
        F.min(F.when(~delta, point)).alias("a"), F.max(F.when(~delta, point)).alias("b"), F.min(bounded).alias("bounds"),
        F.sum(F.when(delta, F.col("value"))).alias("value"), F.sum(F.when(delta, F.col("count"))).alias("count"), *_labels(labels),
    )
    n = x.where(delta).select(*keys, F.posexplode("bucket_counts").alias("pos", "n")).groupBy(*keys, "pos").agg(F.sum("n").alias("n"))
    sums = n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("s"))
    a, b, grown = F.col("a"), F.col("b"), F.col("b").isNotNull()
    less = F.transform(b["bucket_counts"], lambda c, i: F.greatest(c - F.coalesce(F.get(a["bucket_counts"], i), F.lit(0)), F.lit(0)))
    return g.join(sums, keys, "left").select(
        *keys, F.when(grown, less).otherwise(F.col("s.n")).alias("bucket_counts"), F.col("bounds.explicit_bounds").alias("explicit_bounds"),
        F.when(grown, b["value"] - a["value"]).otherwise(F.col("value")).alias("value"), F.when(grown, b["count"] - a["count"]).otherwise(F.col("count")).alias("count"), *(["labels"] if labels else []),
    )


def ready_hours(samples: DataFrame, progress: DataFrame, now_us: int, ready_us: int = 2 * HOUR) -> DataFrame:
    """(app_id, hour) that are complete and not rolled up yet."""
    hours = samples.select("app_id", time_bucket(F.col("ts_us"), HOUR).alias("hour")).distinct().where(F.col("hour") + HOUR + ready_us <= now_us)
    return hours.join(progress, ["app_id", "hour"], "left_anti")


def watermark(done: DataFrame) -> DataFrame:
    """Per app the last hour of its contiguous prefix of done hours."""
    w = W.partitionBy("app_id").orderBy("hour")
    x = done.distinct().withColumn("run", F.col("hour") - (F.row_number().over(w) - 1) * HOUR).withColumn("first", F.min("hour").over(W.partitionBy("app_id")))
    return x.where("run = first").groupBy("app_id").agg(F.max("hour").alias("watermark"))


def tiered(raw: DataFrame, rolled: DataFrame, split_us: int) -> DataFrame:
    """Rollup rows before the split, raw rows from it on; the two have the same columns."""
    return rolled.where(F.col("ts_us") < split_us).withColumn("tier", F.lit("5m")).unionByName(raw.where(F.col("ts_us") >= split_us).withColumn("tier", F.lit("raw")))


#: Samples are only read from the tier once it surely has them: hours are rolled up this long after they end, and at each tick.
READY, TICK = 2 * HOUR, HOUR


def split_point(now_us: int, ready_us: int = READY, tick_us: int = TICK) -> int:
    """Start of the first hour that the tier may not have yet."""
    return (now_us - ready_us - tick_us) // HOUR * HOUR


_PARTS = {
    "sum": lambda v: F.sum(v["sum"]), "count": lambda v: F.sum(v["count"]).cast("double"), "avg": lambda v: F.sum(v["sum"]) / F.sum(v["count"]), "min": lambda v: F.min(v["min"]), "max": lambda v: F.max(v["max"]),
    "first": lambda v: F.min_by(v["first"], v["from"]), "last": lambda v: F.max_by(v["last"], v["to"]),
}


def mixed_range(raw: DataFrame, rolled: DataFrame, start: int, end: int, step: int, split_us: int, *functions: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per step and labels over both tiers: rollup rows of [start, split), raw rows of [split, end).

    Either tier gives the same parts (sum, count, least, greatest, first and last value), which are put together per step; an average is a sum
    over a count, not one of averages. Where steps begin with five-minute buckets the result is that of raw rows alone, also in the step that holds the split.
    """
    unknown = set(functions) - set(_PARTS)
    if unknown:
        raise ValueError(f"the tier cannot answer {sorted(unknown)}")
    split_us = min(max(split_us, start), end)
    label = [F.col("labels")[k].alias(k) for k in by]
    columns = set(rolled.columns)
    of = lambda c, other: F.col(c if c in columns else other)
    old = rolled.where((F.col("t") >= start) & (F.col("t") < split_us)).select(
        *label, F.col("t").alias("ts_us"), F.struct("sum", F.col("count").cast("long").alias("count"), of("min", "value").alias("min"), of("max", "value").alias("max"), of("first", "value").alias("first"), of("last", "value").alias("last"), F.col("t").alias("from"), F.col("t").alias("to")).alias("v")
    )
    value = F.col("value")
    new = raw.where((F.col("ts_us") >= split_us) & (F.col("ts_us") < end)).select(
        *label, "ts_us", F.struct(value.alias("sum"), F.lit(1).cast("long").alias("count"), value.alias("min"), value.alias("max"), value.alias("first"), value.alias("last"), F.col("ts_us").alias("from"), F.col("ts_us").alias("to")).alias("v")
    )
    x = old.unionByName(new).withColumn("t", time_bucket(F.col("ts_us"), step, start))
    x = x.dropna(subset=list(by)) if by else x
    return x.groupBy(*by, "t").agg(*(_PARTS[f](F.col("v")).alias(f) for f in functions))


def catalog(samples: DataFrame) -> DataFrame:
    """One row per app and metric: type, unit, label keys, some services, last time, count."""
    return samples.groupBy("app_id", "name").agg(
        F.max_by("type", "ts_us").alias("type"), F.max_by("unit", "ts_us").alias("unit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.map_keys("labels"))))).alias("label_keys"),
        F.slice(F.sort_array(F.collect_set("service")), 1, SERVICES_KEPT).alias("services"), F.max("ts_us").alias("last_seen"), F.count(F.lit(1)).alias("n"),
    )


def upsert_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("app_id", "name").agg(
        F.max_by("type", "last_seen").alias("type"), F.max_by("unit", "last_seen").alias("unit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("label_keys")))).alias("label_keys"),
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("services")))), 1, SERVICES_KEPT).alias("services"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"),
    )


def prune_catalog(entries: DataFrame, cutoff_us: int) -> DataFrame:
    return entries.where(F.col("last_seen") >= cutoff_us)
