"""Retention and usage over partitions (signal, app_id, day, n_rows, n_bytes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days kept without any other rule.
BUILT_IN_DAYS = {"trace": 7, "metric": 30, "log": 14}


def effective(partitions: DataFrame, overrides: DataFrame, defaults: DataFrame, most_days: int = 365) -> DataFrame:
    """(signal, app_id, days, origin): the app's override, else the platform default, else the built-in days."""
    built_in = F.create_map(*[F.lit(x) for kv in BUILT_IN_DAYS.items() for x in kv])
    x = partitions.select("signal", "app_id").distinct().join(overrides.select("signal", "app_id", F.col("days").alias("own")), ["signal", "app_id"], "left").join(defaults.select("signal", F.col("days").alias("platform")), "signal", "left")
    origin = F.when(F.col("own").isNotNull(), "override").when(F.col("platform").isNotNull(), "default").otherwise("built-in")
    return x.select("signal", "app_id", F.least(F.coalesce("own", "platform", built_in[F.col("signal")]), F.lit(most_days)).alias("days"), origin.alias("origin"))


def expired(partitions: DataFrame, retention: DataFrame, now_day: DataFrame) -> DataFrame:
    """Partitions older than their retention; ``now_day`` has (signal, today)."""
    return partitions.join(retention, ["signal", "app_id"]).join(now_day, "signal").where(F.col("day") < F.col("today") - F.col("days")).select("signal", "app_id", "day", "n_rows", "n_bytes")


def purge_estimate(old: DataFrame) -> DataFrame:
    return old.groupBy("signal", "app_id").agg(F.count(F.lit(1)).alias("n_partitions"), F.sum("n_rows").alias("n_rows"))


def boundary(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("signal").agg(F.min("day").alias("oldest"), F.max("day").alias("newest"), (F.sum("n_rows") == 0).alias("is_empty"))


def usage(partitions: DataFrame, capacity_bytes: int) -> DataFrame:
    """Bytes by signal, by app and in all, with the share of capacity and an alert level."""
    g = partitions.groupingSets([[], ["signal"], ["app_id"]], "signal", "app_id").agg(F.sum("n_bytes").alias("n_bytes"))
    share = F.col("n_bytes") / capacity_bytes
    return g.select(F.coalesce("signal", F.lit("*")).alias("signal"), F.coalesce("app_id", F.lit("*")).alias("app_id"), "n_bytes", F.when(share >= 0.9, "critical").when(share >= 0.75, "warning").otherwise("ok").alias("alert"))


def daily(partitions: DataFrame, first_day: int, last_day: int) -> DataFrame:
    x = partitions.where(F.col("day").between(first_day, last_day))
    p = x.groupBy("day").pivot("signal", ["trace", "metric", "log"]).agg(F.sum("n_bytes"))
    return p.select("day", *(F.coalesce(s, F.lit(0)).alias(f"{s}_bytes") for s in ("trace", "metric", "log")))
