"""The incremental rollup: a batch that brings the five-minute tier up to date and can be run again at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup as ru
from ..operators.tree import settled
from . import sinks

_PROGRESS = "app_id string, hour long"


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, hour) rolled up so far; none before the first run."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(_PROGRESS).parquet(path) if there else spark.createDataFrame([], _PROGRESS)


def watermarks(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, watermark): the end of the last hour up to which every hour of the app is rolled up, from its first one on."""
    return ru.watermark(progress(spark, path)).select("app_id", (F.col("watermark") + ru.HOUR).alias("watermark"))


def pending_hours(points: DataFrame, done: DataFrame, now_us: int, ready_us: int = ru.READY) -> DataFrame:
    """(app_id, day, hour) of every hour of a day with data that ended ``ready_us`` ago or longer and is not done, hours without data included."""
    days = points.select("app_id", "day").distinct()
    start = F.unix_micros(F.col("day").cast("timestamp"))
    hours = days.withColumn("hour", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: start + i * F.lit(ru.HOUR))))
    return hours.where(F.col("hour") + ru.HOUR + ready_us <= now_us).join(done, ["app_id", "hour"], "left_anti")


def roll_up(points: DataFrame) -> DataFrame:
    """Five-minute rows of gauges, counters and histograms, with what each kind keeps."""
    keys = ("app_id", "name", "type", "series")
    kind = lambda k: points.where(F.col("type") == k)
    parts = [ru.rollup_gauge(kind("gauge"), keys, True), ru.rollup_counter(kind("counter"), keys, True), ru.rollup_histogram(kind("histogram"), keys=keys, labels=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumnRenamed("t", "ts_us").withColumn("tier", F.lit("5m"))


def run(spark: SparkSession, points: str, tier: str, done: str, now_us: int, ready_us: int = ru.READY) -> DataFrame:
    """Rolls up what is ready and not done yet; returns the (app_id, hour) it did.

    ``points`` is a table of metric points partitioned by app_id and day, of which only days with pending hours are read. Their hours' partitions of
    ``tier`` are replaced first, then the hours are added to ``done``. If a run ends between the two, the next one replaces the same partitions by the
    same rows. Nothing else is kept: the watermark of an app follows from the hours done.
    """
    table = spark.read.parquet(points).withColumn("app_id", F.col("app_id").cast("string"))
    pending = settled(pending_hours(table, progress(spark, done), now_us, ready_us))
    if pending.isEmpty():
        return pending.select("app_id", "hour")
    hour = F.floor(F.col("ts_us") / ru.HOUR) * ru.HOUR
    rows = table.withColumn("hour", hour).join(pending, ["app_id", "day", "hour"], "left_semi")
    sinks.write_rollup(roll_up(rows), tier)
    pending.select("app_id", "hour").write.mode("append").parquet(done)
    return pending.select("app_id", "hour")
