"""Partitioned, routed, idempotent and relational sinks, and the stream source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_signal(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Files per app and UTC day. Rows are dealt by app and day first; what is large is split over tasks and what is small put together."""
    x = df.withColumn("day", F.to_date(F.timestamp_micros(ts)))
    x.hint("rebalance", "app_id", "day").write.mode(mode).partitionBy("app_id", "day").parquet(path)


def write_rollup(df: DataFrame, path: str) -> None:
    """Replaces exactly the (tier, app_id, hour) partitions it has rows for, so that reruns leave the same table."""
    x = df.withColumn("hour", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd-HH")).hint("rebalance", "tier", "app_id", "hour")
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "app_id", "hour").parquet(path)


def route_signals(stream: DataFrame, writers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """A streaming query that hands the rows of each signal to its own writer."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for signal, write in writers.items():
            write(batch.where(F.col("signal") == signal))
        batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A relational table, read in ranges of a numeric column; maps are JSON text there."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options).load()


def write_table(df: DataFrame, url: str, table: str, partitions: int = 16, **options: str) -> None:
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
    flat.coalesce(partitions).write.format("jdbc").options(url=url, dbtable=table, batchsize=5000, **options).mode("append").save()
