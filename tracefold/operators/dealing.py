"""How many tasks a shuffle of a large input has."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files per task of a shuffle. Smaller inputs keep the session's number of shuffle partitions.
TASK_BYTES = 8 << 20
#: Most tasks of a shuffle, and what a table of unknown size is given as.
TASKS, _UNKNOWN = 20_000, 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, by Spark's statistics; those of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(x for x in sizes if x < _UNKNOWN)


def dealt(df: DataFrame, *keys: str, task_bytes: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its input has parts of ``task_bytes``, so that a task's memory does not grow with the input.
    Where the session's shuffle partitions are enough, the shuffles that follow stay as planned."""
    if df.isStreaming:
        return df
    tasks = min(TASKS, -(-input_bytes(df) // (task_bytes or TASK_BYTES)))
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
