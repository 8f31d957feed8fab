"""Running values in two levels: within chunks of a series, then over one row per chunk. No task orders a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _held(value: str, at: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value")))


def running(rows: DataFrame, keys: list[str], at: str, size: int, sums: tuple[str, ...] = (), lasts: tuple[str, ...] = (), nexts: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with running totals of ``sums``, the newest non-null value up to each row of ``lasts`` and the next one from it on of ``nexts``.

    ``at`` orders the rows of ``keys`` and is cut into chunks of ``size``; rows of one place share what they see.
    """
    x = rows.withColumn("__chunk", F.floor(F.col(at) / size))
    near = W.partitionBy(*keys, "__chunk").orderBy(at)
    upto, onward = near.rangeBetween(W.unboundedPreceding, W.currentRow), near.rangeBetween(W.currentRow, W.unboundedFollowing)
    whole = x.groupBy(*keys, "__chunk").agg(*(F.sum(c).alias(f"__s_{c}") for c in sums), *(F.max(_held(c, at)).alias(f"__l_{c}") for c in lasts), *(F.min(_held(c, at)).alias(f"__n_{c}") for c in nexts))
    chunks = W.partitionBy(*keys).orderBy("__chunk")
    before, after = chunks.rowsBetween(W.unboundedPreceding, -1), chunks.rowsBetween(1, W.unboundedFollowing)
    whole = whole.select(
        *(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__chunk").alias("__of"), *(F.sum(f"__s_{c}").over(before).alias(f"__s_{c}") for c in sums),
        *(F.last(f"__l_{c}", ignorenulls=True).over(before)["value"].alias(f"__l_{c}") for c in lasts), *(F.first(f"__n_{c}", ignorenulls=True).over(after)["value"].alias(f"__n_{c}") for c in nexts),
    )
    x = x.select("*", *(F.sum(c).over(upto).alias(f"__us_{c}") for c in sums), *(F.last(c, ignorenulls=True).over(upto).alias(f"__ul_{c}") for c in lasts), *(F.first(c, ignorenulls=True).over(onward).alias(f"__un_{c}") for c in nexts))
    on = F.col("__chunk") == F.col("__of")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    x = x.join(whole, on)
    found = {c: F.coalesce(F.col(f"__us_{c}") + F.col(f"__s_{c}"), f"__us_{c}", f"__s_{c}") for c in sums} | {c: F.coalesce(f"__ul_{c}", f"__l_{c}") for c in lasts} | {c: F.coalesce(f"__un_{c}", f"__n_{c}") for c in nexts}
    return x.select(*(found.get(c, F.col(c)).alias(c) for c in rows.columns))
