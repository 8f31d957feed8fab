"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import inspect
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these.
SPACES = " \t\n\x0b\f\r"
#: Bits of the table that ``only`` broadcasts: 2 ** 22, 65,536 words of 64 bits.
ID_BITS = 22
#: Rows of one Arrow batch of texts.
BATCH_ROWS = 1000
_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What this worker process keeps between tasks of ``operator``. Processes serve one operator after another and stay; what an earlier one kept goes."""
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
    return _kept[operator]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tracefold-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str = "shards") -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows: texts are long, and JVM and Python hold a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, which outlives any executor."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def settle_table(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Like ``settle`` for wide or long intermediate tables: a compressed Parquet table in the shared checkpoint folder."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` whose ``key`` may be among those of ``ids``: a map-side filter by a bit table of fixed size, before any shuffle."""
    bit = F.shiftrightunsigned(F.xxhash64(key), 64 - ID_BITS)
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), {64 - ID_BITS}) & 63 as int))")
    bits = settle(ids.groupBy(word.alias("__word")).agg(F.bit_or(mask).alias("__bits")))  # at most 2 ** (ID_BITS - 6) rows of two numbers
    return rows.withColumn("__word", word).join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(mask) != 0).drop("__word", "__bits")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+", -1))


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t-\r]+", -1))).cast("long")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def sets_apart(*inner: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For an operator on ``docs`` that uses the column names ``inner`` itself: the caller's columns of these names are named otherwise while it works."""

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            call = signature.bind(*args, **kwargs)
            docs = call.arguments["docs"]
            apart = {c: f"{c} of the caller" for c in docs.columns if c in inner}
            if not apart:
                return operator(*args, **kwargs)
            call.apply_defaults()
            for name, value in call.arguments.items():
                if name in ("text", "key", "source", "lang") and value in apart:
                    call.arguments[name] = apart[value]
            call.arguments["docs"] = docs.withColumnsRenamed(apart)
            return operator(*call.args, **call.kwargs).withColumnsRenamed({new: old for old, new in apart.items()})

        return run

    return around
