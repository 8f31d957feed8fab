"""A corpus pipeline: five operators, each stage's result written as Parquet and read as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontaminate, jaccard, language_id, mixing, registry, tokens
from tracefold.llm.base import id_remainder, settle, settle_table, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of a lower cosine to every language are not taken for text of any.
LEAST_COSINE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is recognised as one of the corpus' languages; prototypes come from three quarters of the rows."""
    prototypes = language_id.train_prototypes(docs.where(id_remainder(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs, prototypes)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest id.

    Rows without an id, and rows that share one, are told apart by their content: a component of such rows only keeps the smallest
    hash of a row's columns, and of rows alike in every column one. Documents without words stay.
    """
    shared = settle(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")))
    content = F.xxhash64(*[c for i in COLUMNS for c in (F.col(i), F.col(i).isNull())])
    if shared.isEmpty():
        rows = docs.withColumn("__key", F.col("doc_id")).withColumn("__by_content", F.lit(False))
    else:
        same = (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("doc_id").isNull() == F.col("none"))
        rows = docs.join(shared, same, "left").withColumn("__by_content", F.col("id").isNotNull())
        rows = rows.withColumn("__key", F.when(F.col("__by_content"), content).otherwise(F.col("doc_id")))
    found = settle_table(jaccard.jaccard_components(rows.select("__key", "text"), key="__key").where("n_shingles > 0").select("__key", "component_id"))
    if shared.isEmpty():
        gone = found.where("component_id <> __key").select("__key")
        return docs.join(gone.withColumnRenamed("__key", "doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    by_content = rows.where("__by_content").select("__key").distinct().withColumn("late", F.lit(True))
    found = found.distinct().join(by_content, "__key", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    first = found.groupBy("component_id").agg(F.min(F.struct("late", "__key")).alias("first"))
    gone = found.join(first, "component_id").where("__key <> first.__key").select("__key")
    kept = rows.join(gone, "__key", "left_anti")
    alike = kept.where("__by_content").dropDuplicates(["__key"])
    return kept.where("not __by_content").unionByName(alike).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix_sources(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet shards; returns each document's place, count and checksum, read back."""
    out = shared_folder(spark)
    tokens.write_shards(docs, out, registry.tokenizer_path(), registry.END_ID)
    return tokens.document_digests(spark, out)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("mix", mix),
    ("tokens", encode),
]

#: Language vectors, random indexing and tokenisation are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
