"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
reread as the next one's `docs`. All but the last return the columns of documents. Stages with steps in
Python set the session's limit of bytes in a batch, if it has none: their results are read after they return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkqual.llm import decontaminate, language, ngram_join, packing, secrets
from sparkqual.llm.tables import free_name, held_out, table
from sparkqual.llm.workers import small_batches
from sparkqual.plans.durable import durable

# A document is kept if this share of its letters is in one language.
LANGUAGE_SHARE = 0.5
# Near-duplicates share this percentage of their five-word shingles.
SHINGLE, SIMILAR = 5, 80
# Documents to remove whose keys are broadcast (8 bytes each); more are joined by key.
BROADCAST_KEYS = 2_000_000


def _key():
    """A document's key; two rows have the same one only if id and text are equal."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose text is mostly in one language; null texts go.

    Scores are learned from the labelled documents that are not held out.
    """
    small_batches(spark)
    model = language.train(docs.filter(~held_out()))
    name = free_name(docs, "_key")
    keyed = docs.withColumn(name, _key())
    judged = language.detect(keyed.select(F.col(name).alias("doc_id"), "text"), model)
    rejected = judged.filter((F.col("lang_pred") == "und") | (F.col("score") < LANGUAGE_SHARE))
    gone = durable(rejected.select(F.col("doc_id").alias(name)).distinct())
    return _without(keyed, gone, name).select(*docs.columns)


def _without(keyed: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return keyed.join(gone, name, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Rows with a null id take no part and stay; of rows with the kept id, all with that id stay but
    repeated texts, which count once.
    """
    small_batches(spark)
    found = ngram_join.ngram_join(docs, SHINGLE, SIMILAR)
    name, text = free_name(docs, "_key"), free_name(docs, "_text")
    gone = durable(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct())
    named = docs.filter("doc_id is not null").withColumn(name, F.col("doc_id").cast("long"))
    ids = named.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    twice = durable(ids.select(name))
    kept = _without(named, gone, name)
    if not twice.isEmpty():
        some = kept.join(twice, name, "left_semi").withColumn(text, F.xxhash64(F.coalesce("text", F.lit(""))))
        kept = _without(kept, twice, name).unionByName(some.dropDuplicates([name, text]).drop(text))
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with every secret replaced by `[secret]`."""
    small_batches(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    small_batches(spark)
    pieces = packing.pack(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmarks),
    ("secrets", without_secrets),
    ("pack", packed),
]

# SQL has no form of the classifier's and the tokenizer's steps: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
