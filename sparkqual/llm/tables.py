"""Reading the given tables, and small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkqual.plans.durable import durable

# Rows of a narrow stored table that one task writes.
PART_ROWS, LEAST_PARTS = 20_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): null text is empty, other columns are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of at most `rows` narrow rows, in as many files as they need.

    Without this, each small table is written in as many files as there are shuffle partitions.
    """
    return durable(df.coalesce(max(LEAST_PARTS, rows // PART_ROWS)))
