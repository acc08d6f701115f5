"""Joins from a large table to a table with one row per key, safe under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key with less than this share of all rows is not hot, so there are at most as many hot keys as
# the share goes into one; their hashes and parts are broadcast (12 bytes each).
HOT_SHARE = 1 / 100_000
# A key is hot from this many rows on, and is split into parts of about as many.
HOT_ROWS = 250_000
# Parts of one key at most.
MAX_PARTS = 10_000


# A table is broadcast when it was counted and found below both limits.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, column: str) -> bool:
    """Whether a one-column table of texts is small; its rows and bytes are summed where they are."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(column)).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def _key_hash(columns: Sequence[Column]) -> Column:
    return F.xxhash64(*columns)


def hot_hashes(keyed: DataFrame, on: Sequence[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_hash, _parts) of all keys with at least `hot_rows` rows and the least share of all rows.

    The list only decides how work is spread. A key missing from it, or one sharing a hash
    with a hot key, is still joined correctly.
    """
    parts = F.least(F.ceil(F.col(count) / hot_rows), F.lit(MAX_PARTS)).cast("int")
    least = keyed.agg(F.sum(count) * F.lit(HOT_SHARE)).scalar()
    return (
        keyed.filter((F.col(count) >= hot_rows) & (F.col(count) >= least))
        .groupBy(_key_hash([F.col(k) for k in on]).alias("_hash"))
        .agg(F.max(parts).alias("_parts"))
    )


def join_unique(
    rows: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    how: str,
    count: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `rows` to `keyed` (one row per key, `count` = its rows in `rows`), nulls equal.

    A hot key's rows are split into parts by the task that read them, which a re-run task
    repeats exactly; the single matching row of `keyed` is copied to every part. All copies
    together are about one per `hot_rows` rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    hot = F.broadcast(hot_hashes(keyed, on, count, hot_rows))
    parts = F.coalesce("_parts", F.lit(1))
    left = (
        rows.withColumn("_hash", _key_hash([F.col(k) for k in on]))
        .join(hot, "_hash", "left")
        .withColumn("_part", F.pmod(F.spark_partition_id(), parts))
        .drop("_hash", "_parts")
    )
    right = (
        keyed.withColumn("_hash", _key_hash([F.col(k) for k in on]))
        .join(hot, "_hash", "left")
        .withColumn("_part_r", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_hash", "_parts")
        .withColumnsRenamed({k: f"_k_{k}" for k in on})
    )
    cond = F.col("_part") == F.col("_part_r")
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right, cond, how).drop("_part", "_part_r", *[f"_k_{k}" for k in on])
