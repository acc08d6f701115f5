"""Running totals, ranks and exact quantiles without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .bands import band_quantiles
from .durable import durable
from .longform import native_counts, union_all, value_counts


def _ranged(
    counts: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows in ranges of (keys, order), and the totals of every range.

    Rows are range partitioned and written once, so the part a row belongs to is fixed. The
    second table has one row per part and key: `_part_<w>`, `_offset_<w>` (earlier parts of
    the key) and `total_<w>` (the whole key).
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        counts.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id())
    )
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(w).alias(f"_part_{w}") for w in weights])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, "_part")],
        *[F.col(f"_part_{w}") for w in weights],
        *[F.coalesce(F.sum(f"_part_{w}").over(earlier), F.lit(0)).alias(f"_offset_{w}") for w in weights],
        *[F.sum(f"_part_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    return ranged, totals


def _totalled(
    ranged: DataFrame, totals: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str]
) -> DataFrame:
    """Rows of the parts in `totals` with `before_<w>` and `total_<w>`."""
    same: Column = F.col("_part") == F.col("_k__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (
        Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return ranged.join(totals, same).select(
        *[c for c in ranged.columns if c != "_part"],
        *[
            (F.col(f"_offset_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"before_{w}")
            for w in weights
        ],
        *[F.col(f"total_{w}") for w in weights],
    )


def running_totals(
    counts: DataFrame, keys: Sequence[str], order: str, weights: Sequence[str]
) -> DataFrame:
    """Add `before_<w>` (sum of a weight over smaller `order` values of the same keys) and
    `total_<w>` (its sum over the keys). `counts` has one row per (keys, order).

    Totals of whole parts are summed over at most one row per part, and only rows inside one
    part are ordered by a window. No task ever holds all rows of a key.
    """
    ranged, totals = _ranged(counts, keys, order, weights)
    return _totalled(ranged, totals, keys, order, weights)


def quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    weights: Sequence[str] = (),
) -> DataFrame:
    """(keys, total_n, total_<w>, p0, p1, ...): linear-interpolated quantiles of (value, n).

    Part totals tell which parts hold a wanted position; only those are read and ordered.
    """
    weights = ["n", *weights]
    ranged, totals = _ranged(counts, keys, value, weights)

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("total_n") - 1)

    def holds(start: Column, length: Column) -> Column:
        hit = F.lit(False)
        for p in probs:
            hit = hit | ((start <= F.ceil(position(p))) & (F.floor(position(p)) < start + length))
        return hit

    parts = totals.filter(holds(F.col("_offset_n"), F.col("_part_n")))
    rows = _totalled(ranged, parts, keys, value, weights)
    rows = rows.filter(holds(F.col("before_n"), F.col("n")))
    aggs, out = [F.max(f"total_{w}").alias(f"total_{w}") for w in weights], []
    for i, p in enumerate(probs):
        for side, index in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            here = (F.col("before_n") <= index) & (index < F.col("before_n") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{side}{i}"))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * (position(p) - F.floor(position(p)))).alias(f"p{i}"))
    picked = rows.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[f"total_{w}" for w in weights], *out)


def numeric_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value DOUBLE, n), one row per distinct number; nulls and NaN left out.

    Whole numbers are grouped as such, so large ids stay distinct.
    """
    frames = []
    for counts, kind in native_counts(df, columns):
        kept = counts.filter(F.col("value").isNotNull())
        if isinstance(kind, T.DoubleType):
            kept = kept.filter(~F.isnan("value"))
        frames.append(kept.withColumn("value", F.col("value").cast("double")))
    return union_all(frames)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, distinct, p0, p1, ...) of numeric columns, nulls and NaN left out; exact."""
    distinct = numeric_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    found = band_quantiles(df, columns, probs)
    return distinct.join(F.broadcast(found), "column").select("column", "distinct", *[f"p{i}" for i in range(len(probs))])


def dense_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, code): codes 0, 1, ... in ascending value order, nulls left out."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    ones = counts.withColumn("one", F.lit(1).cast("bigint"))
    return running_totals(ones, ["column"], "value", ["one"]).select(
        "column", "value", "n", F.col("before_one").alias("code")
    )
