"""De-duplication and set operations.

Groups are aggregated before they are shuffled: a row repeated in a third of the table
costs one row per map task, and no task holds all copies of a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.longform import quoted
from ..plans.skew import join_unique


def deduplicate(
    df: DataFrame, subset: Sequence[str], order: str, keep: str = "first"
) -> DataFrame:
    """One row per distinct `subset` values: the first or the last by `order`, or (`none`)
    only the rows without a double (U3, W4). `order` must be unique per row."""
    rest = [c for c in df.columns if c not in subset]
    row = F.struct(*[quoted(c) for c in (order, *[c for c in rest if c != order])])
    if keep == "first":
        picked = F.min_by(row, quoted(order))
    elif keep == "last":
        picked = F.max_by(row, quoted(order))
    elif keep == "none":
        picked = F.when(F.count(F.lit(1)) == 1, F.min_by(row, quoted(order)))
    else:
        raise ValueError("keep is first, last or none")
    groups = df.groupBy(*[quoted(c) for c in subset]).agg(picked.alias("_row"))
    return groups.filter(F.col("_row").isNotNull()).select(
        *[quoted(c) if c in subset else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def duplicate_members(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """All rows whose `subset` values occur more than once."""
    keys = list(subset or df.columns)
    repeated = (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
    )
    plain = df.withColumns({f"_key{i}": quoted(k) for i, k in enumerate(keys)})
    keyed = repeated.select(*[quoted(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_copies")
    names = [f"_key{i}" for i in range(len(keys))]
    return join_unique(plain, keyed, names, "left_semi", "_copies").drop(*names)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of all rows; a column one frame lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur exactly once in both frames taken together."""
    names = a.columns
    return (
        a.unionByName(b)
        .groupBy(*[quoted(c) for c in names])
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n = 1")
        .drop("_n")
    )
