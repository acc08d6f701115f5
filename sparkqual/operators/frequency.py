"""Value, mask and pattern distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import kinds, text
from ..functions.values import day_text, half_even, percent
from ..plans.durable import durable
from ..plans.longform import quoted, to_long, value_counts


def value_frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of every value, the null group included.

    All columns share one scan and one shuffle. Order it with `by_frequency` to show it.
    """
    return value_counts(df, list(columns or kinds.flat_columns(df)))


def by_frequency(freq: DataFrame) -> DataFrame:
    """Most frequent first, ties by value."""
    return freq.orderBy("column", F.col("n").desc(), F.col("value").asc())


def _top(freq: DataFrame, k: int) -> DataFrame:
    """First k values per column; each map task forwards at most k rows per column."""
    ranked = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return (
        freq.filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 15) -> DataFrame:
    """(column, value, n, rank) of the k most frequent values, nulls left out."""
    return _top(value_frequency(df, columns), k)


def top_shares(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """(column, value, n, rank, share): percent of all rows, 4 decimals; dates dd-MM-yyyy."""
    names = list(columns or kinds.flat_columns(df))
    times = set(kinds.time_columns(df))
    shown = df.select(*[(day_text(quoted(c)) if c in times else quoted(c)).alias(c) for c in names])
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return _top(value_counts(shown, names), k).withColumn(
        "share", half_even(percent(F.col("n"), rows), 4)
    )


def _distribution(
    df: DataFrame, columns: Sequence[str] | None, classify: Callable[[Column], Column], label: str
) -> DataFrame:
    names = list(columns or kinds.text_columns(df))
    long = to_long(df, names).filter(F.col("value").isNotNull())
    return (
        long.select("column", classify(F.col("value")).alias(label))
        .groupBy("column", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _listed(
    df: DataFrame,
    columns: Sequence[str] | None,
    classify: Callable[[Column], Column],
    label: str,
    top_n: int | None,
) -> DataFrame:
    """Distribution over all rows, or over the rows of the `top_n` most frequent values."""
    if top_n is None:
        return _distribution(df, columns, classify, label)
    names = list(columns or kinds.text_columns(df))
    return (
        top_values(df, names, top_n)
        .groupBy("column", classify(F.col("value")).alias(label))
        .agg(F.sum("n").alias("n"))
    )


def mask_distribution(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int | None = None
) -> DataFrame:
    """(column, mask, n): character classes of the values."""
    return _listed(df, columns, text.mask, "mask", top_n)


def pattern_distribution(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int | None = None
) -> DataFrame:
    """(column, pattern, n): word classes of the values."""
    return _listed(df, columns, text.pattern, "pattern", top_n)


def length_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, mask, n): `L<length>`, nulls as `L` (A20); columns without a letter left out."""
    names = list(columns or kinds.text_columns(df))
    return _of_lettered(to_long(df, names), text.length_mask(F.col("value")), "mask")


def word_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, pattern, n): one W per word (A21); columns without a letter left out."""
    names = list(columns or kinds.text_columns(df))
    long = to_long(df, names).filter(F.col("value").isNotNull())
    return _of_lettered(long, text.word_pattern(F.col("value")), "pattern")


def _of_lettered(long: DataFrame, shape: Column, name: str) -> DataFrame:
    """Counts of a shape of the values, of columns in which any value has a letter.

    Which columns these are is a table of a row per column, so no task sees all shapes of one.
    """
    counts = long.groupBy("column", shape.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("value").rlike("[a-zA-Z]")).alias("_letters")
    )
    lettered = counts.groupBy("column").agg(F.max("_letters").alias("_any")).filter("_any").select("column")
    return counts.join(F.broadcast(lettered), "column", "left_semi").drop("_letters")


def mask_lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shortest and longest mask holding a digit, and holding a letter, per column."""
    masks = mask_distribution(df, columns)
    length = F.length("mask").cast("bigint")
    stats = {}
    for label, mark in (("digit", "D"), ("letter", "L")):
        held = F.when(F.contains(F.col("mask"), F.lit(mark)), length)
        stats[f"{label}_min"] = F.coalesce(F.min(held), F.lit(0))
        stats[f"{label}_max"] = F.coalesce(F.max(held), F.lit(0))
    return masks.groupBy("column").agg(*[agg.alias(name) for name, agg in stats.items()])


def column_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, distinct, first and second most common value with counts)."""
    names = list(columns or kinds.flat_columns(df))
    freq = durable(value_counts(df, names))
    best = _top(freq, 2).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("first_value"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("first_n"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("second_value"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second_n"),
    )
    totals = freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
    )
    return totals.join(best, "column", "left")


def chart_hints(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, listed, show_chart): a frequency chart suits 2 to 5 listed values."""
    listed = top_values(df, columns, 15).groupBy("column").agg(F.count(F.lit(1)).alias("listed"))
    return listed.withColumn("show_chart", F.col("listed").between(2, 5))
