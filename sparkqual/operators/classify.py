"""Semantic column classes from one frequency pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kinds
from ..plans.longform import describe_columns, quoted, value_counts

# Limits of the decision table.
LONG_TEXT = 30
CATEGORY_LIMIT = 15
NULL_SHARE = 0.90
YEARS = (1900, 2050)
SMALL_INTEGER = (25, 9)

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _facts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, kind, n, nulls, lowest, highest, mean_length, distinct) per column."""
    stats = {}
    for c in names:
        kind = df.schema[c].dataType
        is_text = isinstance(kind, T.StringType)
        number = quoted(c).cast("double") if isinstance(kind, _WHOLE) else F.lit(None).cast("double")
        length = F.length(F.coalesce(quoted(c), F.lit("  "))) if is_text else F.lit(None).cast("int")
        stats[c] = {
            "kind": F.lit(_kind(kind)),
            "n": F.count(F.lit(1)),
            "nulls": F.count_if(quoted(c).isNull()),
            "lowest": F.min(number),
            "highest": F.max(number),
            "mean_length": F.avg(length),
        }
    distinct = value_counts(df, names).groupBy("column").agg(F.count("value").alias("distinct"))
    return describe_columns(df, stats).join(distinct, "column")


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, _WHOLE):
        return "whole"
    if isinstance(kind, T.NumericType):
        return "fraction"
    return "time"


def _decision() -> Column:
    kind, n, d = F.col("kind"), F.col("n"), F.col("distinct")
    nulls = F.col("nulls")
    # Text nulls count as one more value once they are filled with blanks.
    filled = d + F.when(nulls > 0, 1).otherwise(0)
    most = F.floor(F.lit(0.9) * n)
    long_text = F.col("mean_length") >= LONG_TEXT
    year_like = F.col("lowest").between(*YEARS) & F.col("highest").between(*YEARS)
    text = (
        F.when(long_text & (filled <= most), "nlp")
        .when((filled >= CATEGORY_LIMIT) & (filled <= most), "discrete_string")
        .when((filled >= CATEGORY_LIMIT) & (filled == n), "id")
        .when((filled < CATEGORY_LIMIT) & (d == n), "id")
        .when(filled < CATEGORY_LIMIT, "cat")
        .when(long_text, "nlp")
        .otherwise("discrete_string")
    )
    return (
        F.when((d == 1) | (nulls >= NULL_SHARE * n), "delete")
        .when(kind.isin("text", "bool") & (d == 2), "string_bool")
        .when(kind.isin("whole", "fraction") & (d == 2), "num_bool")
        .when(kind == "text", text)
        .when(kind == "bool", "string_bool")
        .when((kind == "whole") & year_like, "date")
        .when((kind == "whole") & (d == n), "id")
        .when(kind == "whole", "int")
        .when(kind == "fraction", "continuous")
        .otherwise("date")
    )


def classify_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, class): delete, string_bool, num_bool, nlp, discrete_string, cat, id, int,
    date, continuous (C1)."""
    names = list(columns or kinds.flat_columns(df))
    return _facts(df, names).select("column", _decision().alias("class"))


def integer_categories(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes in which small whole-number columns become categories.

    Fewer than 25 values, the rarest seen more than 9 times.
    """
    limit, rarest = SMALL_INTEGER
    whole = [f.name for f in df.schema if isinstance(f.dataType, _WHOLE)]
    if not whole:
        return classes
    small = (
        value_counts(df, whole)
        .filter(F.col("value").isNotNull())
        .groupBy("column")
        .agg(((F.count(F.lit(1)) < limit) & (F.min("n") > rarest)).alias("_small"))
    )
    becomes = F.col("_small") & (F.col("class") == "int")
    return (
        classes.join(small, "column", "left")
        .withColumn("class", F.when(becomes, "cat").otherwise(F.col("class")))
        .drop("_small")
    )
