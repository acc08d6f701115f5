"""Column and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kinds, text
from ..functions.values import half_even, is_missing, percent, to_number
from ..plans.bands import band_quantiles
from ..plans.durable import durable
from ..plans.longform import describe_columns, quoted, union_all, value_counts
from ..plans.ranks import exact_quantiles, quantiles


def _as_number(df: DataFrame, name: str) -> Column:
    """The column as a double: NaN and text that is no number become null."""
    kind, c = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None)).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return to_number(c)
    return F.lit(None).cast("double")


def table_counts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate groups, duplicate rows, missing cells (A1-A3, A5).

    Equal rows are grouped once; every total is a weighted sum over the groups.
    """
    names = df.columns
    missing = sum((is_missing(df, c).cast("bigint") for c in names), F.lit(0).cast("bigint"))
    groups = (
        df.withColumn("_missing", missing)
        .groupBy(*[quoted(c) for c in names], "_missing")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.lit(len(names)).cast("bigint").alias("column_count"),
        F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("_n") * F.col("_missing")), F.lit(0)).alias("missing_cells"),
    )


def type_labels(df: DataFrame) -> dict[str, str]:
    """Column -> Numeric, Alphanumeric, DateTime, Boolean or Other (C4)."""
    return {f.name: kinds.type_label(f) for f in df.schema}


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, missing_pct): null, NaN or empty text per column (A5)."""
    names = list(columns or df.columns)
    return describe_columns(
        df,
        {
            c: {
                "missing": F.count_if(is_missing(df, c)),
                "missing_pct": percent(F.count_if(is_missing(df, c)), F.count(F.lit(1))),
            }
            for c in names
        },
    )


def distinct_estimates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, approx_distinct) from one scan (A10)."""
    names = list(columns or kinds.flat_columns(df))
    return describe_columns(
        df, {c: {"approx_distinct": F.approx_count_distinct(quoted(c))} for c in names}
    )


def scalar_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    accuracy: int = 1000,
) -> DataFrame:
    """One row per column with counts, range, moments and text lengths.

    The moments of all columns come from one scan. `exact=True` adds a frequency pass for
    the distinct count and the median; `exact=False` stays with one scan and sketches, the
    median then lies within 1 / `accuracy` of the middle rank.
    """
    names = list(columns or kinds.flat_columns(df))
    # Numbers and lengths are computed once per row, not once per aggregate.
    cells = df.select(
        *[quoted(c) for c in names],
        *[_as_number(df, c).alias(f"_number_{i}") for i, c in enumerate(names)],
        *[text.text_length(quoted(c)).alias(f"_length_{i}") for i, c in enumerate(names)],
    )
    stats = {}
    for i, c in enumerate(names):
        number, length = F.col(f"_number_{i}"), F.col(f"_length_{i}")
        stats[c] = {
            "type": F.lit(kinds.type_label(df.schema[c])),
            "n": F.count(F.lit(1)),
            "missing": F.count_if(is_missing(df, c)),
            "min": F.min(quoted(c)).cast("string"),
            "max": F.max(quoted(c)).cast("string"),
            "mean": F.avg(number),
            "std": F.stddev_samp(number),
            "min_length": F.min(length).cast("bigint"),
            "max_length": F.max(length).cast("bigint"),
            "mean_length": F.avg(length),
        }
        if not exact:
            stats[c]["distinct"] = F.approx_count_distinct(quoted(c))
            stats[c]["median"] = F.percentile_approx(number, 0.5, accuracy).cast("double")
    # Text minima rule out hash aggregation, so text columns get batches of their own.
    words = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    moments = union_all(
        [
            describe_columns(cells, {c: stats[c] for c in part})
            for part in ([c for c in names if c not in words], words)
            if part
        ]
    )
    if not exact:
        return moments
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in names if c not in numeric]
    frames = []
    if numeric:
        frames.append(
            exact_quantiles(df, numeric, [0.5]).withColumnRenamed("p0", "median")
        )
    if others:
        frames.append(
            value_counts(df, others)
            .groupBy("column")
            .agg(F.count("value").alias("distinct"), F.lit(None).cast("double").alias("median"))
        )
    found = union_all(frames).select("column", "distinct", "median")
    return moments.join(found, "column", "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0))
    )


def length_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, mean and exact median of text lengths) over non-null rows."""
    names = list(columns or kinds.flat_columns(df))
    lengths = df.select(*[text.text_length(quoted(c)).alias(c) for c in names])
    middle = band_quantiles(lengths, names, [0.5]).select(
        "column", F.col("p0").alias("median_length")
    )
    span = describe_columns(
        lengths,
        {
            c: {
                "min_length": F.min(quoted(c)).cast("bigint"),
                "max_length": F.max(quoted(c)).cast("bigint"),
                "mean_length": F.avg(quoted(c)),
            }
            for c in names
        },
    )
    return span.join(middle, "column", "left")


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: counts, lengths of distinct values, character classes.

    Computed from the value-frequency table, so regular expressions run once per distinct
    value. `outlier_pct` is the share of the rarest class when it lies in (0, 4) %.
    """
    names = list(columns or kinds.text_columns(df))
    freq = durable(value_counts(df, names))
    value, n = F.col("value"), F.col("n")

    def rows_where(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    base = freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("non_null"),
        rows_where(value.isNull()).alias("nulls"),
        F.count(value).alias("distinct"),
        F.min(F.length(value)).cast("bigint").alias("min_length"),
        F.max(F.length(value)).cast("bigint").alias("max_length"),
        F.avg(F.length(value)).alias("mean_length"),
        rows_where(text.is_alpha(value)).alias("alphabetic"),
        rows_where(text.is_number_text(value)).alias("numeric"),
        rows_where(text.is_alnum(value)).alias("_alnum"),
    )
    lengths = (
        freq.filter(value.isNotNull())
        .groupBy("column", F.length("value").cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    middle = quantiles(lengths, ["column"], "value", [0.5]).select(
        "column", F.col("p0").alias("median_length")
    )
    classes = ("alphabetic", "numeric", "alphanumeric")
    most = F.greatest(*[F.col(k) for k in classes])
    shares = [F.col(f"{k}_pct") for k in classes]
    minority = F.array_min(F.filter(F.array(*shares), lambda s: (s > 0) & (s < 4)))
    return (
        base.withColumn("alphanumeric", F.col("_alnum") - F.col("alphabetic") - F.col("numeric"))
        .drop("_alnum")
        .withColumns({f"{k}_pct": half_even(percent(F.col(k), F.col("non_null")), 2) for k in classes})
        .withColumn(
            "suggested_type",
            F.when(most == F.col("alphabetic"), "Alphabetic")
            .when(most == F.col("numeric"), "Numeric")
            .otherwise("Alphanumeric"),
        )
        .withColumn("duplicates", F.col("non_null") - F.col("distinct"))
        .withColumn("outlier_pct", F.coalesce(minority, F.lit(0.0)))
        .join(middle, "column", "left")
    )


# How a time column is shown and masked, by its name.
TIME_FORMATS = {"time": ("HH:mm:ss", "HH:MM:SS")}
DAY_FORMAT = ("dd/MM/yyyy", "DD/MM/YYYY")


def time_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, records, nulls, first, last, mask) of date and time columns."""
    names = list(columns or kinds.time_columns(df))
    stats = {}
    for c in names:
        shown, masked = TIME_FORMATS.get(c.lower(), DAY_FORMAT)
        stats[c] = {
            "records": F.count(F.lit(1)),
            "nulls": F.count_if(quoted(c).isNull()),
            "first": F.date_format(F.min(quoted(c)), shown),
            "last": F.date_format(F.max(quoted(c)), shown),
            "mask": F.lit(masked),
        }
    return describe_columns(df, stats)


def time_frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of the formatted dates or times."""
    names = list(columns or kinds.time_columns(df))
    shown = df.select(
        *[F.date_format(quoted(c), TIME_FORMATS.get(c.lower(), DAY_FORMAT)[0]).alias(c) for c in names]
    )
    return value_counts(shown, names).filter(F.col("value").isNotNull())


def _bounds(df: DataFrame, names: Sequence[str], ddof: int, width: float) -> Column:
    """Scalar sub-query: struct of column -> (lower, upper)."""
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    fields = []
    for i, c in enumerate(names):
        x = _as_number(df, c)
        fields.append(
            F.struct(
                (F.avg(x) - width * spread(x)).alias("lower"),
                (F.avg(x) + width * spread(x)).alias("upper"),
            ).alias(f"b{i}")
        )
    return df.agg(F.struct(*fields).alias("bounds")).scalar()


def outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    ddof: int = 0,
    width: float = 3.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(`keep`, column, value) of values beyond mean +- width * deviation.

    The bounds enter the scan as a scalar sub-query: no join, nothing collected.
    """
    names = list(columns or kinds.numeric_columns(df))
    flagged = df.withColumn("_bounds", _bounds(df, names, ddof, width))
    cells = []
    for i, c in enumerate(names):
        x, b = _as_number(df, c), F.col("_bounds").getField(f"b{i}")
        beyond = (x > b.getField("upper")) | (x < b.getField("lower"))
        cells.append(F.when(beyond, F.struct(F.lit(c).alias("column"), x.alias("value"))))
    hits = F.filter(F.array(*cells), lambda h: h.isNotNull())
    return flagged.select(*[quoted(k) for k in keep], F.inline(hits))


def outlier_shares(
    df: DataFrame, columns: Sequence[str] | None = None, ddof: int = 0, width: float = 3.0
) -> DataFrame:
    """(column, outliers, outlier_pct, normal_pct) on the non-null count."""
    names = list(columns or kinds.numeric_columns(df))
    flagged = df.withColumn("_bounds", _bounds(df, names, ddof, width))
    stats = {}
    for i, c in enumerate(names):
        x, b = _as_number(df, c), F.col("_bounds").getField(f"b{i}")
        hit = F.count_if((x > b.getField("upper")) | (x < b.getField("lower")))
        stats[c] = {
            "outliers": hit,
            "outlier_pct": percent(hit, F.count(x)),
            "normal_pct": percent(F.count(x) - hit, F.count(x)),
        }
    return describe_columns(flagged, stats)


def prediction_targets(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = 10
) -> DataFrame:
    """(column, distinct) of columns with at most `limit` values, fewest first.

    Exact. A first scan marks the slots (of 64) that a column's hashed values fall into: more
    slots than the limit prove more values, and such columns are not counted.
    """
    names = list(columns or kinds.flat_columns(df))
    slot = {c: F.pmod(F.xxhash64(quoted(c)), F.lit(64)).cast("int") for c in names}
    marks = [
        F.bit_or(F.when(quoted(c).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot[c]))).alias(c)
        for c in names
    ]
    seen = df.agg(*[F.bit_count(F.coalesce(m, F.lit(0).cast("bigint"))).alias(c) for m, c in zip(marks, names)]).first()
    near = [c for c in names if seen[c] <= limit]
    if not near:
        return df.sparkSession.createDataFrame([], "column string, distinct bigint")
    return (
        value_counts(df, near)
        .groupBy("column")
        .agg(F.count("value").alias("distinct"))
        .filter(F.col("distinct") <= limit)
        .orderBy("distinct", "column")
    )


def profile_document(df: DataFrame) -> dict[str, DataFrame]:
    """The whole profile of a table as named DataFrames (A40): caller writes or collects."""
    from . import association, frequency

    numeric, words, times = kinds.numeric_columns(df), kinds.text_columns(df), kinds.time_columns(df)
    flat = kinds.flat_columns(df)
    parts = {
        "table": table_counts(df),
        "columns": scalar_profile(df, flat),
        "frequency": frequency.top_values(df, flat, 15),
        "top_shares": frequency.top_shares(df, flat, 3),
    }
    if words:
        parts["text"] = text_profile(df, words)
        parts["masks"] = frequency.mask_distribution(df, words)
        parts["patterns"] = frequency.pattern_distribution(df, words)
    if times:
        parts["times"] = time_profile(df, times)
    if numeric:
        parts["outliers"] = outlier_shares(df, numeric, ddof=1)
    if len(numeric) > 1:
        parts["correlations"] = association.correlation(df, numeric)
    return parts
