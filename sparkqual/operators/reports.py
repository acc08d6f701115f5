"""Column reports by business term."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.values import to_number
from ..plans.bands import band_quantiles
from ..plans.longform import describe_columns, quoted, union_all
from . import catalog, frequency, profile, suggest


def value_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, average, mean, median, minimum, maximum) with null and text as 0."""
    numbers = df.select(*[F.coalesce(to_number(quoted(c)), F.lit(0.0)).alias(c) for c in columns])
    moments = describe_columns(
        numbers,
        {
            c: {
                "average": F.avg(quoted(c)),
                "mean": F.avg(quoted(c)),
                "minimum": F.min(quoted(c)),
                "maximum": F.max(quoted(c)),
            }
            for c in columns
        },
    )
    middle = band_quantiles(numbers, list(columns), [0.5]).select("column", F.col("p0").alias("median"))
    return moments.join(middle, "column")


def length_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A38"""
    return profile.length_profile(df, columns)


def report(
    df: DataFrame, terms: Mapping[str, str], rules: Mapping[str, Sequence[str]]
) -> DataFrame:
    """(term, column, statistic, item, value): every asked statistic per business term (K5).

    `terms` maps a business term to its column, `rules` a term to the statistics asked for
    (ValueStatistics, LengthStatistics, Frequency, Outliers).
    """
    def asked(statistic: str) -> list[str]:
        return list(dict.fromkeys(terms[t] for t, names in rules.items() if statistic in names))

    frames = []
    for statistic, compute in (
        ("ValueStatistics", value_statistics),
        ("LengthStatistics", length_statistics),
        ("Outliers", lambda d, c: profile.outlier_shares(d, c, ddof=1)),
    ):
        columns = asked(statistic)
        if columns:
            wide = compute(df, columns)
            items = [c for c in wide.columns if c != "column"]
            typed = wide.select("column", *[F.col(c).cast("double").alias(c) for c in items])
            frames.append(
                typed.unpivot(["column"], items, "item", "value").withColumn("statistic", F.lit(statistic))
            )
    columns = asked("Frequency")
    if columns:
        top = frequency.top_values(df, columns, 15)
        frames.append(
            top.select(
                "column",
                F.col("value").alias("item"),
                F.col("n").cast("double").alias("value"),
                F.lit("Frequency").alias("statistic"),
            )
        )
    found = union_all(frames)
    wanted = F.array(
        *[
            F.struct(F.lit(t).alias("term"), F.lit(terms[t]).alias("_c"), F.lit(s).alias("_s"))
            for t, names in rules.items()
            for s in names
        ]
    )
    return (
        found.select("column", "statistic", "item", "value", F.inline(wanted))
        .filter((F.col("_c") == F.col("column")) & (F.col("_s") == F.col("statistic")))
        .select("term", "column", "statistic", "item", "value")
    )


def proposals_for_terms(df: DataFrame, catalogue: DataFrame, terms: DataFrame) -> DataFrame:
    """(column, BusinessTerm, statistic): report rules of the columns behind catalogue terms (K6)."""
    entries = catalog.catalogue_for_terms(catalogue, terms)
    rules = suggest.report_rules(df)
    return rules.join(
        entries.select(F.lower("Column").alias("_lower"), "BusinessTerm"),
        F.lower("column") == F.col("_lower"),
    ).select("column", "BusinessTerm", "statistic")
