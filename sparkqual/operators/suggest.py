"""Rule proposals from the data (Q19-Q21)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kinds
from ..functions.rules import measured_length
from ..plans.longform import describe_columns, quoted
from . import classify

# Proposed formats by kind of column.
FORMATS = {"Alphanumeric": "WWWDDD", "Numeric": "###.##", "DateTime": "%d-%m-%Y"}
DATA_TYPES = {"Alphanumeric": "Text", "Numeric": "Numeric", "DateTime": "Datetime"}


def _rule(rule: str, value: Column | str, operator: str, dimension: str) -> Column:
    shown = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(
        F.lit(rule).alias("rule"),
        shown.alias("value"),
        F.lit(operator).alias("operator"),
        F.lit(dimension).alias("dimension"),
    )


def _typed(df: DataFrame, columns: Sequence[str] | None) -> dict[str, str]:
    names = list(columns or kinds.flat_columns(df))
    labels = {c: kinds.type_label(df.schema[c]) for c in names}
    return {c: label for c, label in labels.items() if label in FORMATS}


def default_rules(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rule, value, operator, dimension): data type and lengths of every column (Q19).

    One length if all values share it, else a longest and a shortest; digits are counted for
    numbers. The whole column is measured.
    """
    labels = _typed(df, columns)
    stats = {
        c: {
            "label": F.lit(label),
            "shortest": F.min(measured_length(df, c)),
            "longest": F.max(measured_length(df, c)),
        }
        for c, label in labels.items()
    }
    measured = describe_columns(df, stats)
    of_type = F.lit(None).cast("string")
    for label, name in DATA_TYPES.items():
        of_type = F.when(F.col("label") == label, name).otherwise(of_type)
    kind = _rule("DataType", of_type, "Shouldbe", "Validity")
    same = F.array(kind, _rule("Length", F.col("longest"), "equalto", "Validity"))
    apart = F.array(
        kind,
        _rule("MaxLength", F.col("longest"), "equalto", "Validity"),
        _rule("MinLength", F.col("shortest"), "equalto", "Validity"),
    )
    proposed = (
        F.when(F.col("shortest").isNull(), F.array(kind))
        .when(F.col("shortest") == F.col("longest"), same)
        .otherwise(apart)
    )
    return measured.select("column", F.inline(proposed))


def as_ruleset(rules: DataFrame) -> list[dict]:
    """A proposal table as a rule set (a few rows per column)."""
    grouped: dict[str, list[dict]] = defaultdict(list)
    for row in rules.collect():
        grouped[row["column"]].append(
            {k: row[k] for k in ("rule", "value", "operator", "dimension")}
        )
    return [{"column": c, "rules": found} for c, found in grouped.items()]


def _measured(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, non_null) of the columns that hold any value."""
    stats = {
        c: {"label": F.lit(kinds.type_label(df.schema[c])), "non_null": F.count(quoted(c))}
        for c in columns
    }
    return describe_columns(df, stats).filter(F.col("non_null") > 0)


def standard_rules(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rule, value, non_null): a format per column that holds values (Q20)."""
    found = _measured(df, list(_typed(df, columns)))
    value = F.lit(None).cast("string")
    for label, fmt in FORMATS.items():
        value = F.when(F.col("label") == label, fmt).otherwise(value)
    return found.select("column", F.lit("Format").alias("rule"), value.alias("value"), "non_null")


def merge_rules(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rule, value, non_null): survivorship proposals for every non-key column (Q20)."""
    names = [c for c in (columns or kinds.flat_columns(df)) if c != key]
    both = F.array(
        F.struct(F.lit("ANY").alias("rule"), F.lit("NONEMPTY").alias("value")),
        F.struct(F.lit("DIFF").alias("rule"), F.lit("S1").alias("value")),
    )
    return _measured(df, names).select("column", F.inline(both), "non_null")


def report_rules(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, statistic): which report statistics suit a column (Q21).

    Text: lengths; numbers: values, lengths, outliers; dates: values, outliers; categories
    get a frequency as well.
    """
    labels = _typed(df, columns)
    classes = classify.integer_categories(df, classify.classify_columns(df, list(labels)))
    suited = F.lit(None).cast("array<string>")
    for label, stats in {
        "Alphanumeric": ["LengthStatistics"],
        "Numeric": ["ValueStatistics", "LengthStatistics", "Outliers"],
        "DateTime": ["ValueStatistics", "Outliers"],
    }.items():
        names = [c for c, kind in labels.items() if kind == label]
        if names:
            suited = F.when(F.col("column").isin(names), F.array(*[F.lit(s) for s in stats])).otherwise(suited)
    categories = F.col("class").isin("cat", "string_bool", "num_bool")
    listed = F.when(categories, F.concat(suited, F.array(F.lit("Frequency")))).otherwise(suited)
    return classes.select("column", F.explode(listed).alias("statistic"))
