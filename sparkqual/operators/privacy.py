"""Personal data: find it, mask it, or replace a table by codes."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kinds
from ..plans.durable import durable
from ..plans.longform import describe_columns, quoted, value_counts
from ..plans.ranks import running_totals
from ..plans.skew import BROADCAST_BYTES, BROADCAST_ROWS, join_unique

# The classes of personal data in the order they are masked, and the words
# masked in every text column.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "address": r"(?i)\b(?:\d+\s+\w+\s\w+|\w+\s+\w+),?\s*(?:[A-Z]{2}|U\.S\.A\.|\d{6})\b",
    "age": r"\b\d{1,3}\b",
    "phone": r"\+?\d{0,3}\s?\d{3}[-\s]?\d{3}[-\s]?\d{4}",
    "name": r"(?i)\b(?:Mr\.|Ms\.|Miss\.|Prof\.|Dr\.|[A-Z][a-z]*)?\s*[A-Z][a-z]+\b",
    "number": r"(\d+(?:\.\d+)?(?:,\s*\d+(?:\.\d+)?)*?)",
}
GENDER_WORDS = ("male", "female", "lesbian", "gay", "transgender", "non-binary")
# A text every match of a class holds: values without it are not searched.
HELD = {"email": "@"}
# Classes whose presence makes a column a masked one.
TRIGGERS = ("email", "address", "age", "phone", "name")
MASK = "***"


# JVM versions disagree on what a plain word boundary is, so the ASCII one is spelled out.
_ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _flavoured(pattern: str, unicode: bool) -> str:
    """Word characters and digits of every script, or ASCII only."""
    return "(?U)" + pattern if unicode else pattern.replace(r"\b", _ASCII_BOUNDARY)


def _held(cell: Column, name: str, pattern: str) -> Column | None:
    """A cheap test that every match implies, for the patterns it is known for."""
    return F.contains(cell, F.lit(HELD[name])) if name in HELD and pattern == PATTERNS[name] else None


def _matches(cell: Column, name: str, pattern: str, unicode: bool) -> Column:
    hit, held = cell.rlike(_flavoured(pattern, unicode)), _held(cell, name, pattern)
    return hit if held is None else held & hit


def _masked(cell: Column, name: str, pattern: str, unicode: bool) -> Column:
    out, held = F.regexp_replace(cell, _flavoured(pattern, unicode), F.lit(MASK)), _held(cell, name, pattern)
    return out if held is None else F.when(held, out).otherwise(cell)


def _without_gender(c: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.StringType):
        return c.cast("string")
    return F.regexp_replace(c, "(?i)" + "|".join(GENDER_WORDS), MASK)


def detect_personal_data(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    patterns: Mapping[str, str] = PATTERNS,
    unicode: bool = True,
) -> DataFrame:
    """(column, class, hits): rows of each column that match each class."""
    names = list(columns or kinds.flat_columns(df))
    stats = {}
    for c in names:
        cell = _without_gender(quoted(c), df.schema[c].dataType)
        stats[c] = {k: F.count_if(_matches(cell, k, p, unicode)) for k, p in patterns.items()}
    wide = describe_columns(df, stats)
    return wide.unpivot(["column"], list(patterns), "class", "hits")


def mask_personal_data(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    patterns: Mapping[str, str] = PATTERNS,
    triggers: Sequence[str] = TRIGGERS,
    unicode: bool = True,
) -> DataFrame:
    """Every cell as text, personal data replaced by `***`.

    A column in which any value matches a trigger class is masked by all classes in order;
    gender words are masked in every text column. Whether a column is masked is a scalar
    sub-query that reads this column only and stops at the first match of each task. Nulls
    stay null.
    """
    names = list(columns or kinds.flat_columns(df))
    # A projection of its own: each cell is rid of gender words once, then used repeatedly.
    cells = df.select(
        *[
            (_without_gender(quoted(f.name), f.dataType) if f.name in names else quoted(f.name)).alias(f.name)
            for f in df.schema
        ]
    )

    def triggered(c: str) -> Column:
        tests = [_matches(quoted(c), k, patterns[k], unicode) for k in triggers]
        hit = functools.reduce(lambda a, b: a | b, tests)
        return cells.filter(hit).limit(1).select(F.lit(True)).scalar()

    out = []
    for c in df.columns:
        cell = quoted(c)
        if c in names:
            masked = cell
            for name, pattern in patterns.items():
                masked = _masked(masked, name, pattern, unicode)
            cell = F.when(triggered(c), masked).otherwise(cell)
        out.append(cell.alias(c))
    return cells.select(*out)


def anonymise(
    df: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(anonymised table, mapping (column, value, code)).

    Text nulls take the mode, values become their position in ascending order; numeric nulls
    become 0 and the column is scaled by its population deviation (a constant one is only centred).
    One scan counts the values of all text columns, which gives the modes and one dictionary of codes for
    all; one scan takes the moments; the last one looks up the codes of all columns. Codes of
    columns with very many values are joined by value, hot ones split.
    """
    names = list(columns or kinds.flat_columns(df))
    words = [c for c in names if c in kinds.nominal_columns(df)]
    numbers = [c for c in names if c in kinds.numeric_columns(df)]
    number = {c: F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in numbers}
    moments = (
        df.agg(
            *[F.avg(number[c]).alias(f"m{i}") for i, c in enumerate(numbers)],
            *[F.stddev_pop(number[c]).alias(f"s{i}") for i, c in enumerate(numbers)],
        ).first()
        if numbers
        else {}
    )
    scaled = {}
    for i, c in enumerate(numbers):
        scaled[c] = (number[c] - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"] or 1.0)
    if not words:
        empty = df.sparkSession.createDataFrame([], "column string, value string, code bigint")
        return df.select(*[scaled[c].alias(c) if c in scaled else quoted(c) for c in df.columns]), empty
    counts = durable(value_counts(df, words))
    first = counts.filter("value is not null").groupBy("column").agg(F.min(F.struct(-F.col("n"), "value")).alias("first"))
    modes = {r["column"]: r["first"]["value"] for r in first.collect()}
    mode = functools.reduce(
        lambda out, c: F.when(F.col("column") == c, F.lit(modes[c])).otherwise(out), modes, F.lit(None).cast("string")
    )
    whole = counts.withColumn("value", F.coalesce("value", mode)).filter("value is not null")
    whole = whole.groupBy("column", "value").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1).cast("bigint"))
    codes = durable(
        running_totals(whole, ["column"], "value", ["one"]).select("column", "value", "n", F.col("before_one").alias("code"))
    )
    sizes = {
        r["column"]: r
        for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes")).collect()
    }
    at = {c: f"_word{i}" for i, c in enumerate(words)}
    filled = [F.coalesce(quoted(c).cast("string"), F.lit(modes.get(c))).alias(x) for c, x in at.items()]
    out = df.select(*[scaled[c].alias(c) if c in scaled else quoted(c) for c in df.columns if c not in words], *filled)
    for c, x in at.items():
        keyed = codes.filter(F.col("column") == c).select(F.col("value").alias(x), F.col("code").alias(f"{x}_code"), "n")
        size = sizes.get(c, {"rows": 0, "bytes": 0})
        if size["rows"] * len(words) <= BROADCAST_ROWS and (size["bytes"] or 0) * len(words) <= BROADCAST_BYTES:
            out = out.join(F.broadcast(keyed.drop("n")), x, "left")
        else:
            out = join_unique(out, keyed.withColumnRenamed("n", "_rows"), [x], "left", "_rows").drop("_rows")
    done = out.select(*[F.col(f"{at[c]}_code").alias(c) if c in at else quoted(c) for c in df.columns])
    return done, codes.select("column", "value", "code")
