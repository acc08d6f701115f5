"""Checks of an uploaded table (IO13)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.longform import describe_columns, quoted

# File endings an upload may have.
EXTENSIONS = (".csv", ".parquet", ".json", ".xml")


def accepted_file(path: str) -> bool:
    return path.lower().endswith(EXTENSIONS)


def header_problems(columns: Sequence[str], expected: Sequence[str] | None = None) -> list[str]:
    """Unnamed headers, and any difference from the ordered list saved for the source."""
    problems = [
        f"column {i + 1} has no name"
        for i, c in enumerate(columns)
        if not c.strip() or re.fullmatch(r"_c\d+|Unnamed: ?\d+", c)
    ]
    if expected is not None and list(columns) != list(expected):
        problems.append(f"expected columns {list(expected)}, found {list(columns)}")
    return problems


def empty_columns(df: DataFrame) -> DataFrame:
    """(column) of the columns without a single value; one aggregate for all."""
    counts = describe_columns(df, {c: {"values": F.count(quoted(c))} for c in df.columns})
    return counts.filter(F.col("values") == 0).select("column")


def upload_problems(df: DataFrame, expected: Sequence[str] | None = None) -> list[str]:
    """Everything that keeps an upload from being accepted."""
    empty = [r["column"] for r in empty_columns(df).collect()]
    return header_problems(df.columns, expected) + [f"column {c} is empty" for c in empty]
