"""Numbers, dates, missing values and JSON."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.longform import quoted

# Day-first date formats tried in this order, then ISO.
DAY_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd")
TIMES = ("HH:mm:ss", "HH:mm")
ISO_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


# A decimal number, blanks around it allowed; no suffixes, hexadecimal forms or words.
_NUMBER = r"^[\x00-\x20]*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[\x00-\x20]*\z"


def to_number(c: Column) -> Column:
    """The value as a double; text that is no decimal number becomes null.

    Other text is sorted out first: a cast also reads forms such as `1d`, and a failing one costs
    an exception per row.
    """
    return F.when(c.cast("string").rlike(_NUMBER), c.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null instead of an error when b is 0."""
    return F.try_divide(a, b)


def percent(part: Column, whole: Column) -> Column:
    return ratio(F.lit(100.0) * part, whole)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def parse_time(c: Column, formats: Sequence[str] = DAY_FIRST) -> Column:
    """First format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_instant(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(ISO_INSTANT))


def day_text(c: Column) -> Column:
    return F.date_format(c, "dd-MM-yyyy")


def is_missing(df: DataFrame, name: str, empty_text: bool = True) -> Column:
    """Null, NaN for fractions, and (by default) empty text."""
    kind, c = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType) and empty_text:
        return c.isNull() | (c == "")
    return c.isNull()


def finite_or_zero(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def overlaps(c: Column, values: Sequence[str]) -> Column:
    return F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def shown(c: Column, missing: str = "None") -> Column:
    """Text for display only; stored values keep their nulls."""
    return F.coalesce(c.cast("string"), F.lit(missing))
