"""Text predicates and transforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The character classes of a mask.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_OTHER = "\u0001"


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+\z")


def is_number_text(c: Column) -> Column:
    return c.rlike(r"^\p{N}+\z")


def is_alnum(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]+\z")


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+\z")


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def drop_dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(""))


def contains_pattern(c: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search in the value's text."""
    return c.cast("string").rlike("(?i)" + pattern)


def substitute(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def count_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c.cast("string"), "[^0-9]", ""))


def text_length(c: Column) -> Column:
    return F.length(c.cast("string"))


def mask(c: Column) -> Column:
    """Characters as classes: L letter, D digit, S neither; `_` and non-ASCII letters drop out."""
    marked = F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}_]", _OTHER)
    kept = F.regexp_replace(marked, f"[^A-Za-z0-9{_OTHER}]", "")
    classes = "L" * len(_LETTERS) + "D" * len(_DIGITS) + "S"
    return F.translate(kept, _LETTERS + _DIGITS + _OTHER, classes)


def pattern(c: Column) -> Column:
    """Tokens as classes joined by '-': W letters, S mixed, S-N all digits, others left out."""
    tokens = F.split(c.cast("string"), "[-,;_ ]")
    classes = F.transform(
        tokens,
        lambda t: F.when(is_alpha(t), "W").when(is_number_text(t), "S-N").when(is_alnum(t), "S"),
    )
    return F.array_join(F.filter(classes, lambda k: k.isNotNull()), "-")


def word_pattern(c: Column) -> Column:
    """One W per blank-separated word, joined by '-'."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda _: F.lit("W")), "-")


def length_mask(c: Column) -> Column:
    """L and the value's length; a missing value is plain L."""
    return F.coalesce(F.concat(F.lit("L"), F.length(c).cast("string")), F.lit("L"))


def split_reference(c: Column) -> Column:
    """`ref-id-column` text as (ref, id, column); the column part may hold more dashes."""
    parts = F.split(c, "-", 3)
    return F.struct(
        parts.getItem(0).alias("ref"), parts.getItem(1).alias("id"), parts.getItem(2).alias("column")
    )
