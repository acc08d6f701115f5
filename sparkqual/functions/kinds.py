"""Which columns are numeric, text or time."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _TIMES)]


def nominal_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns: the ones whose values are names."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared and grouped as text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def type_label(field: T.StructField) -> str:
    """Numeric, Alphanumeric, DateTime, Boolean or Other; a column named year is Numeric."""
    kind = field.dataType
    if isinstance(kind, T.NumericType) or field.name.lower() == "year":
        return "Numeric"
    if isinstance(kind, _TIMES):
        return "DateTime"
    if isinstance(kind, T.StringType):
        return "Alphanumeric"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    return "Other"
