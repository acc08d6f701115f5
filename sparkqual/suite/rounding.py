"""Round fractions so that engines summing in different orders agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` decimals (no negative zero), whole numbers to BIGINT."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
