"""Exact quantiles of many columns: sketches narrow a wanted rank to a band, and only bands are sorted.

A sketch sees a sample of the rows, as it only steers: what lies below and in a band is counted over
all rows, and a band that doesn't hold its rank is drawn again, wider.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .longform import agg_width, quoted, union_all

# Relative accuracy of a sketch, and rows of a sample that it is taken from (expected).
ACCURACY, SAMPLE = 2000, 200_000
# Margins are widened up to this factor where a sketch missed.
MOST_CARE = 16
# Tables of fewer rows are grouped as they are.
SMALL = 10_000
# A band of more rows is narrowed again, unless all of them have one value.
BAND_ROWS = 1_000_000


class _Band:
    """Bounds that hold a wanted rank of a column; None is open."""

    def __init__(self, at: int, prob: float, rows: int):
        self.at, self.prob = at, prob
        self.low: float | None = None
        self.high: float | None = None
        self.below, self.inside, self.n = 0, rows, rows
        self.care = 1

    @property
    def position(self) -> float:
        return self.prob * (self.n - 1)

    def holds(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value >= F.lit(self.low))
        if self.high is not None:
            test = test & (value <= F.lit(self.high))
        return test

    def under(self, value: Column) -> Column:
        return F.lit(False) if self.low is None else value < F.lit(self.low)

    def ranks(self) -> tuple[float, float]:
        """Ranks, as shares of the band, that very likely enclose the wanted one."""
        wanted = (self.position - self.below) / max(1, self.inside - 1)
        seen = max(1, min(self.inside, SAMPLE))
        margin = self.care * (2 / ACCURACY + 2 / math.sqrt(seen) * (self.inside > SAMPLE) + 1 / seen)
        return wanted - margin, wanted + margin

    def is_right(self) -> bool:
        return self.below <= math.floor(self.position) and math.ceil(self.position) < self.below + self.inside


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, named by their position; NaN is null."""
    out = []
    for i, c in enumerate(columns):
        number = quoted(c).cast("double")
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            number = F.nanvl(number, F.lit(None).cast("double"))
        out.append(number.alias(str(i)))
    return df.select(*out)


def _narrow(numbers: DataFrame, bands: Sequence[_Band]) -> None:
    """Draw the bounds of bands together, from a sample; one scan then counts the rows of all."""
    some = numbers.sample(min(1.0, SAMPLE / min(b.inside for b in bands)), seed=0)
    stats: dict[str, dict[str, Column]] = {}
    for k, band in enumerate(bands):
        value = F.when(band.holds(F.col(str(band.at))), F.col(str(band.at)))
        ends = [min(1.0, max(0.0, r)) for r in band.ranks()]
        stats.setdefault(str(band.at), {})[f"_{k}"] = F.percentile_approx(value, F.array(*[F.lit(e) for e in ends]), ACCURACY)
    found = _by_band(some, stats)
    before = [(b.low, b.high) for b in bands]
    for k, band in enumerate(bands):
        low, high = band.ranks()
        marks = found[f"_{k}"]
        if marks:
            band.low = band.low if low <= 0 else marks[0]
            band.high = band.high if high >= 1 else marks[1]
    _count(numbers, bands)
    # A sketch that missed costs time, not exactness: the bounds before it hold, the next ones are wider.
    wrong = [(b, ends) for b, ends in zip(bands, before, strict=True) if not b.is_right()]
    for band, ends in wrong:
        band.low, band.high = ends
        band.care *= 2
    if wrong:
        _count(numbers, [b for b, _ in wrong])


def _by_band(numbers: DataFrame, stats: dict[str, dict[str, Column]]) -> dict[str, object]:
    """Aggregates of all bands by name; as many scans as the width of an aggregate asks for."""
    flat = [(name, agg) for by_column in stats.values() for name, agg in by_column.items()]
    out: dict[str, object] = {}
    step = agg_width(numbers)
    for start in range(0, len(flat), step):
        row = numbers.agg(*[agg.alias(name) for name, agg in flat[start : start + step]]).first()
        out |= row.asDict()
    return out


def _count(numbers: DataFrame, bands: Sequence[_Band]) -> None:
    stats = {}
    for k, band in enumerate(bands):
        value = F.col(str(band.at))
        stats[str(k)] = {
            f"b{k}": F.count_if(band.under(value)), f"i{k}": F.count_if(band.holds(value)), f"n{k}": F.count(value),
        }
    found = _by_band(numbers, stats)
    for k, band in enumerate(bands):
        band.below, band.inside, band.n = found[f"b{k}"], found[f"i{k}"], found[f"n{k}"]


def band_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, n, p0, p1, ...): linear-interpolated quantiles of numeric columns, exact.

    Nulls and NaN are left out, a column of nothing else has no row. A sample gives sketches of all
    columns, one scan counts what lies below and in their bands, and the last one groups and sorts the
    values in bands: no task sorts more than BAND_ROWS values, and nothing is stored. What the
    driver sees are bounds and counts. A value that fills much of a column is one row of a band.
    """
    spark, columns = df.sparkSession, list(columns)
    numbers = _numbers(df, columns)
    rows = df.count()
    bands = [_Band(i, p, rows) for i in range(len(columns)) for p in probs]
    wide = bands if rows > SMALL else []
    if not wide and rows:
        _count(numbers, bands)
    while wide:
        before = [(b.inside, b.care) for b in wide]
        _narrow(numbers, wide)
        wide = [
            b for b, (size, care) in zip(wide, before, strict=True)
            if b.inside > BAND_ROWS and (b.inside < size or care < b.care <= MOST_CARE) and b.low != b.high
        ]
    numbered = [(k, b) for k, b in enumerate(bands) if b.n]
    frames = []
    step = max(1, agg_width(df) // 2)
    for start in range(0, len(numbered), step):
        some = [
            F.when(b.holds(F.col(str(b.at))), F.struct(F.lit(k).alias("band"), F.col(str(b.at)).alias("value")))
            for k, b in numbered[start : start + step]
        ]
        held = numbers.select(F.inline(F.filter(F.array(*some), lambda x: x.isNotNull())))
        frames.append(held.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")))
    schema = ", ".join(["column string", "n long", *[f"p{j} double" for j in range(len(probs))]])
    if not frames:
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame(
        [
            (k, math.floor(b.position) - b.below, math.ceil(b.position) - b.below, b.position - math.floor(b.position),
             columns[b.at], b.n, k % len(probs))
            for k, b in numbered
        ],
        "band int, first long, second long, part double, column string, total long, prob int",
    )
    upto = F.sum("n").over(Window.partitionBy("band").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = union_all(frames).withColumn("upto", upto).join(F.broadcast(wanted), "band")

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("value")))

    low, high = F.col("low"), F.col("high")
    picked = placed.groupBy("column", "total", "prob", "part").agg(at("first").alias("low"), at("second").alias("high"))
    value = F.when(low == high, low).otherwise(low + (high - low) * F.col("part"))
    return picked.groupBy("column", F.col("total").alias("n")).agg(
        *[F.max(F.when(F.col("prob") == j, value)).alias(f"p{j}") for j in range(len(probs))]
    )
