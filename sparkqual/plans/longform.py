"""Columns to rows: the shape every per-column statistic is computed in."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Session setting: expressions per aggregate. The default keeps generated code within what the
# JVM compiles, and scans of a wide table few. A table of few, small files is profiled
# faster with a smaller value: its batches are scanned side by side.
_WIDTH_SETTING, _WIDTH = "sparkqual.aggWidth", "150"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> Column:
    """Column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def agg_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(_WIDTH_SETTING, _WIDTH))


def batches(df: DataFrame, items: Sequence, per_item: int) -> Iterator[list]:
    """Groups of items whose aggregates stay within the session's width."""
    step = max(1, agg_width(df) // max(1, per_item))
    for start in range(0, len(items), step):
        yield list(items[start : start + step])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def describe_columns(
    df: DataFrame, stats: Mapping[str, Mapping[str, Column]], label: str = "column"
) -> DataFrame:
    """One row per column from one aggregate over `df`.

    `stats` maps a column name to its aggregates (statistic name -> aggregate Column).
    All columns share one scan; tables too wide for one aggregate take one scan per batch,
    each reading only the columns of its batch.
    """
    names = list(stats)
    width = max(len(s) for s in stats.values())
    frames = []
    for group in batches(df, names, width):
        structs = [
            F.struct(F.lit(c).alias(label), *[agg.alias(s) for s, agg in stats[c].items()])
            for c in group
        ]
        one_row = df.agg(F.array(*structs).alias("_stats"))
        frames.append(one_row.select(F.inline("_stats")))
    return union_all(frames)


def to_long(
    df: DataFrame,
    columns: Sequence[str],
    cast: str = "string",
    name: str = "column",
    value: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(`keep`, column, value) with every value cast to one type."""
    narrow = df.select(
        *[quoted(k) for k in keep], *[quoted(c).cast(cast).alias(c) for c in columns]
    )
    return narrow.unpivot(
        [quoted(k) for k in keep], [quoted(c) for c in columns], name, value
    )


def native_counts(df: DataFrame, columns: Sequence[str]) -> list[tuple[DataFrame, T.DataType]]:
    """(column, value, n) tables, one per type family, with values in their own type.

    Grouping whole numbers, fractions and times as such is cheaper than grouping their text,
    and the families read disjoint columns. Partial aggregation collapses frequent values
    before the shuffle, so a value that fills a third of a column costs one row per task.
    """
    families: dict[str, tuple[T.DataType, list[str]]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, _WHOLE):
            kind = T.LongType()
        elif isinstance(kind, T.FloatType):
            kind = T.DoubleType()
        elif not isinstance(kind, (T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = T.StringType()
        families.setdefault(kind.simpleString(), (kind, []))[1].append(c)
    return [(_counted(df, names, kind), kind) for kind, names in families.values()]


def _counted(df: DataFrame, names: Sequence[str], kind: T.DataType) -> DataFrame:
    """Group by the column's position, a short key, and put its name back afterwards."""
    numbered = df.select(*[quoted(c).cast(kind).alias(str(i)) for i, c in enumerate(names)])
    long = numbered.unpivot([], [str(i) for i in range(len(names))], "_at", "value")
    counts = long.groupBy("_at", "value").agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.lit(c) for c in names])
    name = F.element_at(labels, F.col("_at").cast("int") + 1)
    return counts.select(name.alias("column"), "value", "n")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for every value of every column as text, nulls included."""
    return union_all(
        [
            counts if isinstance(kind, T.StringType)
            else counts.withColumn("value", F.col("value").cast("string"))
            for counts, kind in native_counts(df, columns)
        ]
    )
