"""Scans (IO1-IO4, IO6, IO7, IO9, IO11, IO12) and row ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import kinds
from ..functions.values import DAY_FIRST, TIMES, parse_time
from ..operators import frequency
from ..plans.durable import durable
from ..plans.longform import quoted
from ..plans.ranks import running_totals

# Column names read as dates and as times.
DATE_NAMES = ("Date", "date", "Datum", "datum")
TIME_NAMES = ("Time", "time")
DELIMITERS = (",", ";", "\t", "|")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """CSV with a header (IO1). Without a schema the types are inferred by a second pass."""
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """IO2"""
    return spark.read.parquet(path)


def _first_characters(spark: SparkSession, path: str) -> DataFrame:
    """(file, first): first character of each file that is not blank."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.ltrim("value").alias("value"),
    )
    opening = lines.filter((F.col("block") == 0) & (F.col("value") != ""))
    return opening.groupBy("file").agg(F.min_by(F.substring("value", 1, 1), "line").alias("first"))


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    lines: bool = False,
) -> DataFrame:
    """JSON records (IO3): an array per file, or one record per line with `lines=True`.

    A file whose root is an object holds no records and is refused. Arrays are parsed one
    file per task; large data belongs in lines, which split.
    """
    if not lines:
        wrong = _first_characters(spark, path).filter(F.col("first") != "[").limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['file']} has a root key; an array of records is expected")
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml(
    spark: SparkSession, path: str, row_tag: str = "row", schema: T.StructType | str | None = None
) -> DataFrame:
    """IO4"""
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).xml(path)


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A database table (IO6), read in parallel ranges of `column` when bounds are given.

    Filters and columns chosen later are pushed to the database. A failing connection is an
    error; nothing else is read in its place.
    """
    if column and bounds:
        return spark.read.jdbc(
            url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=partitions, properties=dict(properties),
        )
    return spark.read.jdbc(url, table, properties=dict(properties))


def read_path(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by the extension of the last path segment."""
    ending = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "parquet": read_parquet, "json": read_json, "xml": read_xml}
    if ending not in readers:
        raise ValueError(f"no reader for .{ending}; use csv, parquet, json or xml")
    return readers[ending](spark, path, **options)


def read_reference(
    spark: SparkSession, registry: Sequence[Mapping[str, str]], name: str
) -> DataFrame:
    """A reference table by its registered name (IO7); the text `None` means null."""
    entry = next((e for e in registry if e["name"] == name), None)
    if entry is None:
        raise KeyError(f"no reference table {name}")
    df = read_path(spark, entry["path"])
    return df.select(
        *[
            F.when(quoted(f.name) != "None", quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else quoted(f.name)
            for f in df.schema
        ]
    )


def preview(df: DataFrame, n: int = 1000) -> dict[str, DataFrame]:
    """The first n rows and the three most frequent values of each column (IO9)."""
    return {"rows": df.limit(n), "top": frequency.top_shares(df, kinds.flat_columns(df), 3)}


def delimiter_scores(spark: SparkSession, path: str) -> DataFrame:
    """(delimiter, lines, per_line): lines that hold each delimiter, and its least count in one (IO11).

    All lines are read; ties go to the delimiter's own order.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    found = F.array(
        *[
            F.struct(
                F.lit(d).alias("delimiter"),
                (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("times"),
            )
            for d in DELIMITERS
        ]
    )
    return (
        lines.select(F.inline(found))
        .filter("times > 0")
        .groupBy("delimiter")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("times").alias("per_line"))
        .orderBy(F.col("lines").desc(), F.col("per_line").desc(), "delimiter")
    )


def find_delimiter(spark: SparkSession, path: str) -> str | None:
    """The delimiter most lines share (IO11); None when no candidate occurs."""
    best = delimiter_scores(spark, path).first()
    return best["delimiter"] if best else None


def coerce_times(df: DataFrame) -> DataFrame:
    """Text columns named like dates become timestamps, day first; times likewise (IO12)."""
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.StringType) and f.name in DATE_NAMES:
            c = parse_time(c, DAY_FIRST)
        elif isinstance(f.dataType, T.StringType) and f.name in TIME_NAMES:
            c = parse_time(c, TIMES)
        out.append(c.alias(f.name))
    return df.select(*out)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, ... once, and store them with their number.

    The rows are written with the id of the task that read them; the tasks' row counts, one
    per task, give the offsets. Every later read sees the same numbers.
    """
    split = F.lit(1 << 33)
    stored = durable(df.withColumn("_seen", F.monotonically_increasing_id()))
    task = F.floor(F.col("_seen") / split).cast("bigint")
    counts = stored.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per task that read the table.
    ranked = running_totals(counts.withColumn("_all", F.lit(0)), ["_all"], "_task", ["_rows"])
    offsets = ranked.select("_task", F.col("before__rows").alias("_offset"))
    numbered = stored.withColumn("_task", task).join(offsets, "_task")
    return numbered.select(
        (F.col("_offset") + F.pmod("_seen", split)).alias(name), *[quoted(c) for c in df.columns]
    )
