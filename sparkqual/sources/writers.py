"""Sinks and stored results (IO14-IO19)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.longform import quoted


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header (IO14); an existing target is an error unless overwriting (IO15)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_results(df: DataFrame, path: str, launch_id: str) -> None:
    """Scores of one launch added to the result table (IO17)."""
    df.withColumn("launch_id", F.lit(launch_id)).write.mode("append").partitionBy("launch_id").parquet(path)


def append_violations(df: DataFrame, path: str, launch_id: str) -> None:
    """Violating rows, one folder per launch and key column (IO16)."""
    (
        df.withColumn("launch_id", F.lit(launch_id))
        .write.mode("append")
        .partitionBy("launch_id", "key_column")
        .parquet(path)
    )


def snapshot_id(spark: SparkSession, path: str) -> str:
    """A fingerprint of the files behind a path: names, sizes and times, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    marks = files.select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    row = marks.agg(F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}-{(row['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def cached_result(
    spark: SparkSession, root: str, name: str, source: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """A stored result of the unchanged source, computed and stored at first (IO18)."""
    path = f"{root.rstrip('/')}/{name}/{snapshot_id(spark, source)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def row_json(df: DataFrame) -> Column:
    """The row as one JSON record, nulls included (IO19)."""
    return F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})


def rows_to_json(df: DataFrame, index: str | None = None) -> DataFrame:
    """(index, record): every row as JSON, keyed by `index` when given (IO19)."""
    keys = [quoted(index)] if index else []
    return df.select(*keys, row_json(df.drop(index) if index else df).alias("record"))
