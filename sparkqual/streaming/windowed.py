"""Quality per time window of a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import rules as rl
from ..functions.values import percent
from ..plans.longform import quoted


def windowed_quality(
    events: DataFrame,
    ts: str,
    ruleset: Sequence[Mapping],
    width: str = "1 day",
    lateness: str = "1 hour",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(start, end, rows, completeness, validity) per window; works on streams and tables.

    Only rows later than `lateness` are dropped, by the watermark. Only sums are kept as state,
    one small record per open window. `store_windows` keeps the windows of a stream.
    """
    names = list(columns or events.columns)
    checks = rl.compile_rules(events, ruleset)
    present = sum((quoted(c).isNotNull().cast("bigint") for c in names), F.lit(0).cast("bigint"))
    checked = sum((c.applies.cast("bigint") for c in checks), F.lit(0).cast("bigint"))
    failed = sum((c.violated.cast("bigint") for c in checks), F.lit(0).cast("bigint"))
    kind = events.schema[ts].dataType
    # Watermarks need timestamps with a zone; the result keeps the column's own type.
    timed = events.withColumn("_ts", quoted(ts).cast("timestamp"))
    return (
        timed.withWatermark("_ts", lateness)
        .groupBy(F.window("_ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            percent(F.sum(present), F.count(F.lit(1)) * len(names)).alias("completeness"),
            percent(F.sum(checked) - F.sum(failed), F.sum(checked)).alias("validity"),
        )
        .select(
            F.col("w.start").cast(kind).alias("start"),
            F.col("w.end").cast(kind).alias("end"),
            "rows",
            "completeness",
            "validity",
        )
    )


def store_windows(measured: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """A writer that stores every window a batch has changed, open ones too.

    A batch's windows go to a folder of its own; a batch that is run again overwrites it.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return measured.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def stored_windows(spark: SparkSession, target: str) -> DataFrame:
    """The stored windows, each as its last batch left it."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("start").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["start", "batch"]).drop("batch").select(*[c for c in rows.columns if c != "batch"])
