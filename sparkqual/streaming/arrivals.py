"""Score every file as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def score_arrivals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    file_format: str = "parquet",
    **options: str,
) -> StreamingQuery:
    """Score each new file's rows and store the scores under `batch=<id>`.

    A batch that is run again after a failure replaces its own folder, so no score is stored
    twice. The stream stops when the waiting files are done; schedule it as often as files
    arrive.
    """
    arriving = spark.readStream.format(file_format).schema(schema).options(**options).load(source)

    def store(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id}")

    return (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_scores(spark: SparkSession, target: str) -> DataFrame:
    """All stored scores with their batch."""
    return spark.read.parquet(target).withColumn("batch", F.col("batch").cast("bigint"))
