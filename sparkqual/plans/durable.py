"""Cut lineage through a table written to the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Where the setting is missing a local master (tests) gets a temporary folder; on a
    cluster that would be a folder only one machine sees, so it is an error instead.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="sparkqual-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def _folder(spark: SparkSession) -> str:
    """Where this application's stored tables go."""
    return f"{checkpoint_root(spark)}/sparkqual/{spark.conf.get('spark.app.id', 'local')}"


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result has no lineage to recompute when executors are lost, its columns can be
    pruned, and its true size is known to the optimizer when it picks join strategies. The table
    stays until `remove_stored` is called.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Delete all tables this application has stored; results that read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
