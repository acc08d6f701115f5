"""What a Python worker keeps between tasks: the tables of the step it runs, not of those that ran before;
and how much of a table it gets at once.

Spark reuses its Python workers for all steps of an application. What one step leaves in a worker (a
tokenizer with its cache, memory freed but not handed back) would count against the executor's
memory in every later step.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

# A batch of rows for a worker ends once it holds this much (it has one row at least).
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"

_step = ""
_kept: dict[str, Any] = {}


def small_batches(spark: SparkSession) -> None:
    """Let rows go to workers in batches of few bytes, unless the session has a limit of its own.

    By default a batch has 10,000 rows: with whole texts, tens of MB in the JVM's native memory
    and again in the worker, for each task.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def enter(step: str) -> None:
    """Say which step's task this worker runs; a change of steps drops what the last one kept."""
    global _step
    if step == _step:
        return
    _step = step
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def kept(step: str, make: Callable[[], Any]) -> Any:
    """What `make` gave this worker's first task of `step`, until a task of another step comes."""
    enter(step)
    if step not in _kept:
        _kept[step] = make()
    return _kept[step]
