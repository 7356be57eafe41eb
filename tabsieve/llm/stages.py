"""Intermediate tables on the shared folder of the session, and tasks that leave no memory behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabsieve.sources.sinks import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below spark.checkpoint.dir and read it back: cuts the lineage, and a lost
    executor costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(work: Callable) -> Callable:
    """A task function that gives its free pages back when it ends: Spark keeps the worker for later stages, whose
    memory an executor would need on top."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
            if trim:
                trim(0)
    return run
