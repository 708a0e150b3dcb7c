"""Helpers shared by the operators: reading tables, Arrow mapping, byte-bounded work units, the shared folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, scratch_path, shared_folder

__all__ = ["durable", "scratch_path", "shared_folder", "read_table", "arrow_map", "chunks", "remainder", "text_bytes"]

REPOSITORY = str(Path(__file__).resolve().parents[2])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _reachable(spark: SparkSession) -> None:
    """Let the Python workers of a local master import this package; clusters get it with ``--py-files`` or an install."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        have = context.environment.get("PYTHONPATH", "")
        if REPOSITORY not in have.split(":"):
            context.environment["PYTHONPATH"] = f"{REPOSITORY}:{have}" if have else REPOSITORY
    if REPOSITORY not in sys.path:
        sys.path.insert(0, REPOSITORY)


#: How to empty what an operator's module keeps in a Python worker between its tasks, by module.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(module: str, release: Callable[[], None]) -> None:
    """Register a cache that outlives the tasks of ``module``."""
    _KEPT[module] = release


def release_others(module: str) -> None:
    """Empty the caches of all other modules: a worker serves many operators, and their caches must not add up."""
    for other in [m for m in _KEPT if m != module]:
        _KEPT.pop(other)()


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function may live in this package."""
    _reachable(df.sparkSession)
    module = function.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(module)
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(alone, schema)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``limit`` bytes of ``column``; one longer value makes a slice of its own.

    The working memory of a task is then bounded by the limit or the longest text, not by rows.
    """
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of every text, None for null."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def remainder(column: str | Column, modulus: int) -> Column:
    """``crc32(text of the id) mod modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus

