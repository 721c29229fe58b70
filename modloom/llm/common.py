"""What the operators of this subpackage share: tables, the shared folder, shipping code to executors."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..plans.tables import discard, materialise, shared_dir

__all__ = ["discard", "held", "lean", "materialise", "partitions", "shared_dir", "ship", "table", "text_blocks", "text_of"]

#: Bytes of text that a Python task turns into arrays at once: what it needs on the way is about 50 times as much.
TEXT_BLOCK = 1 << 20
#: Rows of a batch that goes to a Python worker, where the session does not say otherwise: rows are whole texts.
BATCH_ROWS = 512
_HELD: dict[str, dict] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors; batches of Spark's default of 10,000 rows are made smaller, for they hold whole texts."""
    shipping.ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Give memory that this worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to call
        pass


def held(operator: str) -> dict:
    """What tasks of an operator keep in a Python worker for its next tasks; what other operators kept there goes."""
    if set(_HELD) - {operator}:
        for name in set(_HELD) - {operator}:
            del _HELD[name]
        trim()
    return _HELD.setdefault(operator, {})


def lean(operator: str, batches: Iterator) -> Iterator:
    """The batches of a Python task, begun without other operators' caches and ended by giving memory back."""
    held(operator)
    yield from batches
    trim()


def text_blocks(batch: pa.RecordBatch, at: int, most: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (column `at`) have about `most` bytes together; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (a null text is empty), so that further columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
