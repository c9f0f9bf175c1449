"""What the operators share: bounded Arrow batches, shared-folder tables, broadcast values, worker caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.tables import forget, shared_dir, stored

__all__ = ["BATCH_ROWS", "WORD_PATTERN", "bounded_batches", "doc_text", "forget", "map_arrow", "shared_dir", "small_enough", "stored", "worker_cache"]

#: White space of the word contracts: the ASCII space and the control characters tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch.  Texts average a few KB, so a batch stays at a few MB; where they are long, Spark ends a batch
#: at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch), so no batch grows with the texts.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Any], schema: str, make: Callable[[], Any] | None = None) -> DataFrame:
    """``mapInArrow`` with ``fn(batch)`` or ``fn(batch, state)``, where ``make()`` builds the state of a task once."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make() if make else None
        for batch in batches:
            if batch.num_rows:
                got = fn(batch, state) if make else fn(batch)
                if isinstance(got, pa.RecordBatch):
                    yield got
                else:
                    yield from got

    return df.mapInArrow(run, schema)


def doc_text(documents: DataFrame) -> DataFrame:
    """(doc_id bigint, text string) only, so that other columns of any name neither travel nor clash."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, for what is dear to build and the same in each task."""
    import sys

    return sys.__dict__.setdefault("_evidentia_cache", {}).setdefault(name, {})


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether ``df``, a stored table, has at most ``most`` rows: by its files' row counts, or by a look for one row.

    A limit in the plan would send its rows from every partition to one task, so none is used.
    """
    return df.isEmpty() if most == 0 else df.count() <= most
