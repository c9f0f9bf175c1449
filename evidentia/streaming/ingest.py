"""Resumable ingest as a file stream: what a checkpoint names as read is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators import evidence as E
from evidentia.plans.providers import Embedder, tried_embeddings
from evidentia.sources import sinks
from evidentia.tables import stored


def add_chunks(chunks: DataFrame, target: str, dead: str, embedder: Embedder | None, batch: int, wait: Callable[[int], float] = lambda a: 0.5 * a) -> dict:
    """Embed the chunks that the table does not have and add them; those that fail three times go to the table ``dead``.

    Counts of added and failed chunks.  A failed one is not in the target, so a later run that meets it tries again.
    """
    failed = 0

    def finish(new: DataFrame) -> DataFrame:
        nonlocal failed
        if embedder is None:
            return stored(new, "new-chunks")
        tried = stored(tried_embeddings(new, "text", embedder, wait=wait), "tried")
        lost = tried.where(F.col("error").isNotNull()).drop("embedding").withColumn("batch", F.lit(batch).cast("bigint"))
        failed = lost.count()
        if failed:
            lost.write.mode("append").parquet(dead)
        return tried.where(F.col("error").isNull()).drop("error")

    table = sinks.upsert(chunks, target, "chunk_id", finish)
    return {"added": table.added, "failed": failed}


def retake(spark: SparkSession, target: str, dead: str, embedder: Embedder, wait: Callable[[int], float] = lambda a: 0.5 * a) -> dict:
    """Try again the chunks in ``dead`` that the target still lacks."""
    if not sinks.exists(spark, dead):
        return {"added": 0, "failed": 0}
    return add_chunks(stored(spark.read.parquet(dead).drop("error", "batch"), "retaken"), target, dead, embedder, -1, wait)


def dead_letters(spark: SparkSession, target: str, dead: str) -> DataFrame:
    """The chunks in ``dead`` that the target still lacks: the last error of each and how often it failed."""
    lost = spark.read.parquet(dead).groupBy("chunk_id").agg(F.max_by("error", "batch").alias("error"), F.count("*").alias("times"))
    return lost.join(spark.read.parquet(target).select("chunk_id"), "chunk_id", "left_anti") if sinks.exists(spark, target) else lost


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, size: int = 1000, overlap: int = 150, embedder: Embedder | None = None, fmt: str = "parquet", options: dict | None = None, dead: str | None = None, wait: Callable[[int], float] = lambda a: 0.5 * a) -> StreamingQuery:
    """Read new files, cut rows into chunks, embed them and add those whose id the table does not have.

    Rows need no order: row_index comes from the row's own hash where the source gives none, so ids repeat.  Chunks
    whose embedding fails are kept in ``dead`` (``<target>_dead`` unless named) and tried again when the next run starts;
    they cost no other chunk.  Each batch ends with a record in the checkpoint folder; a batch that has one is not
    done again, and one that was cut off before it adds only what is missing.
    """
    dead = dead or f"{target}_dead"
    if embedder is not None:
        retake(spark, target, dead, embedder, wait)
    stream = spark.readStream.schema(schema).format(fmt).options(**(options or {})).load(source)
    named = stream.withColumn("s3_key", F.col("_metadata.file_path"))
    if "row_index" not in stream.columns:
        named = named.withColumn("row_index", F.xxhash64(*stream.columns))

    def batch(rows: DataFrame, number: int) -> None:
        done = f"{checkpoint}/_batches/{number}.json"
        if not sinks.exists(spark, done):
            sinks.record(spark, done, batch=number, **add_chunks(E.chunked(E.documents(rows), size, overlap), target, dead, embedder, number, wait))

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(chunks: DataFrame, name: str = "ingest") -> DataFrame:
    """Counters of a run, to be read from the observation."""
    return chunks.observe(name, F.count(F.lit(1)).alias("chunks"), F.approx_count_distinct("s3_key").alias("files"))


def rolling_counts(events: DataFrame, time: str, key: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Counts per key and window of a stream, with late rows up to a bound."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
