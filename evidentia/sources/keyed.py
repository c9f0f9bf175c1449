"""A Parquet table in buckets by key, each with Bloom filters, so that an upsert reads only what may hold its keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.tables import forget, stored

#: Bits of a filter for each key, and bits that a key sets: about 1 in 500 unknown keys looks known.
BITS, HASHES = 16, 5
SHAPE = "bucket string, bits binary"


def bucket_of(key: Column) -> Column:
    """Two hexadecimal digits of the key's digest: 256 buckets of about the same size."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 2)


def _positions(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """HASHES positions a key, from two hashes."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((a.view(np.uint64)[:, None] + steps * (b.view(np.uint64) | np.uint64(1))[:, None]) % np.uint64(size)).astype(np.int64)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, bucket_of(F.col(key)).alias("bucket"), F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


def _filters(keys: DataFrame) -> DataFrame:
    """A filter for each bucket of the keys."""

    def made(table: pa.Table) -> pa.Table:
        size = max(64, 1 << (BITS * table.num_rows - 1).bit_length())
        bits = np.zeros(size, bool)
        bits[_positions(table.column("a").to_numpy(), table.column("b").to_numpy(), size).ravel()] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return keys.groupBy("bucket").applyInArrow(made, SHAPE)


def _known(keys: DataFrame, filters: DataFrame, key: str) -> DataFrame:
    """The keys that a filter of their bucket does not rule out."""

    def looked(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        some = np.zeros(len(a), bool)
        for raw in right.column("bits").to_pylist():
            bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
            some |= bits[_positions(a, b, len(bits))].all(axis=1)
        return left.select([key, "bucket"]).filter(pa.array(some))

    kind = keys.schema[key].dataType.simpleString()
    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(looked, f"`{key}` {kind}, bucket string")


class KeyedTable:
    """Rows under a unique key at ``path``: data in folders ``bucket=..``, filters in ``_filters``, which readers skip.

    ``files_read`` and ``buckets_read`` tell what the last upsert read of the data, ``added`` how many rows it wrote.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key
        self.files_read = self.buckets_read = self.added = 0

    def rows(self) -> DataFrame | None:
        """The table, or None before the first write."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def _present(self, keys: DataFrame) -> DataFrame | None:
        """Those of the keys that the table has.  Only buckets in which a filter lets a key through are read."""
        self.files_read = self.buckets_read = 0
        table = self.rows()
        try:
            filters = self.spark.read.schema(SHAPE).parquet(f"{self.path}/_filters")
        except AnalysisException:
            filters = None
        if table is None or filters is None:
            return None if table is None else table.select(self.key)
        maybe = stored(_known(keys, filters, self.key), "maybe-known")
        touched = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # 256 at most
        if not touched:
            return None
        part = table.where(F.col("bucket").isin(touched))
        self.buckets_read = len(touched)
        self.files_read = part.select("_metadata.file_path").distinct().count()
        return part.select(self.key).join(maybe.select(self.key), self.key, "left_semi")

    def upsert(self, df: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Append rows whose key is new; of rows of one key one, and none without a key.

        ``finish`` sees new rows only: what is dear, as model calls, is done for those alone.  It may drop rows, and
        returns a table of ``stored``, which goes when it is written.  Filters are written before the data, since a key too
        many in a filter does no harm.  Keys alone are looked at first: where none is new, whole rows are not looked at.
        """
        fresh = df.where(F.col(self.key).isNotNull())
        keys = stored(_hashed(fresh, self.key), "keys")
        if not keys.groupBy(self.key).count().where("count > 1").isEmpty():
            fresh = fresh.dropDuplicates([self.key])
        present = self._present(keys)
        if present is not None:
            new = stored(keys.select(self.key).join(present, self.key, "left_anti"), "new-keys")
            if new.isEmpty():
                self.added = 0
                forget(new)
                forget(keys)
                return
            fresh = fresh.join(new, self.key, "left_semi")
        fresh = fresh.repartition(bucket_of(F.col(self.key)))  # a bucket is written by a task or two, not by all
        fresh = finish(fresh) if finish else stored(fresh, "new-rows")
        self.added = fresh.count()
        if self.added:
            _filters(_hashed(fresh, self.key)).write.mode("append").parquet(f"{self.path}/_filters")
            fresh.withColumn("bucket", bucket_of(F.col(self.key))).write.mode("append").partitionBy("bucket").parquet(self.path)
        elif self.rows() is None:
            fresh.write.mode("append").parquet(f"{self.path}/bucket=00")
        forget(fresh)
        forget(keys)
