"""An inverted-file index of vectors: centroids, lists of vectors by nearest centroid, probes, exact ranking.

The index is a folder: ``lists`` holds the vectors as Parquet, partitioned by list, so a search reads only the lists
that it probes; ``centroids`` and ``about`` are small.  What goes to every task, the centroids and a block of queries,
is bounded by CENTROID_BYTES and by the blocks of ``vector``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.operators import vector as V
from evidentia.tables import stored

#: Bytes of all centroids at most, and lists at most; a list is a folder.
CENTROID_BYTES, MOST_LISTS = 64 << 20, 8192
#: Vectors that training draws for each list, in expectation; training sees no others, indexing takes every row.
SAMPLE_PER_LIST = 64
ROUNDS = 6
#: Vectors that stand for queries when the number of probes is set, and the recall that it is set for.
CALIBRATION, RECALL = 256, 0.95
#: The list of vectors that have no direction: null, zero or not finite.
NO_LIST = -1


def _unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a column of lists, those as rows of length 1, and their lengths."""
    at = np.flatnonzero(np.asarray(lists.is_valid()))
    if not len(at):
        return at, np.zeros((0, 0)), np.zeros(0)
    taken = lists.take(pa.array(at))
    x = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
    size = np.sqrt((x * x).sum(1))
    good = np.isfinite(size) & (size > 0)
    return at[good], x[good] / size[good, None], size[good]


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first, by products of blocks of rows."""
    out = np.empty((len(x), n), np.int32)
    for i in range(0, len(x), 256):
        near = x[i : i + 256] @ centroids.T
        some = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(n), (len(near), 1))
        out[i : i + 256] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


def _assigned(df: DataFrame, column: str, centroids: np.ndarray) -> DataFrame:
    """With ``list``, the nearest centroid's number."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, _ = _unit(batch.column(place))
            found = np.full(batch.num_rows, NO_LIST, np.int32)
            if len(at):
                found[at] = _nearest(x, sent.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "list"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{shape}, list int")


def _means(assigned: DataFrame, column: str, dims: int) -> dict[int, np.ndarray]:
    """The mean direction of each list: sums by task, then by list; what is collected is one row a list."""
    place = assigned.columns.index(column)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            at, x, _ = _unit(batch.column(place))
            lists = batch.column(batch.schema.get_field_index("list")).to_numpy()[at]
            for number in np.unique(lists):
                total[int(number)] = total.get(int(number), 0) + x[lists == number].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["list", "total"])

    def added(table: pa.Table) -> pa.Table:
        x = np.sum([np.frombuffer(b, np.float64) for b in table.column("total").to_pylist()], axis=0)
        return pa.table({"list": table.column("list").slice(0, 1), "total": pa.array([x.tobytes()], pa.binary())})

    rows = assigned.mapInArrow(sums, "list int, total binary").groupBy("list").applyInArrow(added, "list int, total binary").collect()
    found = {r.list: np.frombuffer(r.total, np.float64) for r in rows}
    return {k: v / n for k, v in found.items() if (n := np.sqrt((v * v).sum())) > 0 and len(v) == dims}


def train(vectors: DataFrame, vector_id: str = "vec_id", column: str = "embedding", lists: int | None = None) -> np.ndarray:
    """Centroids of unit length: spherical k-means by Spark jobs over a sample that is drawn by a hash of the id.

    Without ``lists``, their number is the square root of the rows', within MOST_LISTS and CENTROID_BYTES.
    """
    usable = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(vector_id, column)
    n, dims = usable.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    if not n:
        return np.zeros((0, 0))
    lists = lists or max(1, round(n**0.5))
    lists = max(1, min(lists, MOST_LISTS, CENTROID_BYTES // (8 * dims)))
    hashed = F.pmod(F.xxhash64(vector_id), F.lit(1 << 40))
    sample = stored(usable.where(hashed < F.lit(int((1 << 40) * min(1.0, SAMPLE_PER_LIST * lists / n)))), "ivf-sample")
    first = sample.orderBy(hashed, vector_id).limit(lists).select(column).collect()  # a list's first centroid each
    at, x, _ = _unit(pa.array([r[0] for r in first]))
    centroids = np.unique(x, axis=0) if len(at) else np.zeros((0, dims))
    for _ in range(ROUNDS if len(centroids) > 1 else 0):
        means = _means(_assigned(sample, column, centroids), column, dims)
        after = np.array([means.get(i, centroids[i]) for i in range(len(centroids))])
        if np.allclose(after, centroids):
            break
        centroids = after
    return centroids


def build(vectors: DataFrame, path: str, vector_id: str = "vec_id", column: str = "embedding", lists: int | None = None, k: int = 10, recall: float = RECALL) -> int:
    """Write an index of all rows to a new folder; the number of probes that reaches ``recall`` for the best k.

    That number is measured: CALIBRATION indexed vectors are searched by brute force, and of the lists that hold their
    neighbours, the quantile of the lists' ranks is taken.  Large lists are split over tasks as they are written.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vector_id, column)
    centroids = train(rows, vector_id, column, lists)
    assigned = _assigned(rows, column, centroids)
    assigned.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    probes = _calibrated(spark, path, centroids, rows.schema, vector_id, column, k, recall)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int"
    spark.createDataFrame([(vector_id, column, probes, shape)], "vector_id string, column string, probes int, shape string").write.parquet(f"{path}/about")
    return probes


def _calibrated(spark: SparkSession, path: str, centroids: np.ndarray, schema, vector_id: str, column: str, k: int, recall: float) -> int:
    stored_lists = spark.read.schema(f"`{vector_id}` {schema[vector_id].dataType.simpleString()}, `{column}` {schema[column].dataType.simpleString()}, list int").parquet(f"{path}/lists")
    drawn = stored_lists.where(F.col("list") >= 0).orderBy(F.xxhash64(F.lit(7), vector_id), vector_id).limit(CALIBRATION).select(F.col(vector_id).alias("_query"), column)
    asked = drawn.collect()  # CALIBRATION rows
    if not asked:
        return 1
    near = V.knn_batched(drawn, stored_lists.where(F.col("list") >= 0), k + 1, "_query", vector_id, column).where(F.col("_query") != F.col(vector_id))
    pairs = stored_lists.select(vector_id, "list").join(F.broadcast(near.select("_query", vector_id)), vector_id).collect()  # CALIBRATION times k rows
    order = dict(zip([r[0] for r in asked], _nearest(_unit(pa.array([r[1] for r in asked]))[1], centroids, len(centroids)), strict=True))
    ranks = sorted(int(np.flatnonzero(order[r["_query"]] == r["list"])[0]) + 1 for r in pairs)
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] if ranks else 1


class Index:
    """A written index, to be searched and added to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.vector_id, self.column, self.probes, self.shape = about.vector_id, about.column, about.probes, about.shape
        self.centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()], np.float64)
        self.lists = spark.read.schema(self.shape).parquet(f"{path}/lists")

    def add(self, vectors: DataFrame) -> None:
        """Index more rows under the same centroids; their ids are taken as new ones."""
        _assigned(vectors.select(self.vector_id, self.column), self.column, self.centroids).write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        self.lists = self.spark.read.schema(self.shape).parquet(f"{self.path}/lists")

    def probed(self, lists: list[int]) -> DataFrame:
        """The rows of some lists: the scan is pruned to their folders."""
        return self.lists.where(F.col("list").isin([int(x) for x in lists]))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", probes: int | None = None) -> DataFrame:
        """query_id, the vector's id, cosine and rank of the best k among the ``probes`` nearest lists of each query.

        Cosines are exact, rounded to 12 digits, and ties go to the lesser id, as in ``vector.knn_batched``, which this
        equals if all lists are probed.  A query without direction finds nothing.  Queries go in bounded blocks; a
        list's vectors meet only the queries that probe it, and a task keeps the best k of each query (``vector.Best``).
        """
        rows = queries.select(query_id, F.col(self.column)).where(F.col(self.column).isNotNull())
        kinds = {query_id: queries.schema[query_id].dataType, self.vector_id: self.lists.schema[self.vector_id].dataType}
        shape = f"`{query_id}` {kinds[query_id].simpleString()}, `{self.vector_id}` {kinds[self.vector_id].simpleString()}, cosine double"
        n = min(probes or self.probes, len(self.centroids))
        blocks = V._blocks(rows, self.column)
        out = None
        for b in range(blocks):
            part = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)).collect()  # about BROADCAST_BYTES at most
            at, x, _ = _unit(pa.array([r[1] for r in part])) if part else ([], np.zeros((0, 0)), None)
            found = self._block(shape, kinds, [part[i] for i in at], x, n, k, query_id)
            out = found if out is None else out.unionByName(found)
        best = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("cosine"), self.vector_id))
        return out.withColumn("rank", best).where(F.col("rank") <= k)

    def _block(self, shape: str, kinds: dict, asked: list, x: np.ndarray, n: int, k: int, query_id: str) -> DataFrame:
        """``asked``: ids and vectors of queries, whose directions are ``x``."""
        if not asked or not n:
            return self.spark.createDataFrame([], shape)
        near = _nearest(x, self.centroids, n)
        order = np.argsort(near, axis=None, kind="stable")
        lists, starts = np.unique(near.ravel()[order], return_index=True)
        by_list = {int(number): q for number, q in zip(lists, np.split(order // n, starts[1:]), strict=True)}
        sent = self.spark.sparkContext.broadcast(([r[0] for r in asked], np.array([r[1] for r in asked], np.float64), by_list))
        vector_id, kept = self.vector_id, [query_id, self.vector_id, "cosine"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, by_list = sent.value
            best = V.Best(q, k, 12)
            for batch in batches:
                for first in range(0, batch.num_rows, V.BLOCK[1]):
                    part = batch.slice(first, V.BLOCK[1])
                    at = pa.array(_unit(part.column(1))[0])
                    if not len(at):
                        continue
                    numbers, ids, v = part.column(2).take(at).to_numpy(), V.ids_of(part.column(0).take(at)), V.rows_of(part.column(1).take(at))
                    for number in np.unique(numbers):
                        if (queries := by_list.get(int(number))) is not None:
                            own = numbers == number
                            best.add(ids[own], v[own], queries)
            yield from V.best_rows(best, names, (kinds[query_id], kinds[vector_id]), kept)

        return self.probed(list(by_list)).select(vector_id, self.column, "list").mapInArrow(run, shape)
