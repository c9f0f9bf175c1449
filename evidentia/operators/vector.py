"""Vector search and triage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from evidentia import lexicons as L
from evidentia.functions import math as M

#: Query vectors that may be broadcast at once, and their bytes as doubles.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 64 << 20
#: Queries and vectors of one product, pairs that are looked at again at once, and what rounding may change in a cosine.
BLOCK, PAIRS, NEAR = (512, 2048), 1 << 16, 1e-9


def _blocks(queries: DataFrame, column: str) -> int:
    """How many blocks of queries keep each within both bounds."""
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    return max(1, -(-n // BROADCAST_QUERIES), -(-n * width * 8 // BROADCAST_BYTES))


class Best:
    """The k nearest vectors of each of some queries, of all vectors that were added; ties go to the lesser id.

    Products of blocks tell which vectors may be among the best; their cosines are then summed in the vectors' order, so
    that equal vectors tie and batches do not change a result.  What is held is k rows a query, and BLOCK cosines.
    """

    def __init__(self, queries: np.ndarray, k: int, digits: int | None = None) -> None:
        self.k, self.digits, self.q = k, digits, queries
        self.q_norm = np.sqrt(_dots(queries, queries))
        self.cosine = np.full((len(queries), k), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Vectors meet all queries, or those at ``asked``."""
        if self.ids is None:
            self.ids = np.full(self.cosine.shape, ids[0], ids.dtype)
        norms = np.sqrt(_dots(vectors, vectors))
        asked = np.arange(len(self.q)) if asked is None else np.asarray(asked)
        for i in range(0, len(asked), BLOCK[0]):
            for j in range(0, len(ids), BLOCK[1]):
                self._block(asked[i : i + BLOCK[0]], ids[j : j + BLOCK[1]], vectors[j : j + BLOCK[1]], norms[j : j + BLOCK[1]])

    def _block(self, asked: np.ndarray, ids: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        k, q, q_norm = self.k, self.q[asked], self.q_norm[asked]
        near = (q @ v.T) / (q_norm[:, None] * norms + L.EPS)
        near[np.isnan(near)] = -np.inf  # of elements that are not finite; such vectors are never among the best
        least = self.cosine[asked, -1]
        if np.isneginf(least).any() and near.shape[1] > k:
            least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
        row, col = np.nonzero((near >= (least - NEAR)[:, None]) & (near > -np.inf))
        if not len(row):
            return
        dots = [_dots(q[row[i : i + PAIRS]], v[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
        exact = np.concatenate(dots) / (q_norm[row] * norms[col] + L.EPS)
        if self.digits is not None:
            exact = np.round(exact, self.digits)
        touched, row = np.unique(row, return_inverse=True)
        at = asked[touched]
        row = np.concatenate([np.repeat(np.arange(len(at)), k), row])
        exact, found = np.concatenate([self.cosine[at].ravel(), exact]), np.concatenate([self.ids[at].ravel(), ids[col]])
        place = np.unique(found, return_inverse=True)[1] if found.dtype == object else found
        order = np.lexsort((place, -exact, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[rank < k]
        self.cosine[at], self.ids[at] = exact[kept].reshape(-1, k), found[kept].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of queries, ids of vectors, cosines."""
        if self.ids is None:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        row, col = np.nonzero(~np.isneginf(self.cosine))
        return row, self.ids[row, col], self.cosine[row, col]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first element to the last, as ``math.dot`` does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def rows_of(lists: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def ids_of(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist(), object)


def best_rows(best: Best, names: list, kinds: tuple, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """What was found, in batches of bounded size."""
    row, ids, cosine = best.found()
    for i in range(0, len(row), PAIRS):
        part = slice(i, i + PAIRS)
        yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in row[part]], to_arrow_type(kinds[0])), pa.array(ids[part].tolist(), to_arrow_type(kinds[1])), pa.array(cosine[part])], columns)


def _plain(column: str, width: int) -> Column:
    """Whether a vector has the common width and only finite elements; never null."""
    fine = F.forall(column, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False)))
    return F.coalesce((F.size(column) == width) & fine, F.lit(False)) & F.lit(width > 0)


def _ranked(scored: DataFrame, k: int, query_id: str, vector_id: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("cosine"), vector_id))).where(F.col("rank") <= k)


def _products(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vector_id: str, column: str, digits: int | None = None) -> DataFrame:
    """query_id, vec_id and cosine of the k best of each task's vectors, for each query of a bounded block."""
    kinds = queries.schema[query_id].dataType, vectors.schema[vector_id].dataType
    part = queries.select(query_id, column).collect()  # about BROADCAST_BYTES at most
    sent = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        if not len(names):
            return
        best = Best(q, k, digits)
        for batch in batches:
            lists = batch.column(1)
            at = np.flatnonzero(np.asarray(lists.is_valid()))
            for i in range(0, len(at), BLOCK[1]):
                some = pa.array(at[i : i + BLOCK[1]])
                best.add(ids_of(batch.column(0).take(some)), rows_of(lists.take(some)))
        yield from best_rows(best, names, kinds, [query_id, vector_id, "cosine"])

    shape = f"`{query_id}` {kinds[0].simpleString()}, `{vector_id}` {kinds[1].simpleString()}, cosine double"
    return vectors.select(vector_id, column).mapInArrow(run, shape)


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, vec_id, cosine and rank of the k nearest vectors of each query; ties go to the lesser id.

    A stated set of queries meets all vectors, in blocks of BROADCAST_QUERIES and BROADCAST_BYTES by a hash of the id.
    Matrix products in tasks, which keep k rows a query (``Best``), do this for vectors of the common width with finite
    elements; others, null ones among them, meet by array functions.  A cosine is the same on both ways.
    """
    v, q = vectors.select(vector_id, column), queries.select(query_id, column)
    n, width = q.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for d, c in ((q, query_id), (v, vector_id)))
    out = v.sparkSession.createDataFrame([], f"{kinds}, cosine double, rank int")
    if not n:
        return out
    blocks = max(1, -(-n // BROADCAST_QUERIES), -(-n * width * 8 // BROADCAST_BYTES))
    plain = _plain(column, width)
    usable = plain & F.col(vector_id).isNotNull()
    odd = not q.where(~plain).isEmpty() or not v.where(~usable).isEmpty()
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        scored = _products(part.where(plain), v.where(usable), k, query_id, vector_id, column)
        for asked, met in ((part.where(~plain), v), (part.where(plain), v.where(~usable))) if odd else ():
            a, c = asked.select(query_id, F.col(column).alias("_q")), met.select(vector_id, F.col(column).alias("_v"))
            scored = scored.unionByName(c.crossJoin(F.broadcast(a)).select(query_id, vector_id, M.cosine(F.col("_q"), F.col("_v")).alias("cosine")))
        out = out.unionByName(_ranked(scored, k, query_id, vector_id))
    return out


def knn_batched(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The rows of ``knn`` for vectors of one width; null ones are left out.

    Cosines are rounded to 12 digits before they are ranked, so that vectors that differ in length only tie.
    """
    rows = queries.select(query_id, column).where(F.col(column).isNotNull())
    blocks = _blocks(rows, column)
    out = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        ranked = _ranked(_products(part, vectors, k, query_id, vector_id, column, 12), k, query_id, vector_id)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def triage(scored: DataFrame, claim: str = "claim_id", score: str = "relevance", order: str = "ev_ord", k: int = 5, threshold: float = 0.2) -> DataFrame:
    """Of each claim's evidence, the best k that reach the threshold, or the best one if none does."""
    rank = F.row_number().over(W.partitionBy(claim).orderBy(F.desc(score), order))
    return scored.withColumn("rn", rank).where((F.col("rn") <= k) & ((F.col(score) >= threshold) | (F.col("rn") == 1)))
