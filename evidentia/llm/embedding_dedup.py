"""Near-duplicate vectors by an exact metric range join: pivots, boundary replicas, cells that join on their own."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, forget, stored
from evidentia.llm.components import components

#: Least cosine of a link.
LEAST_COSINE = 0.98
#: Vectors that a cell is meant to hold: a group of rows that may link gets a pivot for each so many of its vectors.
CELL = 2048
#: Pivots in all, and their bytes at most; they go to every task.  Groups without pivots are one cell.
PIVOTS, PIVOT_BYTES = 4096, 1 << 24
#: Vectors drawn, in expectation, for each pivot wanted; the pivots are those of them that lie farthest apart.
DRAWN = 4
#: Vectors in a block; a cell of more is joined by pairs of blocks, one task's work at a time.
BLOCK = 2048
#: Cosines of products of matrices this close to the limit are computed again, by sums that do not depend on the block.
DOUBT = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so no square over- or underflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _read(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Correctly rounded sums, for cosines at the limit."""
    a, b = a.astype(np.float64) / np.abs(a).max(), b.astype(np.float64) / np.abs(b).max()
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def nodes(vectors: DataFrame, vector: str, label: str | None) -> DataFrame:
    """(vec_id, group, node, bits) of each row: what it may link with, a digest of group and vector, and the vector's bytes.

    All three are null where the vector is null, empty, zero or not finite, or the label null.
    """
    bounded_batches(vectors.sparkSession)
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind, width = ("<f4", 4) if single else ("<f8", 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, node, bits = [], [], []
            labels, lists = batch.column(1).to_pylist(), batch.column(2)
            for i in range(batch.num_rows):
                found = None
                if labels[i] is not None and lists[i].is_valid:
                    x = lists[i].values
                    if len(x) and not x.null_count:
                        values = x.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # makes -0.0 the same as 0.0
                        if np.isfinite(values).all() and values.any():
                            found = values.tobytes()
                name = None if found is None else f"{len(found) // width}:{labels[i]}"
                group.append(name)
                bits.append(found)
                node.append(None if found is None else hashlib.blake2b(found, digest_size=16, key=hashlib.blake2b(name.encode(), digest_size=16).digest()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.string()), pa.array(node, pa.binary()), pa.array(bits, pa.binary())], ["vec_id", "group", "node", "bits"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), (F.col(label) if label else F.lit("")).cast("string").alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id bigint, `group` string, node binary, bits binary")


def choose_pivots(distinct: DataFrame, kind: str, cell: int = CELL) -> dict[str, np.ndarray]:
    """Unit vectors by group: for groups of more than ``cell`` vectors, those that lie farthest apart in a drawn sample.

    The largest groups come first; PIVOTS and PIVOT_BYTES bound what is chosen, and so what is drawn and what each task
    gets.  Which vectors are chosen changes the work, never the result.
    """
    sizes = distinct.groupBy("group").agg(F.count("*").alias("n"), F.max(F.length("bits")).alias("bytes"))
    large = sizes.where(F.col("n") > cell).orderBy(F.desc("n"), "group").limit(PIVOTS // 2).collect()
    wanted, left, room = {}, PIVOTS, PIVOT_BYTES
    for r in large:
        k = min(-(-r.n // cell), left, room // (8 * r.bytes // int(kind[2]) or 1))
        if k > 1:
            wanted[r.group] = (k, r.n)
            left, room = left - k, room - k * 8 * r.bytes // int(kind[2])
    if not wanted:
        return {}
    spark = distinct.sparkSession
    shares = F.broadcast(spark.createDataFrame([(g, min(1.0, DRAWN * k / n)) for g, (k, n) in wanted.items()], "`group` string, share double"))
    drawn = defaultdict(list)
    draw = (F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))) < F.col("share")
    for r in distinct.join(shares, "group").where(draw).select("group", "node", "bits").collect():
        drawn[r.group].append((bytes(r.node), bytes(r.bits)))
    chosen = {}
    for group, rows in drawn.items():
        x = _unit(_read([b for _, b in sorted(rows)], kind))
        picked, near = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(picked) < wanted[group][0] and near.max() > 1e-12:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        if len(picked) > 1:
            chosen[group] = x[picked]
    return chosen


def cells_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, that of its nearest pivot, and which lower cells it must visit as a replica.

    A partner within ``reach`` whose nearest pivot is q is, by the triangle inequality, at most ``2 reach`` farther from
    q than the vector is from its own pivot; the plane between two pivots gives a closer bound, also used.  Of two
    cells, the higher one's vector visits the lower cell, so each pair meets once.
    """
    far = 1e-9  # for rounding; a replica too many costs time only
    d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))[home]
    plane = (d**2 - own[:, None] ** 2) <= 2.0 * (reach + far) * apart
    triangle = d <= own[:, None] + 2.0 * (reach + far)
    return home, triangle & plane & (np.arange(len(pivots)) < home[:, None])


def _placed(distinct: DataFrame, pivots: dict[str, np.ndarray], kind: str, reach: float) -> DataFrame:
    """Rows (group, cell, home, node, bits, copies), once for a vector's own cell and once for each that it visits."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.array(batch.column("group").to_pylist(), object)
            bits = batch.column("bits").to_pylist()
            rows, cell, home = [np.arange(len(groups))], [np.zeros(len(groups), np.int64)], [np.ones(len(groups), bool)]
            for group in set(groups) & set(shared.value):
                at = np.flatnonzero(groups == group)
                own, visits = cells_of(_unit(_read([bits[i] for i in at], kind)), shared.value[group], reach)
                cell[0][at] = own
                i, q = np.nonzero(visits)
                rows.append(at[i])
                cell.append(q)
                home.append(np.zeros(len(i), bool))
            take = pa.array(np.concatenate(rows))
            out = batch.select(["group", "node", "bits", "copies"]).take(take)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(home))], ["group", "node", "bits", "copies", "cell", "home"])

    return distinct.mapInArrow(run, "`group` string, node binary, bits binary, copies bigint, cell int, home boolean")


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, first node of its component) of a symmetric matrix: each row is looked at once, no pair is listed."""
    some, seen = linked.any(axis=1), np.zeros(len(linked), bool)
    child, root = [], []
    for first in np.flatnonzero(some):
        if seen[first]:
            continue
        seen[first] = True
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
            child.append(front)
            root.append(np.full(len(front), first))
    if not child:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(child), np.concatenate(root)


def join_blocks(a: np.ndarray, b: np.ndarray, home_a: np.ndarray, home_b: np.ndarray, same: bool, least: float, raw_a: np.ndarray, raw_b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` link.  Two visitors meet elsewhere; ``same``: b is a, so a row does not meet itself."""
    near = a @ b.T
    linked = near >= least
    for i, j in np.argwhere(np.abs(near - least) <= DOUBT):
        linked[i, j] = _cosine(raw_a[i], raw_b[j]) >= least
    linked &= home_a[:, None] | home_b[None, :]
    if same:
        linked |= linked.T  # the same sums both ways
        np.fill_diagonal(linked, False)
    return linked


def _links(placed: DataFrame, kind: str, least: float, block: int) -> DataFrame:
    """(node, other, n): partial sums of the copies linked with a node, and for each node of a component in a block, its first."""
    spark = placed.sparkSession
    per = placed.groupBy("group", "cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("own")).where((F.col("n") > 1) & (F.col("own") > 0))
    blocks = per.select("group", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = placed.join(blocks, ["group", "cell"]).withColumn("mine", mine)
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("*", pair.alias("other")).select("group", "cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "home", "node", "bits", "copies")
    schema = "node binary, other binary, n bigint"

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        home, copies = table.column("home").to_numpy(), table.column("copies").to_numpy()
        raw, names = _read(table.column("bits").to_pylist(), kind), np.array(table.column("node").to_pylist(), object)
        x, mine = _unit(raw), table.column("mine").to_numpy()
        if low == high:
            linked = join_blocks(x, x, home, home, True, least, raw, raw)
        else:
            a, b = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
            linked = np.zeros((len(x), len(x)), bool)
            linked[np.ix_(a, b)] = join_blocks(x[a], x[b], home[a], home[b], False, least, raw[a], raw[b])
            linked |= linked.T
        n = linked @ copies
        some = np.flatnonzero(n)
        child, root = _forest(linked)
        first = np.arange(len(x))
        first[child] = root
        return pa.table({"node": pa.array(names[some].tolist(), pa.binary()), "other": pa.array(names[first[some]].tolist(), pa.binary()), "n": pa.array(n[some], pa.int64())})

    bounded_batches(spark)
    return dealt.groupBy("group", "cell", "low", "high").applyInArrow(join, schema)


def near_vectors(vectors: DataFrame, vector: str = "embedding", label: str | None = "label", least: float = LEAST_COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: rows link if labels are equal and the cosine is ``least`` or more.

    On unit vectors that is a Euclidean distance of ``sqrt(2 - 2 least)`` or less.  Pivots cut each group of equal label
    and length into cells; a vector visits the lower cells that its partners may be in, and cells join on their own.
    A cell of more than ``block`` vectors joins by pairs of blocks, so no task holds more than two blocks; it sends
    counts and the edges of a forest, never pairs.  Equal vectors are one node with copies, so copies cost nothing.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label (unless
    ``label`` is None), link with nothing; vectors of different lengths do not link.  Each row is a vector, repeated ones
    too.  component_id is the smallest vec_id that is reachable, null ones last; kept holds where vec_id equals it.
    Other columns are not read.
    """
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * least))
    rows = nodes(vectors, vector, label)
    distinct = stored(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("group").alias("group"), F.first("bits").alias("bits"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id")), "vectors")
    placed = _placed(distinct, choose_pivots(distinct, kind, cell), kind, reach)
    links = stored(_links(placed, kind, least, block), "vector-links")
    found = components(links.where(F.col("node") != F.col("other")).select(F.col("node").alias("u"), F.col("other").alias("v")).distinct())
    counted = links.groupBy("node").agg(F.sum("n").alias("linked"))
    classes = found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    by_root = classes.join(distinct.select("node", "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("component"))
    named = classes.join(stored(by_root, "vector-roots"), "root")  # a stored side, so that the rows of a hot root can be split
    known = distinct.select("node", "copies", "least_id").join(counted, "node", "left").join(named, "node", "left")
    component = F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component"))
    settled = stored(known.select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), component.alias("component")), "vector-classes")
    forget(links)
    out = rows.select("vec_id", "node").join(settled, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
