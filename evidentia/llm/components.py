"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import forget, small_enough, stored

#: Edges that one task may hold.
ONE_TASK = 400_000


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v.  Each node's neighbours (large: the greater ones, by way of all) move to its least one."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(turned) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        moved = turned.join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same as ``components`` by union-find, in one executor task."""
    schema = edges.schema

    def run(batches):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to_arrow_type(schema[i].dataType)) for i in (0, 1)], ["u", "v"])

    return edges.coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) for each node u that has an edge and is not the least of its component, v being the least.

    Takes any (u, v) pairs.  Up to ``one_task`` edges, some tens of MB, union-find in one task is the faster way to the
    same rows.  Beyond, each round is written to the shared folder.  A hub's edges are summed before they are
    shuffled, and joined by a join that can be split, so no task holds a whole component.
    """
    if small_enough(edges, one_task):
        return stored(_in_one_task(edges.select("u", "v")), "components")
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    tally = _tally(now)
    while tally[0]:
        after = stored(_star(_star(now, True), False), "edges")
        forget(now)
        now, before, tally = after, tally, _tally(after)
        if tally == before:
            break
    return now
