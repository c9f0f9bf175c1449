import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import embedding_dedup as E


def made(seed, n=260, dims=8, labels=3):
    """Clusters around few centres, exact copies, and rows that must not link."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, dims))
    rows = []
    for i in range(n):
        x = centre[rng.integers(25)] * rng.uniform(0.1, 5) + rng.normal(size=dims) * rng.choice([0.02, 0.1, 0.5])
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.choice(labels, p=[0.7, *[0.3 / (labels - 1)] * (labels - 1)]))))
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 1), (903, [float("nan")] * dims, 1), (904, [float("inf"), *[1.0] * (dims - 1)], 1), (905, [None, *[1.0] * (dims - 1)], 1), (906, rows[0][1], None), (907, rows[0][1][:4], rows[0][2]), (None, rows[0][1], rows[0][2]), (None, None, None), (3, rows[9][1], rows[9][2]), (3, rows[3][1], rows[3][2])]
    return rows


def plain(rows, least=0.98, by_label=True):
    ok = [r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and (not by_label or r[2] is not None) for r in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if ok[i] else None for i, r in enumerate(rows)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]) and (not by_label or rows[i][2] == rows[j][2]):
                link[i, j] = link[j, i] = unit[i] @ unit[j] >= least
    root = list(range(n))
    for _ in range(n):
        after = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if after == root:
            break
        root = after
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], int(link[i].sum()), component, rows[i][0] == component))
    return out


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("cell,block", [(2048, 2048), (20, 2048), (20, 16), (8, 5)])
def test_equals_all_pairs(spark, cell, block):
    rows = made(cell + block)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(7).alias(c) for c in ("node", "group", "bits", "cell", "home", "n", "n_links")))
    got = E.near_vectors(df, cell=cell, block=block).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_without_label_and_with_doubles(spark):
    rows = made(5, n=120)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = E.near_vectors(df, label=None, least=0.9, cell=16).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, 0.9, False)))


def test_a_group_of_near_copies_is_cut_into_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(v)) for v in base + rng.normal(size=16) * 0.08], 1) for i in range(300)]
    placed = E._placed(E.nodes(spark.createDataFrame(rows, SCHEMA), "embedding", "label").select("group", "node", "bits", F.lit(1).cast("bigint").alias("copies")), {}, "<f4", 0.2)
    links = E._links(placed, "<f4", 0.98, 32)
    assert links.count() <= 300 * 10  # a row a vector and block at most, no pairs
    got = E.near_vectors(spark.createDataFrame(rows, SCHEMA), block=32).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1e300, -1e300], 1), (4, [-0.0, 1.0], 2), (5, [0.0, 2.0], 2)]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


def test_empty_and_null_tables(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = E.near_vectors(spark.createDataFrame([(None, None, None)] * 2, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, True)] * 2


def test_replicas_reach_every_partner():
    """Each pair within reach meets in the lower of its cells, where at least one is at home."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, visits = E.cells_of(x, x[:12], 0.3)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.3
    for i, j in np.argwhere(near):
        if home[i] > home[j]:
            assert visits[i, home[j]]
