import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import ivf, vector

SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 16))
    rows = [(i, [float(v) for v in centre[rng.integers(40)] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.25]) for i in range(4000)]
    rows += [(9000 + i, rows[i][1]) for i in range(5)] + [(9100, None), (9101, [0.0] * 16), (9102, [float("nan")] * 16)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    ivf.build(clustered, path)
    return ivf.Index(spark, path)


def _queries(df):
    return df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _exact(df, k):
    usable = df.where("vec_id not in (9100, 9101, 9102)")
    return {(r.query_id, r.vec_id) for r in vector.knn_batched(_queries(usable), usable, k).collect()}


def test_every_row_is_indexed(clustered, index):
    assert index.lists.count() == clustered.count()
    assert {r.vec_id for r in index.lists.where("list = -1").collect()} == {9100, 9101, 9102}


def test_recall_reaches_nine_tenths_with_few_lists(clustered, index):
    want = _exact(clustered, 10)
    got = {(r.query_id, r.vec_id) for r in index.search(_queries(clustered), 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert index.probes <= len(index.centroids) // 4


def test_all_lists_give_the_exact_search(clustered, index):
    got = index.search(_queries(clustered), 10, probes=10_000)
    usable = clustered.where("vec_id not in (9100, 9101, 9102)")
    want = vector.knn_batched(_queries(usable), usable, 10)
    near = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.cosine) for r in df.collect())
    assert [x[:3] for x in near(got)] == [x[:3] for x in near(want)]
    assert np.allclose([x[3] for x in near(got)], [x[3] for x in near(want)], atol=1e-9)


def test_a_search_reads_only_its_lists(spark, clustered, index):
    """The scan's own figures: files and bytes of one query are a small part of the index."""
    one = _queries(clustered).where("query_id = 100")
    lists = ivf._nearest(ivf._unit(__import__("pyarrow").array([one.first().embedding]))[1], index.centroids, index.probes)[0]
    size = lambda df: df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct().agg(F.sum("s")).first()[0]
    assert size(index.probed(lists.tolist())) < 0.5 * size(index.lists)
    plan = index.search(one, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_added_rows_are_found(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    ivf.build(clustered.where("vec_id < 2000"), path, lists=16)
    index = ivf.Index(spark, path)
    index.add(clustered.where("vec_id >= 2000"))
    got = {(r.query_id, r.vec_id) for r in index.search(_queries(clustered), 10, probes=16).collect()}
    assert got == _exact(clustered, 10)


def test_empty_and_null_tables(spark, tmp_path):
    for i, rows in enumerate(([], [(1, None), (None, None)])):
        path = str(tmp_path / f"i{i}")
        ivf.build(spark.createDataFrame(rows, SCHEMA), path)
        index = ivf.Index(spark, path)
        assert index.lists.count() == len(rows)
        assert index.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>"), 3).collect() == []
