"""Queries on rows that the driver's tables seldom hold, against their SQL or a plain computation."""

import duckdb

from evidentia.plans import contract, contract_more  # noqa: F401


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over tables of these Arrow or pandas frames equal those of its SQL."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = contract.QUERIES[name](spark, str(folder)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(contract.ORACLE_SQL[name]).fetchall(), key=repr)
    return got


def test_feed_dates_keep_fractions_of_a_second(spark, tmp_path):
    """An event in the second in which the window ends is after its end."""
    rows = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-20 00:00:00.25'), (2L, TIMESTAMP_NTZ'2024-01-20 00:00:00'), (4L, TIMESTAMP_NTZ'2024-01-10 00:00:00.5'), (7L, TIMESTAMP_NTZ'2024-01-09 23:59:59.999999') AS t(event_id, ts)")
    got = same_as_sql(spark, tmp_path, "q100_feed_items", events=rows)
    assert sorted(r.url for r in got) == ["http://f/2", "http://f/4"]


def test_nearest_of_odd_vectors(spark, tmp_path):
    """Copies that tie, null and zero vectors, and null elements, as array functions rank them."""
    import random

    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    from evidentia.functions import math as M
    from evidentia.operators import vector

    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(700)] + [(1000 + i, [0.3] * 8) for i in range(30)] + [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = v.where("vec_id % 100 = 0 OR vec_id > 2000").select(F.col("vec_id").alias("query_id"), "embedding")
    both = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("query_id", "vec_id", M.cosine(F.col("q"), F.col("embedding")).alias("cosine"))
    want = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where("rank <= 9")
    key = lambda d: sorted((r.query_id, r.rank, r.vec_id, r.cosine) for r in d.select("query_id", "vec_id", "cosine", "rank").collect())
    assert repr(key(vector.knn(q, v, 9))) == repr(key(want))


def test_nearest_hold_no_pairs(monkeypatch):
    """What a search holds does not grow with queries times vectors."""
    import tracemalloc

    import numpy as np

    from evidentia.operators import vector

    x = np.random.default_rng(1).normal(size=(20_000, 16))
    tracemalloc.start()
    best = vector.Best(x[::5], 11)
    best.add(np.arange(len(x)), x)
    row, ids, _ = best.found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == 4_000 * 11 and (ids[::11] == np.arange(0, 20_000, 5)).all()
    assert peak < 200 << 20  # all cosines at once are 640 MB


def test_pairs_are_scored_where_the_texts_are(spark, sf, tmp_path):
    """No row of tokens is shuffled for a pair; repeated and null rows are as the SQL has them."""
    from pyspark.sql import functions as F

    claims = spark.sql("SELECT * FROM VALUES (1L, 'The end of that'), (1L, 'In it: and, to.'), (2L, NULL), (3L, '...'), (4L, 'of of the THE') AS t(item_id, text)")
    texts = spark.sql("SELECT * FROM VALUES (1L, 'of the'), (2L, NULL), (3L, ''), (4L, 'to that end que was'), (4L, 'and in'), (5L, 'zzz') AS t(doc_id, text)")
    for name in ("q33_support", "q34_contradiction"):
        got = contract.QUERIES[name](spark, sf)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        same_as_sql(spark, tmp_path / name, name, benchmark=claims, documents=texts)
    same_as_sql(spark, tmp_path / "q71", "q71_baseline_scores", benchmark=claims.where("item_id > 1"), documents=texts.where(F.col("doc_id") != 4))


def test_python_batches_are_bounded(spark, sf):
    """Queries that go through Python get batches of at most 1,000 rows, whatever the session has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for had in ("10000", "0", "500"):
        spark.conf.set(name, had)
        contract.QUERIES["q10_html_to_text"](spark, sf)
        assert 0 < int(spark.conf.get(name)) <= 1000
    spark.conf.set(name, "1000")


def test_debates_read_whole_texts(spark, tmp_path):
    """What stands after the first 80 characters of a turn counts, and turns of one number go by their whole texts."""
    import hashlib

    from evidentia.plans import dialogue

    head = "The same eighty characters and more stand at the beginning of each of these. " * 2
    texts = {1: [head + "It rises."], 2: [head + "b", head + "a", "short", ""], 3: [head * 2000 + "The end é 🙂", None]}
    turns = [(c, 1, x) for c, said in texts.items() for x in said] + [(2, 0, head), (2, None, "no number")]
    got = same_as_sql(spark, tmp_path, "q107_debate", conversations=spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(3))
    evidence = {1: head + "It rises.", 2: "\n".join([head, "", head + "a", head + "b", "short", "no number"]), 3: head * 2000 + "The end é 🙂"}
    point = lambda side, c: "point " + hashlib.sha256(dialogue.PROMPTS[side].format(claim=f"Claim {c}", evidence=evidence[c]).encode()).hexdigest()[:8]
    assert {r.conv_id: (r.pro, r.con) for r in got} == {c: (point("pro", c), point("con", c)) for c in texts}
