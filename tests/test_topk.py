import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import math as M
from evidentia.operators import topk

PAIRS = (("w1", "w2"), ("w3", "w40"), ("w1", "w5"))
NEGATED = ("w7", "w90")


def made(seed, n_claims, n_texts, words=400):
    rng = random.Random(seed)
    pick = lambda n: list(dict.fromkeys(f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(n)))
    claims = [(i, pick(25), pick(4)) for i in range(n_claims)] + [(n_claims, [], []), (n_claims + 1, None, None), (n_claims + 2, ["unseen"], ["unseen"])]
    texts = [(i, pick(rng.randint(1, 60))) for i in range(n_texts)] + [(n_texts, []), (n_texts + 1, None)] + [(n_texts + 2 + i, claims[i][1]) for i in range(3)]
    return claims, texts


def frames(spark, claims, texts):
    return spark.createDataFrame(claims, "claim_id int, c array<string>, h array<string>"), spark.createDataFrame(texts, "key int, e array<string>")


def all_pairs(a, b, score, k):
    rows = a.crossJoin(b).select("claim_id", "key", score.alias("score")).where("score > 0").collect()
    by = {}
    for r in rows:
        by.setdefault(r.claim_id, []).append((-round(r.score, 12), r.key))
    return sorted((c, key, i + 1, round(-s, 9)) for c, x in by.items() for i, (s, key) in enumerate(sorted(x)[:k]))


def shown(df):
    return sorted((r.claim_id, r.key, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("seed,k,first", [(1, 3, 2000), (2, 10, 20), (3, 1, 1)])
def test_support_equals_all_pairs(spark, monkeypatch, seed, k, first):
    monkeypatch.setattr(topk, "FIRST_ENTRIES", first)
    a, b = frames(spark, *made(seed, 12, 300))
    want = all_pairs(a, b, M.support(F.col("c"), F.col("e"), F.col("h"), F.col("e")), k)
    assert shown(topk.best_support(a, b, k, "claim_id", "key", "c", "h", "e")) == want


@pytest.mark.parametrize("seed,k,first", [(1, 3, 2000), (2, 10, 20), (3, 500, 5)])
def test_contradiction_equals_all_pairs(spark, monkeypatch, seed, k, first):
    monkeypatch.setattr(topk, "FIRST_ENTRIES", first)
    a, b = frames(spark, *made(seed, 8, 200))
    want = all_pairs(a, b, M.contradiction(F.col("c"), F.col("e"), F.col("c"), F.col("e"), PAIRS, NEGATED), k)
    assert shown(topk.best_contradiction(a, b, k, "claim_id", "key", "c", "e", PAIRS, NEGATED)) == want


def test_pairs_scored_follow_claims_and_k(spark):
    """Common words are in nearly every text; the pairs that are scored are few all the same."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(8)]
    texts = [(i, [w for w in common if rng.random() < 0.9] + [f"r{rng.randrange(3000)}" for _ in range(20)]) for i in range(2000)]
    claims = [(i, common[:6] + texts[i * 7][1][-14:], []) for i in range(20)]
    a, b = frames(spark, claims, texts)
    exact = M.support(F.col("c"), F.col("e"), F.col("h"), F.col("e"))
    pairs = topk.candidates(a, b, 3, "claim_id", "key", "e", topk._weights(("c", 0.5), ("h", 0.5)), exact, lambda x: x, F.lit(1.0))
    assert pairs.count() < 20 * 2000 / 10  # of 40,000 pairs, nearly all of which share a common word
    assert shown(topk.best_support(a, b, 3, "claim_id", "key", "c", "h", "e")) == all_pairs(a, b, exact, 3)


def test_empty_tables(spark):
    a, b = frames(spark, *made(1, 2, 5))
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert topk.best_support(x, y, 3, "claim_id", "key", "c", "h", "e").collect() == []
        assert topk.best_contradiction(x, y, 3, "claim_id", "key", "c", "e").collect() == []
