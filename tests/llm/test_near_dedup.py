import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import near_dedup as N
from evidentia.llm.components import components


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def _brute(texts, weights, similarity=0.8):
    """Classes by comparing all pairs of shingle sets, with weights and without."""
    shingler = N.Shingler()
    sets = []
    for t in texts:
        row = shingler.words(t)
        if not row:
            sets.append(None)
            continue
        h, tf, _ = shingler([row])
        sets.append(dict(zip(h.tolist(), np.exp(weights(h, tf).astype(float)), strict=True)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                low = sum(min(w, sets[j].get(k, 0)) for k, w in sets[i].items())
                same = len(sets[i].keys() & sets[j].keys())
                if low >= similarity * (sum(sets[i].values()) + sum(sets[j].values()) - low) or same >= similarity * (len(sets[i]) + len(sets[j]) - same):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(12):
        base = _words(rng, rng.randint(40, 300))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(10**6))
            out.append(" ".join(copy))
    out += [out[0], out[0].upper(), "a b", "a b c", "", "  ", "..."]
    rng.shuffle(out)
    return out


def test_classes_are_brute_force(table, texts):
    df = table(texts)
    weights = N.document_frequencies(df)
    got = {r.doc_id: r for r in N.near_duplicates(df).collect()}
    want = _brute(texts, weights)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_weights_are_the_exact_idf(spark, sf):
    """Of every shingle that at least RARE of the documents hold; all others weigh as RARE, whatever they share a slot with."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" one more end"))))
    for rare in (1e-3, 0.02):
        shingler = N.Shingler()
        rows = [r for r in map(shingler.words, (r.text for r in docs.collect())) if r]
        held = Counter(h for r in rows for h in shingler([r])[0].tolist())
        old, N.RARE = N.RARE, rare
        try:
            weights = N.document_frequencies(docs)
            names = np.array(sorted(held), np.uint64)
            got = weights(names, np.ones(len(names)))
            want = [math.log1p(N.SPREAD * math.log(max(held[h] / len(rows), rare)) / math.log(rare)) for h in names.tolist()]
        finally:
            N.RARE = old
        assert got == pytest.approx(want, abs=1e-6) and len(set(want)) > 3
        assert len(weights.shingles) == sum(n >= rare * len(rows) for n in held.values())


def test_recall_by_similarity(spark, sf):
    """Of all pairs of whole texts that are alike, by plain similarity, the share that ends up in one class."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = []
    for i, base in enumerate(sorted(texts)[:60]):
        words = texts[base].split()
        for j in range(4):
            copy = list(words)
            for _ in range(max(1, len(copy) * (j + 1) // 100)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            extra.append((100_000 + 10 * i + j, " ".join(copy), "en", "a", 1))
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    label = {r.doc_id: r.class_id for r in N.near_duplicates(both).collect()}
    texts |= {r[0]: r[1] for r in extra}
    shingler, owners, sizes, shared = N.Shingler(), {}, {}, Counter()
    for i, t in texts.items():
        row = shingler.words(t)
        own = shingler([row])[0].tolist() if row else []
        sizes[i] = len(own)
        for h in own:
            owners.setdefault(h, []).append(i)
    for ids in owners.values():
        if len(ids) < 200:
            shared.update((a, b) for n, a in enumerate(ids) for b in ids[:n])
    found = {0.8: [0, 0], 0.9: [0, 0]}
    for (a, b), n in shared.items():
        alike = n / (sizes[a] + sizes[b] - n)
        if alike >= 0.8:
            bin_ = 0.9 if alike >= 0.9 else 0.8
            found[bin_][0] += label[a] == label[b]
            found[bin_][1] += 1
    assert all(total > 30 and hit / total >= 0.99 for hit, total in found.values()), found


def test_a_hot_bucket_gives_no_quadratic_rows(table, monkeypatch):
    """Texts that share a long passage and nothing else: rows to tiles grow with their number."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(6)
    passage = _words(rng, 60)
    counts = {}
    for n in (200, 800):
        texts = [" ".join(passage + _words(rng, 60)) for _ in range(n)]
        df = table(texts)
        weights = N.document_frequencies(df)
        shingler = N.Shingler()
        rows = [(bytes([i % 256, i // 256]), bytes([i % 256, i // 256]), shingler.words(t)) for i, t in enumerate(texts)]
        nodes = df.sparkSession.createDataFrame(rows, "key binary, c binary, words binary")
        made = N.prefixes(nodes, weights, 0.8)
        counts[n] = N.dealt_prefixes(made).count(), made.count()
        assert N.may_be_similar(made, 0.8).count() == 0
    assert counts[800][0] <= 5 * max(counts[200][0], 200) and counts[800][1] <= 5 * counts[200][1]


def test_prefix_pairs_are_complete(table):
    """Every pair of at least 0.8, with weights or without, comes out, also over many tiles."""
    rng = random.Random(5)
    base = _words(rng, 120)
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(i % 12):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    weights = N.document_frequencies(table(texts))
    shingler = N.Shingler()
    nodes = [(bytes([i]), bytes([i]), shingler.words(t)) for i, t in enumerate(texts)]
    sets = [dict(zip(h.tolist(), np.exp(weights(h, tf).astype(float)), strict=True)) for h, tf, _ in (shingler([w]) for _, _, w in nodes)]
    want = set()
    for i in range(60):
        for j in range(i):
            low = sum(min(w, sets[j].get(k, 0)) for k, w in sets[i].items())
            same = len(sets[i].keys() & sets[j].keys())
            if low >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - low) or same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                want.add((j, i))
    for block in (7, 2048):
        old, N.BLOCK = N.BLOCK, block
        try:
            made = N.prefixes(table([]).sparkSession.createDataFrame(nodes, "key binary, c binary, words binary"), weights, 0.8)
            got = {tuple(sorted((r.key[0], r.h[0]))) for r in N.may_be_similar(made, 0.8).collect()}
        finally:
            N.BLOCK = old
        assert want <= got and len(want) > 50


def test_shingles_do_not_depend_on_neighbours(texts):
    shingler = N.Shingler()
    rows = [r for r in map(shingler.words, texts) if r]
    h, tf, start = shingler(rows)
    for i, row in enumerate(rows):
        end = start[i + 1] if i + 1 < len(rows) else len(h)
        own, own_tf, _ = shingler([row])
        assert own.tolist() == h[start[i] : end].tolist() and own_tf.tolist() == tf[start[i] : end].tolist()


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(9)
    shingler, sampler = N.Shingler(), N.Sampler()
    base = _words(rng, 800)
    other = base[:700] + _words(rng, 100)
    rows = [shingler.words(" ".join(x)) for x in (base, other)]
    h, tf, start = shingler(rows)
    a, b = set(h[: start[1]].tolist()), set(h[start[1] :].tolist())
    true = len(a & b) / len(a | b)
    bands = sampler(h, np.log1p(np.log(tf)).astype(np.float32), start)
    assert abs((bands[0] == bands[1]).mean() - true**N.ROWS) < 0.35


def test_repeated_rows_keep_one(table):
    text = " ".join(_words(random.Random(1), 50))
    rows = [(5, text, "en", "a", 1), (5, text, "en", "a", 1), (4, text, "en", "a", 1), (4, text, "en", "a", 1)]
    got = N.near_duplicates(table(rows)).collect()
    assert {r.class_id for r in got} == {4} and sum(r.kept for r in got) == 1
    assert [r.doc_id for r in N.drop_near_duplicates(table(rows)).collect()] == [4]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for one_task in (0, 10**6):
        got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), one_task).collect()}
        assert got == {x: find(x) for x in parent if find(x) != x}
