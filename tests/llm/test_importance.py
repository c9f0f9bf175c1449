import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, longest=1):
    w = WORD.findall(lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, bench, buckets, longest=1, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, longest)[1]) for texts in ([d[1] for d in docs], bench))
    total = [sum(x.values()) for x in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + buckets) / ((s[b] + 1) * (total[1] + buckets))))
    rows = []
    for d in docs:
        n, f = runs(d[1], longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = len(order) * percent // 100
    return [(*r, i + 1 if i < drawn else None) for i, r in enumerate(order)] + [(*r, None) for r in rows if r[1] < least]


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_plain_loops(spark, table, odd_rows, longest):
    rng = random.Random(1)
    odd = ["ünï Ünï ÀÉ x1y2", "A" * 70 + " b" * 30, "日本語 テスト " * 12, "a\x00b\x7fc~d", "-", "end", "😀" * 30 + " mixed Case", "w " * 25]
    docs = [*odd_rows, *((100 + i, " ".join(rng.choice(["alpha", "Beta", "g4mma", "été", "日本", "z" * 50]) for _ in range(rng.randint(0, 60))), "en", "a", 1) for i in range(150)), *((300 + i, x, "en", "a", 1) for i, x in enumerate(odd))]
    bench = ["alpha alpha beta", None, "", "été 日本 x"]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(bench)], "item_id bigint, text string")
    more = table(docs).select("*", *(F.lit(7).alias(c) for c in ("weight", "score", "rank", "_part", "_at", "n_words", "bucket")))
    got = I.resample(more, target, buckets=64, longest=longest).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(docs, bench, 64, longest)))


def test_equal_rows_are_dealt_out(table, spark):
    """A third of all rows are the same; ranks stay 1, 2, ... without gaps."""
    text = "one two three " * 8
    docs = [(None, text, "en", "a", 1)] * 300 + [(i, text + str(i), "en", "a", 1) for i in range(600)]
    got = I.resample(table(docs), spark.createDataFrame([(1, "one")], "item_id bigint, text string"), percent=50)
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 451))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(docs, ["one"], 10_000, percent=50)))


def test_empty_tables(spark, table):
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert I.resample(table([]), target).collect() == []
    got = I.resample(table([(None, None, None, None, None)] * 2), target).collect()
    assert [(r.weight, r.rank) for r in got] == [(0, None)] * 2


@pytest.mark.parametrize("block", [8, 64, 1 << 22])
def test_words_and_their_crcs(monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    rng = random.Random(2)
    texts = ["".join(rng.choice("aZ9 é-日\n") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["", None, "x" * 500, "y"]
    found = Counter()
    for bucket, owner, _ in I.features(pa.array(texts).slice(0), 1 << 31, 1):
        found.update(zip(owner.tolist(), bucket.tolist(), strict=True))
    assert found == Counter((i, zlib.crc32(w.encode()) % (1 << 31)) for i, x in enumerate(texts) for w in runs(x)[1])


def test_advance_ends_long_words():
    data = np.frombuffer(b"a" * 300 + b"bc", np.uint8)
    state = I.advance(np.full(3, 0xFFFFFFFF, np.uint32), data, np.array([0, 300, 10]), np.array([300, 2, 0]))
    assert (state ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(b"a" * 300), zlib.crc32(b"bc"), 0]
