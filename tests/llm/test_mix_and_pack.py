import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import packing as P
from evidentia.llm import source_mix as M


def fill(sizes, total, weights):
    """Targets by sharing the excess again and again."""
    cap = {s: 2 * n for s, n in sizes.items()}
    fixed, left = {}, total
    while True:
        free = [s for s in sizes if s not in fixed]
        weight = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > cap[s]]
        if not over:
            return fixed | {s: left * weights[s] / weight for s in free}
        for s in over:
            fixed[s] = cap[s]
        left = total - sum(fixed.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    names = ["b", "a", None, "é", "z", "B"]
    return [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choices(names, [9, 1, 2, 1, 3, 1])[0], 1) for i in range(400)]


def test_targets_and_taken(table, rows):
    got = M.mix_sources(table(rows)).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and all(0 <= x <= 1 for x in r.positions)
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0) and r.position == (r.positions[0] if r.positions else None)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    assert [r.position for r in got] == sorted((r.position for r in got), key=lambda x: (x is not None, x))
    assert got == M.mix_sources(table(rows[::-1])).collect()


@pytest.mark.parametrize("slopes", [(0.5,), (-0.9, 0.0, 0.7), (0.0,)])
def test_positions_follow_the_schedule(table, slopes):
    """The share of a source's taken words before time t is the integral of its schedule, second copies included."""
    made = [(i, "w " * 10, "en", f"s{i % 3}" if i < 600 else "s2", 1) for i in range(1500)]
    got = M.mix_sources(table(made), slopes=slopes).collect()
    assert max(len(r.positions) for r in got) == 2 and min(len(r.positions) for r in got) < 2
    for i, source in enumerate(("s0", "s1", "s2")):
        copies = [(x, min(r.size, r.taken - j * r.size)) for r in got if r.source == source for j, x in enumerate(r.positions)]
        total, a = sum(n for _, n in copies), slopes[i % len(slopes)]
        for t in (0.1, 0.25, 0.5, 0.9):
            assert sum(n for x, n in copies if x < t) / total == pytest.approx(t + a * (t * t - t), abs=0.02)


def test_schedules_change_the_positions(table, rows):
    a, b = ({r.doc_id: r.positions for r in M.mix_sources(table(rows), slopes=s).collect()} for s in ((-0.5, 0.0, 0.5), (0.9, -0.9, 0.2)))
    assert sum(a[i] != b[i] for i in a if a[i]) > 0.9 * sum(1 for i in a if a[i])


def test_mixed_documents_stand_in_the_order_of_their_positions(table, rows):
    df = table(rows)
    want = sorted((x, r.doc_id) for r in M.mix_sources(df).collect() for x in r.positions[: int(r.taken / max(r.size, 1) + 0.5)])
    got = [r.doc_id for r in M.mixed_documents(df.select("*", F.lit(3).alias("_times"), F.lit(4).alias("position"))).collect()]
    place = dict()
    for x, i in want:
        place.setdefault(i, []).append(x)
    seen = [place[i].pop(0) for i in got]
    assert len(seen) == len(want) and max(a - b for a, b in zip(seen, seen[1:])) < 0.2 and sum(a > b for a, b in zip(seen, seen[1:])) == 0


def test_applied_mix(table, rows):
    df = table(rows)
    mixed = M.mix_sources(df)
    times = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixed.collect()}
    got = defaultdict(int)
    for r in M.apply_mix(df, mixed).collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: n for k, n in times.items() if n}


def test_mixed_documents_of_null_and_repeated_ids(table, odd_rows):
    """Each row is taken by its own words, whatever its doc_id is."""
    more = [(None, "n " * 40, "en", "d", 1), (None, "m " * 40, "en", "d", 1), (50, "x " * 30, "en", "d", 1), (50, "y " * 90, "en", "d", 1)]
    rows = [r for r in odd_rows if r[0] not in (5, 6)] + more
    got = corpus_pipeline.mix_stage(None, table(rows), "").collect()
    times, copies = Counter(tuple(r) for r in got), Counter(rows)
    words = lambda r: len((r[1] or "").split())
    assert set(times) <= set(rows) and all(n <= 2 * copies[r] for r, n in times.items())
    assert any(r[0] is None for r in times)
    for source in {r[3] for r in rows}:
        mixed = [m for m in M.mix_sources(table(rows)).collect() if m.source == source]
        assert abs(sum(n * words(r) for r, n in times.items() if r[3] == source) - mixed[0].target) <= max(m.size for m in mixed) / 2 + 1
    assert times == Counter(tuple(r) for r in corpus_pipeline.mix_stage(None, table(rows[::-1]), "").collect())


def test_pack_is_brute_force_best_fit():
    rng = random.Random(6)
    items = [(rng.randint(0, 100), (i,), rng.choice("aab"), rng.randrange(60)) for i in range(300)]
    got = P.pack(items, 100, 2)
    bins = []
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1])):
        size, _, source, cluster = items[i]
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= max(size, 1) and b["sources"].count(source) < 2 and cluster not in b["clusters"]]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": 100, "sources": [], "clusters": []})
        assert got[i] == (n, len(bins[n]["sources"]), 100 - bins[n]["room"])
        bins[n]["room"] -= size
        bins[n]["sources"].append(source)
        bins[n]["clusters"].append(cluster)


def test_no_word_is_lost(table, rows):
    long = [*rows, (1000, "w " * 5001, "en", "a", 1), (1001, None, None, None, None)]
    got = P.best_fit_pack(table(long), capacity=64, per_source=3, group_pieces=100).collect()
    size, bins = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.doc_id] += r.size
        bins[r.bin_id].append(r)
    assert dict(size) == {r[0]: len((r[1] or "").split()) for r in long}
    for own in bins.values():
        assert sum(r.size for r in own) <= 64
        assert sorted(r.bin_slot for r in own) == list(range(len(own)))
        at = 0
        for r in sorted(own, key=lambda r: r.bin_slot):
            assert r.bin_offset == at
            at += r.size
        whole = [r for r in own if r.piece == 0 and r.size]
        assert len({r.cluster for r in whole}) == len(whole)
        assert all(sum(r.source == s and r.size > 0 for r in own) <= 3 for s in {r.source for r in own})


def test_empty_texts_fit_any_bin_with_room(table):
    made = ["a b c", *[""] * 9, None, "d e"]
    got = P.best_fit_pack(table([(i, t, "en", "s", 1) for i, t in enumerate(made)]), capacity=8).collect()
    assert len({r.bin_id for r in got}) == 1 and len(got) == len(made)


def test_groups_hold_documents_whatever_their_length(table, monkeypatch):
    """Pieces that fill a bin never stand in a group's state; bins of long texts differ from all others."""
    seen = []
    plain = P.pack
    monkeypatch.setattr(P, "pack", lambda items, *a: seen.append(len(items)) or plain(items, *a))
    monkeypatch.setattr(P, "OUT_ROWS", 50)
    texts = ["w " * (10 * 400 + 3), "w " * (10 * 200), "w " * 10, "w " * 9, "w " * 21, "w"]
    got = P.best_fit_pack(table(texts), capacity=10).collect()
    size, bins = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.doc_id] += r.size
        bins[r.bin_id] += r.size
    assert dict(size) == {i: len(t.split()) for i, t in enumerate(texts)} and max(bins.values()) == 10
    assert len(got) == 401 + 200 + 1 + 1 + 3 + 1 and len({(r.doc_id, r.piece) for r in got}) == len(got)
    assert len(bins) == -(-sum(size.values()) // 10) or len(bins) == -(-sum(size.values()) // 10) + 1


def test_reruns_agree(table, rows):
    pick = lambda df: sorted((r.doc_id, r.piece, r.bin_id, r.bin_slot) for r in P.best_fit_pack(df).collect())
    assert pick(table(rows)) == pick(table(rows[::-1]).repartition(3))


def test_equal_rows_are_dealt_over_groups(spark):
    """Fifty thousand rows that are the same, a null doc_id among all: groups stay near their size, and reruns agree."""
    docs = spark.range(50_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("some words that are all the same").alias("text"), F.lit("s").alias("source")).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source")))
    got = P.best_fit_pack(docs).select("doc_id", "bin_id", "size")
    groups = got.groupBy(F.split_part("bin_id", F.lit("-"), F.lit(1)).alias("g")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in groups) == 53_000 and max(r.n for r in groups) <= 2 * P.GROUP_PIECES and len(groups) >= 15
    count = lambda: sorted((r.b, r.n) for r in P.best_fit_pack(docs).groupBy(F.col("bin_id").alias("b")).agg(F.count("*").alias("n")).collect())
    assert count() == count()
