import hashlib
import random
from collections import Counter

import corpus_pipeline as C
from evidentia.llm import language_id, near_dedup, packing, queries, source_mix, suffix_dedup
from evidentia.llm.common import stored


def test_stages(spark, sf):
    """Each stage's rows are those of its operator on what the stage before kept, and clean documents stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in C.STAGES] == ["language ID", "MinHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"]
    seen = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        seen.append(stored(stage(spark, seen[-1], sf), f"t{i}"))
        assert i == 4 or seen[-1].columns == names
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in seen]
    found = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if found[i] != "und")
    kept = {r.doc_id for r in near_dedup.near_duplicates(seen[1]).collect() if r.kept}
    assert sorted(ids[2]) == sorted(kept)
    spans = {r.doc_id: r for r in suffix_dedup.suffix_dedup(seen[2]).collect()}
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    left = {r.doc_id: r.text for r in seen[3].collect()}
    for i, r in spans.items():
        raw, at, out = texts[i].encode(), 0, b""
        for s in r.spans:
            out, at = out + raw[at : s.start], s.end
        want = (out + raw[at:]).decode("utf-8", "ignore")
        assert left.get(i, "").strip() == want.strip() or left[i] == want
    taken = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in source_mix.mix_sources(seen[3]).collect()}
    assert sorted(ids[4]) == sorted(i for i, n in taken.items() for _ in range(n))
    size = {r.doc_id: len(r.text.split()) for r in seen[4].collect()}
    packed = seen[5].collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(ids[4])
    assert sum(r.size for r in packed) == sum(size[i] for i in ids[4])
    assert all(r.bin_offset + r.size <= packing.CAPACITY for r in packed)


def test_run_is_a_plain_computation(spark, tmp_path):
    """run() over a table of known makings, against loops over Python lists."""
    rng = random.Random(11)
    alphabets = {"aa": "abcdefgh", "zz": "qrstuvwxyz"}
    word = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(rng.randint(2, 7)))
    passage = " ".join(word("aa") for _ in range(60))
    docs = {}
    for i in range(0, 400, 4):
        k = rng.choice(list(alphabets))
        docs[i] = (" ".join(word(k) for _ in range(rng.randint(30, 160))), k, rng.choice(["s1", "s1", "s1", "s2", None]))
    for i in range(1, 121, 4):  # exact copies, and near copies of two edits
        base = docs[4 * ((i // 4) % 40)]
        words = base[0].split()
        if i % 8 == 1:
            words[3] = words[-4] = word(base[1])
        docs[i] = (" ".join(words), base[1], "s2")
    for i in range(202, 242, 4):  # a passage that documents share
        docs[i] = (f"{' '.join(word('aa') for _ in range(100))} {passage} {' '.join(word('aa') for _ in range(100))}", "aa", "s3")
    docs[500], docs[501], docs[502] = ("12 34 %", None, "s1"), ("", None, "s1"), ("日本 中国 " * 40, None, "s1")
    rows = [(i, t, k, s, len(t)) for i, (t, k, s) in docs.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = C.run(spark, str(tmp_path)).collect()

    texts = {i: t for i, (t, _, _) in sorted(docs.items()) if i < 500}  # no letters, unlearned letters: gone
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    texts = {i: t for i, t in texts.items() if find(i) == i}
    seen, left = set(), {}
    for i, t in texts.items():
        raw = t.encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        out = bytes(b for b, c in zip(raw, covered, strict=True) if not c).decode()
        if out.strip():
            left[i] = out
    size = {i: len(t.split()) for i, t in left.items()}
    sources = sorted({docs[i][2] for i in left} - {None}) + [None]
    total = {s: sum(n for i, n in size.items() if docs[i][2] == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    target, rest, free = {}, 1.5 * sum(total.values()), list(sources)
    while over := [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        for s in over:
            target[s] = 2 * total[s]
        rest -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    times = {}
    for s in sources:
        own = sorted((i for i in left if docs[i][2] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        goal = int(target[s])
        passes, before = goal // total[s], 0
        for i in own:
            taken = passes * size[i] + max(0, min(size[i], goal - passes * total[s] - before))
            times[i] = int(taken / size[i] + 0.5)
            before += size[i]
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter({i: n for i, n in times.items() if n})
    assert Counter((r.doc_id, r.size) for r in got) == Counter({(i, size[i]): n for i, n in times.items() if n})
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        assert sum(r.size for r in own) <= packing.CAPACITY
        assert len({r.doc_id for r in own}) == len(own) and all(n <= packing.PER_SOURCE for n in Counter(r.source for r in own).values())
    assert len(left) > 90 and len(texts) < len(docs) - 20 and any(left[i] != texts[i] for i in left) and max(times.values()) == 2


def test_language_stage_rejects_by_score(spark, table):
    """Long texts in none of the learned languages go; those of learned languages stay."""
    rng = random.Random(3)
    learned = {"aa": ["abba", "banana", "cab", "dada"], "xx": ["xyz", "zyx", "yoyo", "wuxy"]}
    text = lambda words: " ".join(rng.choice(words) for _ in range(60))
    own = [(i, text(learned[k]), k, "a", 1) for i, k in enumerate(["aa", "xx"] * 30)]
    foreign = [(100 + i, text(["mnop", "ponm", "qrst", "lkji"]), None, "a", 1) for i in range(10)]
    got = C.identify(spark, table([*own, *foreign, (200, "123 %", None, "a", 1)]), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(60))


def test_language_stage_without_a_model(spark, table):
    """Where no text has a language, or only texts too long to learn from, documents with a letter stay."""
    texts = ["some words", None, "", "12 %", "日本", "x" * 20_001]
    for lang in (None, "en"):
        rows = [(i, t, lang if t and len(t) > 20_000 else None, "a", 1) for i, t in enumerate(texts)]
        assert sorted(r.doc_id for r in C.identify(spark, table(rows), "").collect()) == [0, 4, 5]


def test_queries_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in queries.QUERIES and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
