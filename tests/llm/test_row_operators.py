"""Operators that look at one row at a time, or learn a small model first."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import html_extract, language_id, license_scan, media, quality_rules, token_counts


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# --- media ---


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 40_000, 400_001])
def test_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    payload = media.payload_of(raw)
    stored = media.encode_many([payload, b"\xff" * 576, payload])
    assert [s.tobytes() for s, _, _ in media.decode_many(stored)] == [payload, b"\xff" * 576, payload]
    assert stored[0] == stored[2] and stored[0][:2] == b"\xff\xd8" and stored[0][-2:] == b"\xff\xd9"


def test_media_rows(documents, texts):
    for r in media.media_features(media.with_media(documents)).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.feature.startswith(f"192x{r.height}:") and r.payload_bytes * 64 == r.width * r.height


def _plain_jpegs(data):
    """DC samples of the images that stand one after another, read bit by bit as the format's standard says."""
    at, out = 0, []
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xd8"
        at += 2
        tables, quant, restart, high, wide = {}, None, 0, 0, 0
        while True:
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                quant = body[1:65]
            elif marker == 0xC0:
                assert body[0] == 8 and body[5] == 1
                high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            elif marker == 0xC4:
                codes, code, values = {}, 0, iter(body[17:])
                for bits in range(1, 17):
                    for _ in range(body[bits]):
                        codes[bits, code] = next(values)
                        code += 1
                    code <<= 1
                tables[body[0]] = codes
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                break
        bits = []

        def fill():
            nonlocal at
            byte = data[at]
            at += 2 if byte == 0xFF else 1
            assert byte != 0xFF or data[at - 1] == 0
            bits.extend(byte >> i & 1 for i in range(7, -1, -1))

        def take():
            if not bits:
                fill()
            return bits.pop(0)

        def symbol(codes):
            code = 0
            for n in range(1, 17):
                code = code << 1 | take()
                if (n, code) in codes:
                    return codes[n, code]
            raise AssertionError

        samples, last = [], 0
        for block in range(high // 8 * (wide // 8)):
            if block and block % restart == 0:
                bits.clear()
                assert data[at] == 0xFF and data[at + 1] == 0xD0 + (block // restart - 1) % 8
                at, last = at + 2, 0
            size, value = symbol(tables[0x00]), 0
            for _ in range(size):
                value = value << 1 | take()
            last += value if not size or value >> (size - 1) else value - (1 << size) + 1
            assert symbol(tables[0x10]) == 0  # end of block: no AC coefficient
            samples.append(last * quant[0] // 8 + 128)
        assert data[at : at + 2] == b"\xff\xd9"
        at += 2
        out.append((wide, high, samples))
    return out


def test_stored_bytes_are_jpegs_to_a_plain_reader(table):
    """A second decoder, by loops, gives the payload back; the feature is a mean hash of its thumbnail."""
    rng = random.Random(4)
    made = ["", "short", "x" * 577, "".join(rng.choice("abc é日 \n") for _ in range(3000)), None]
    stored = {r.doc_id: bytes(r.media) for r in media.with_media(table(made)).collect()}
    got = {r.doc_id: r for r in media.media_features(media.with_media(table(made))).collect()}
    for i, text in enumerate(made):
        images = _plain_jpegs(stored[i])
        samples = [x for _, _, own in images for x in own]
        assert bytes(samples) == media.payload_of((text or "").encode())
        rows = [samples[j : j + 24] for j in range(0, len(samples), 24)]
        edge = [j * len(rows) // 8 for j in range(9)]
        cells = [sum(sum(r[3 * c : 3 * c + 3]) for r in rows[edge[j] : edge[j + 1]]) / (3 * (edge[j + 1] - edge[j])) for j in range(8) for c in range(8)]
        mean = sum(cells) / 64
        want = f"{int(''.join(str(int(c > mean)) for c in cells), 2):016x}"
        assert got[i].feature == f"192x{8 * len(rows)}:{want}"


# --- licenses ---


def test_base_places(table):
    rng = random.Random(1)
    vocabulary = ["mit", "license", "apache", "general", "public", "gnu", "x", "é", "MIT", "License", "2"]
    made = [rng.choice([" ", "-", ". ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(made)).collect()}
    for i, text in enumerate(made):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            parts = phrase.split()
            for j in range(len(words)):
                if words[j : j + len(parts)] == parts:
                    places.append(j)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_rules_are_gated_by_their_keyword():
    listed = license_scan.rules()
    assert len(listed) > 200
    for rule in listed:
        assert re.compile(rule.pattern)
        assert rule.keyword == rule.keyword.strip().lower(), rule
        assert rule.keyword in re.sub(r"\(\?:[^()]*\)\??", " ", rule.pattern), rule


def test_suppression():
    rule = lambda label, priority: license_scan.Rule(label, label, label, priority, 0.5)
    rng = random.Random(2)
    found = [(a := rng.randrange(60), a + rng.randrange(1, 15), rule(str(i), rng.randrange(3))) for i in range(80)]
    kept = license_scan.suppress(found)
    better = sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label))
    want = []
    for one in better:
        if not any(k[0] <= one[0] and one[1] <= k[1] for k in want):
            want.append(one)
    assert set(kept) == set(want)


def test_labels_and_score_by_a_plain_scan(table, texts):
    """Every rule tried at every word of every text, without the prefilter; detections compared two by two."""
    rng = random.Random(12)
    listed = license_scan.rules()
    assert len([r for r in listed if r.priority in (1, 3, 5, 6)]) >= 200  # written by hand
    plain = lambda p: re.sub(r"\.\{0,\d+\}", " ", re.sub(r"\(\?:([^|()]*)(?:\|[^()]*)?\)\??", r"\1", p))
    samples = [plain(plain(r.pattern)).replace("?", "") for r in listed]
    made = [rng.choice([" ", ", ", "\n"]).join(rng.choice(samples) if rng.random() < 0.7 else "filler Words" for _ in range(rng.randint(0, 12))) for _ in range(150)]
    made += ["mit license mit license apache license apache license", *list(texts.values())[:40], None, ""]
    got = {r.doc_id: r for r in license_scan.scan_licenses(table(made)).collect()}
    seen = set()
    for i, text in enumerate(made):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        joined = " ".join(words)
        found = []
        for rule in listed:
            pattern, at = re.compile(rf"(?:^|(?<= ))(?:{rule.pattern})(?= |$)"), 0
            while m := pattern.search(joined, at):
                found.append((m.start(), m.end(), rule))
                at = m.end()
        rank = lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)
        weight = {}
        for one in found:
            if not any(o is not one and o[0] <= one[0] and one[1] <= o[1] and rank(o) < rank(one) for o in found):
                weight[one[2].label] = max(weight.get(one[2].label, 0), one[2].weight)
        for phrase, label in license_scan.BASE.items():
            if f" {phrase} " in f" {joined} ":
                weight[label] = max(weight.get(label, 0), 0.4)
        rest = 1.0
        for w in weight.values():
            rest *= 1 - w
        assert got[i].labels == ",".join(sorted(weight)) and got[i].score == pytest.approx(1 - rest, abs=2e-6), text
        seen |= set(weight)
    assert len(seen) > 60


def test_adjacent_detections(table):
    r = license_scan.scan_licenses(table(["all rights reserved all rights reserved"])).collect()[0]
    assert [(d.label, d.first, d.last) for d in r.detections] == [("all-rights-reserved", 0, 2), ("all-rights-reserved", 3, 5)]


def test_longer_license_hides_the_shorter(table):
    text = "SPDX-License-Identifier: Apache-2.0. Licensed under the Apache License, Version 2.0. All rights reserved."
    r = license_scan.scan_licenses(table([text])).collect()[0]
    assert r.base_labels == "apache" and set(r.labels.split(",")) == {"apache", "apache-2.0", "all-rights-reserved"}


# --- tokens ---


def test_token_counts_are_the_library_s(table, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(7)
    odd = "a'S don't    \x1c\x85 é ſ 日本 😀 ½ ² ̀ ʼ _ <|endoftext|>\n\n \t<|endoftext"
    made = [*list(texts.values())[:100], odd, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "", None, "   ", *("".join(rng.choice(odd) for _ in range(80)) for _ in range(300))]
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(table(made), path).collect()}
    for i, text in enumerate(made):
        want = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((text or "").encode()), want > 1024), text


def test_plain_characters_split_alike():
    """Each character of the fast path, in a few neighbourhoods, counts as the library says."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = [chr(c) for c in range(0x2100) if not token_counts.PLAIN.search(chr(c))]
    for c in plain:
        for text in (f"a{c}b", f"1{c}2", f" {c} !", f"{c}{c} "):
            pieces = regex.findall(token_counts.PRE_TOKEN, text)
            assert sum(len(tokenizer.encode(p)) for p in pieces) == len(tokenizer.encode(text)), repr(text)


def test_table_size_does_not_matter(documents):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(documents, path, table_size=n, calibration_docs=m).collect()) for n, m in ((4, 1), (30_000, 500))]
    assert rows[0] == rows[1]


# --- quality ---


def test_base_counts(documents, texts):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(documents).collect()}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        again = set()
        for j in range(len(words) - 2):
            if grams[tuple(words[j : j + 3])] > 1:
                again |= {j, j + 1, j + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_sketches_merge_and_find_quantiles(documents):
    measured = quality_rules.measure(documents)
    whole = {tuple(r)[:4]: r.n for r in quality_rules.sketches(measured).collect()}
    parts = Counter()
    for half in (measured.where("doc_id % 2 = 0"), measured.where("doc_id % 2 = 1")):
        for r in quality_rules.sketches(half).collect():
            parts[tuple(r)[:4]] += r.n
    assert parts == whole
    values = sorted(r.word_chars / r.n_words if r.n_words else 0 for r in measured.where("lang = 'en' and source = 'src0'").collect())
    limit = next(r for r in quality_rules.thresholds(quality_rules.sketches(measured), (("max_word_length", "word_length", 0.5, 1.0),)).collect() if (r.lang, r.source) == ("en", "src0"))
    true = values[int(np.ceil(0.5 * len(values))) - 1]
    assert true <= limit.max_word_length * (1 + 1e-9) and limit.max_word_length == pytest.approx(true, rel=quality_rules.GROWTH - 1)


def test_short_clean_texts_among_long_ones_stay(table):
    """No rule rejects a text by a count of 0 or of little evidence, however long the other texts of its group are."""
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, make(3000), "en", "a", 1) for i in range(20)] + [(100 + i, make(80), "en", "a", 1) for i in range(4)] + [(110, make(80) + " # $", "en", "a", 1), (111, "\n".join([make(60), "same line here", "same line here"]), "en", "a", 1)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(rows)).collect()}
    assert all(r.kept for r in got.values())


def test_limits_on_counts_come_from_quantile_or_mean(table):
    """The group's quantile where most texts have some, else its mean, which leans on the table's in small groups."""
    text = lambda k: " ".join(["abcde"] * (200 - k) + ["#bcde"] * k)
    rows = [(i, text(20), "en", "many", 1) for i in range(60)] + [(100 + i, text(20 * (i < 6)), "en", "few", 1) for i in range(60)] + [(200, text(0), "en", "lone", 1)]
    found = {r.source: r.max_symbols for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.measure(table(rows)))).collect()}
    table_mean = 0.02 * 66 / 121
    assert found["many"] == pytest.approx(4 * 0.02, rel=0.02)
    assert found["few"] == pytest.approx(4 * (0.02 * 6 + 100 * table_mean) / 160, rel=0.02)
    assert found["lone"] == pytest.approx(4 * 100 * table_mean / 101, rel=0.02)


def test_limits_follow_their_group(table):
    """The same text passes in a group where its ratios are usual and fails in one where they are not; groups differ in every limit."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    make = lambda sign, length: " ".join(word(length) + ("#" if rng.random() < sign else "") for _ in range(120))
    rows = [(i, make(0.0, 5), "en", "plain", 1) for i in range(40)] + [(100 + i, make(0.2, 9), "en", "code", 1) for i in range(40)]
    probe = make(0.2, 9)
    rows += [(200, probe, "en", "plain", 1), (201, probe, "en", "code", 1), (202, make(0, 5), "en", "plain", 1), (203, make(0.2, 5), "en", "code", 1)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in (200, 201, 202, 203)] == [False, True, True, False]
    assert all(got[i].kept for i in range(40))
    assert got[0].max_symbols < got[100].max_symbols and got[0].max_word_length < got[100].max_word_length and got[0].min_word_length < got[100].min_word_length


# --- language ---


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = [r for r in language_id.identify_language(documents).collect() if r.held_out]
    assert len(rows) > 30 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.95


def test_scores_are_kernel_ridge_regression():
    """Batched products give what kernels, counted one by one over sets of n-grams, and a ridge regression on Nyström features give."""
    rng = random.Random(3)
    words = {"aa": ["abba", "banana", "cab"], "xx": ["xyz", "zyx", "yoyo"], "mm": ["abba", "zyx", "mnop"]}
    made = [(" ".join(rng.choice(words[k]) for _ in range(30)), k) for k in words for _ in range(20)]
    texts, langs = [t for t, _ in made], [k for _, k in made]
    model = language_id.train(texts, langs, per_class_landmarks=5)
    codes = language_id._letter_codes()
    grams = lambda t: set(language_id._grams(t, codes)[0].tolist())
    kernel = lambda x, z: len(x & z) / (len(x) * len(z)) ** 0.5
    marks = [grams(texts[i]) for i in (*range(5), *range(20, 25), *range(40, 45))]
    among = np.array([[kernel(x, z) for z in marks] for x in marks])
    values, vectors = np.linalg.eigh(among)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    features = lambda ts: np.array([[kernel(grams(t), z) for z in marks] for t in ts]) @ root
    x = features(texts)
    goal = np.array([[1.0 if k == c else -1.0 for c in sorted(words)] for k in langs])
    solved = np.linalg.solve(x.T @ x / 20 + 1e-2 * np.eye(len(marks)), x.T @ goal / 20)
    probes = [*texts, "abba xyz unseen", "q", "Ünknown 日本 abba"]
    want = features(probes) @ solved
    for (lang, score), row in zip(language_id._scores(probes, model, codes), want, strict=True):
        assert score == pytest.approx(np.clip((row.max() + 1) / 2, 0, 1), abs=1e-3)
        assert row[sorted(words).index(lang)] == pytest.approx(row.max(), abs=2e-3)


def test_every_language_is_learned(table):
    """No number of languages is too many: 230 alphabets of four letters, of which each gets its texts back."""
    rng = random.Random(8)
    base = [c for c in map(chr, range(0x3400, 0x3400 + 230 * 4))]
    rows = []
    for k in range(230):
        for j in range(4):
            rows.append((len(rows), " ".join("".join(rng.choice(base[4 * k : 4 * k + 4]) for _ in range(5)) for _ in range(12)), f"l{k}", "a", 1))
    got = language_id.identify_language(table(rows)).collect()
    lang = {r[0]: r[2] for r in rows}
    learned = {lang[r.doc_id] for r in got if not r.held_out}
    assert all(r.lang_pred == lang[r.doc_id] for r in got if lang[r.doc_id] in learned) and len(learned) > 220


def test_training_sample_is_bounded(table):
    from pyspark.sql import functions as F

    rows = [(i, "abc " * 100, f"l{i % 3}", "a", 1) for i in range(60)]
    texts, langs = language_id.training_sample(table(rows).select("doc_id", "text", "lang"), F.lit(True), total_chars=3 * 1250)
    assert Counter(langs) == {"l0": 3, "l1": 3, "l2": 3}
    assert Counter(language_id.training_sample(table(rows).select("doc_id", "text", "lang"), F.lit(True), total_chars=3)[1]) == {"l0": 1, "l1": 1, "l2": 1}


def test_undetermined(table):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([None, "", "123 %%", "hello world text", "😀"])]
    rows += [(i, "some more english text", "en", "a", 1) for i in range(10, 20)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(table(rows)).collect()}
    assert got[0] == got[1] == got[2] == got[4] == ("und", 0.0) and got[3][0] == "en"


# --- html ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy</div><div class="cookie-notice">We use</div><article class="post"><h1>Head &amp; &lt;tail&gt;</h1><p>One <b>two</b>
 three.<p>Four&nbsp;five<br>six</p><form><label>Mail</label><input></form><aside>Side</aside><ul><li>Item</li></ul><!-- no --><section id="comments"><article><p>Nice!</p></article></section></article>
<footer>&copy; me</footer></body></html>"""


def test_marked_article():
    assert html_extract.article_text(PAGE) == "Head & <tail>\nOne two three.\nFour five\nsix\nItem"
    assert html_extract.article_text("<div><p>x</p></div>") is None


@pytest.mark.parametrize("page", ["<article><p>a<div class=ad>b</article>c", "<div class=ad><article>a</article>", "<main>a</main><nav>b", "<article>a<script>b</article>", "<article>a</span></b></article>", "<ARTICLE>a</ARTICLE>", "<div role='main'>a</div>b", "<article>a<nav>b<p>c</nav></article>", "<body class='comments-open'><article class='has-comments'>a<div class='comments'>b<article>c</article></div></article>", "<article>a</article><article class='comment'>b</article>"])
def test_broken_pages(page):
    assert html_extract.article_text(page) == "a"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article>a</article><aside><article>teaser</article></aside>", "a"),
        ("<aside><article>teaser</article></aside><main>a</main>", "a"),
        ("<div class='sidebar'><article>teaser</article></div><article>a</article>", "a"),
        ("<div class='sidebar'><article>teaser</article></div><div>a</div>", "a"),
        ("<aside><article>teaser</article></aside><div>a</div>", "a"),
        ("<div class='site-header-layout'><article>a</article></div>", "a"),
        ("<nav>menu<article>a</article>", "a"),
        ("<script>var x = '<main>';</script><div>a</div>", "a"),
        ("<!-- <article> --><div>a</div>", "a"),
        ('<article><a title="5" tall">a</a></article>', "a"),
        ('<article><a title="x>y" b=\'>\'>a</a><img alt=5">b</article>', "ab"),
        ("<article>a</article><section class='comments'>c<article>d</article></section>", "a"),
        ("<article>a" + "<p>" * 3000 + "</article>", "a"),
        ("<article>a<p", "a<p"),
        ("<article>3 < 4 &lt; 5 &#8217; &eacute;</article>", "3 < 4 < 5 \u2019 \u00e9"),
        ("<article>a</article>" + "<x y=\"" * 2000, "a"),
    ],
)
def test_whole_pages(spark, page, text):
    pages = spark.createDataFrame([(1, "http://a/", page)], "page_id bigint, url string, html string")
    assert html_extract.extract_text(pages).collect()[0].text == text


def test_every_page_is_its_article(spark, sf):
    """Pages of the test tables against a plain reading of their markup."""
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        want = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (want, len(want))


def test_odd_pages(spark):
    """Repeated rows without an article keep their text, clashing columns stay out, a very long page is whole."""
    body = "one two three four five six seven eight nine ten"
    notice = "<div>our offices are closed on every second sunday of the month</div>"
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "http://h/1", f"<div>{body}</div>"), (1, "http://h/1", f"<div>{body}</div>"), (2, "http://h/2", f"{notice}<p>alpha</p>"), (3, "http://h/3", f"{notice}<p>beta</p>"), (4, None, f"<article><p>{long}</p></article>"), (None, None, None)]
    pages = spark.createDataFrame([(*r, 5, "x", b"y", 7) for r in rows], "page_id bigint, url string, html string, _row int, host string, digest binary, salt int")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract_text(pages).collect()))
    assert got == [(0, "", 0), (1, body, len(body)), (1, body, len(body)), (2, "alpha", 5), (3, "beta", 4), (4, long, len(long))]


def test_host_runs(spark):
    menu = "<div><span>Home of all things</span></div><div>News from around the world today</div><div>About us and our work</div>"
    rng = random.Random(1)
    body = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    made = [(i, f"http://h{i % 2}.example/{i}", body()) for i in range(12)]
    pages = spark.createDataFrame([(i, u, f"<html><body>{menu}<p>{t}</p></body></html>") for i, u, t in made] + [(99, None, None), (98, "x", "")], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_text(pages).collect()}
    assert got == {i: (t, len(t)) for i, _, t in made} | {99: ("", 0), 98: ("", 0)}


def test_runs_repeat_over_a_whole_large_host(spark):
    """A notice on two of 3,000 pages goes, as it does on a small host."""
    notice = "this site will be down on sunday night for some repairs"
    rng = random.Random(2)
    body = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    made = [(i, "http://h.example/x", body(), notice if i % 100 == 7 and i < 200 else "") for i in range(3000)]
    pages = spark.createDataFrame([(i, u, f"<html><body><div>{n}</div><p>{t}</p></body></html>") for i, u, t, n in made], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_text(pages).collect()} == {i: t for i, _, t, _ in made}


def test_page_whose_only_article_is_a_comment(spark):
    html = "<html><body><div><p>The main text</p></div><section id='comments'><article><p>Nice!</p></article></section></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id bigint, url string, html string")
    assert html_extract.extract_text(pages).collect()[0].text == "The main text"


def _kept_by_brute_force(pages):
    """Of (host, blocks), the blocks that no runs shared with a page of other blocks cover, by a look at every run."""
    run = html_extract.RUN
    streams = [[w for b in own for w in [*b.split(), "\n"]] for _, own in pages]
    where = {}
    for (host, own), s in zip(pages, streams, strict=True):
        for i in range(len(s) - run + 1):
            where.setdefault((host, *s[i : i + run]), set()).add(tuple(own))
    out = []
    for (host, own), s in zip(pages, streams, strict=True):
        covered = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(where[(host, *s[i : i + run])]) > 1:
                covered[i : i + run] = [True] * run
        at, kept = 0, []
        for b in own:
            n = len(b.split())
            if sum(covered[at : at + n]) < html_extract.COVERED * n:
                kept.append(b)
            at += n + 1
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_array_is_brute_force(spark, seed):
    """Hosts with many repeats, one of them hot, whose heads stand on both sides of partitions' edges."""
    rng = random.Random(seed)
    pages = [("a" if rng.random() < 0.7 else "b", [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 4))]) for _ in range(60)]
    pages += pages[:5]
    rows = [(i, f"http://{host}/{i}", "".join(f"<p>{b}</p>" for b in own)) for i, (host, own) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == _kept_by_brute_force(pages)


def test_prefixes_meet_over_any_cut():
    """Ordered suffixes, cut anywhere between pages, settle the same places once the edges have met."""
    rng = random.Random(7)
    rows = sorted({("h", rng.choice("abc"), rng.choice([b"1", b"2", b"3", b"4"]), rng.randrange(9)) for _ in range(40)} | {("h", "d", b"1", 1), ("h", "d", b"1", 2)})
    held = {}
    for host, head, content, _ in rows:
        held.setdefault((host, head), set()).add(content)
    want = sorted((c, i) for host, head, c, i in rows if len(held[host, head]) > 1)
    for _ in range(200):
        cuts = sorted({0, len(rows), *(i for i in rng.sample(range(1, len(rows)), 6) if rows[i][:3] != rows[i - 1][:3])})
        out = [r for a, b in zip(cuts, cuts[1:]) for r in html_extract.shared_prefixes(iter(rows[a:b]))]
        met = {}
        for _, head, content, _ in out:
            if head:
                met.setdefault(head, set()).add(content)
        got = [(c, i) for _, head, c, i in out if head is None] + list({(c, i, head) for _, head, c, i in out if head and i is not None and len(met[head]) > 1})
        assert sorted(x[:2] for x in got) == want


def test_deep_markup_takes_linear_time():
    began = time.perf_counter()
    deep = "<div class=nav>" * 100_000 + "<p>gone</p>" + "</div>" * 100_000
    assert html_extract.article_text("<article><p>a</p>" + deep + "<p>b</p></article>") == "a\nb"
    assert html_extract.article_text("<article>" + "<div><b>" * 50_000 + "x" + "</i>" * 100_000 + "</article>") == "x"
    assert html_extract.article_text("<div class=ad>" * 50_000 + "<article><p>in</p></article>" + "</div>" * 50_000 + "<article><p>own</p></article>") == "own"
    assert time.perf_counter() - began < 20


def test_a_teaser_beside_the_article_goes():
    assert html_extract.article_text("<main><article><p>own</p></article><article class='teaser'><p>other</p></article></main>") == "own"


def _own(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_marked_articles_meet_in_the_suffix_array(spark):
    """A notice in most of a host's articles goes, one in few stays, and so does what near copies share."""
    rng = random.Random(3)
    notice, quote, copy = "read our free weekly letter with all the news", "to be or not to be that is the question", _own(rng, 30)
    made = [(i, "http://a/x", [_own(rng, 20), *([quote] if i % 3 == 0 else []), *([notice] if i % 4 else [])]) for i in range(40)]
    made += [(100 + i, "http://b/x", [copy, _own(rng, 3)]) for i in range(40)] + [(200 + i, "http://c/x", [_own(rng, 20), notice]) for i in range(4)]
    made.append(made[1])
    pages = spark.createDataFrame([(i, u, f"<nav>x</nav><article>{''.join(f'<p>{b}</p>' for b in own)}</article>") for i, u, own in made], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_text(pages).collect())
    want = [(i, "\n".join(b for b in own if b != notice or u != "http://a/x")) for i, u, own in made]
    assert got == sorted((i, t, len(t)) for i, t in want)


def test_runs_of_half_the_articles_are_brute_force(spark, monkeypatch):
    """Hosts dealt over groups or not, against a count of every run."""
    monkeypatch.setattr(html_extract, "PART", 7)
    rng = random.Random(4)
    some = [_own(rng, 9) for _ in range(12)]
    pages = [(rng.choice("aaab"), [rng.choice(some[: rng.choice((1, 1, 2, 12))]) for _ in range(rng.randint(1, 3))] + [_own(rng, 30)]) for _ in range(90)]
    where, hosts = {}, {}
    for host, own in pages:
        s = html_extract.words_of(own)
        hosts.setdefault(host, set()).add(tuple(own))
        for i in range(len(s) - html_extract.RUN + 1):
            where.setdefault((host, *s[i : i + html_extract.RUN]), set()).add(tuple(own))
    want = []
    for host, own in pages:
        s = html_extract.words_of(own)
        need = max(html_extract.LEAST, len(hosts[host]) * html_extract.SHARED)
        at = [i for i in range(len(s) - html_extract.RUN + 1) if len(where[(host, *s[i : i + html_extract.RUN])]) >= need]
        want.append("\n".join(html_extract.kept_blocks(own, at, html_extract.MOST)))
    rows = [(i, f"http://{host}/{i}", "<main>" + "".join(f"<p>{b}</p>" for b in own) + "</main>") for i, (host, own) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == want and want != ["\n".join(own) for _, own in pages]
