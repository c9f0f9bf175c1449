"""Noun chunks against hand-tagged sentences and a plain loop."""

import re

import pytest

import __spark_entry__ as entry
from evidentia.functions import chunks

#: Sentences with a tag for each token, by hand.
TAGGED = [
    ("The company reported a net loss of $5.2 million.", "DNVDJNIMMU"),
    ("Our revenue increased sharply in 2023.", "DNVAIMU"),
    ("She does not like the new offices.", "RXAVDJNU"),
    ("Apple's annual report shows strong demand for phones.", "PSJNVJNINU"),
    ("They bought three small factories near Berlin and Paris.", "RVMJNIPCPU"),
    ("It is a very important market.", "RXDAJNU"),
    ("The investigation of the regulator was successful.", "DNIDNXJU"),
    ("He wants to sell his shares.", "RVTVDNU"),
]

CHUNKS = [
    ("The company reported a net loss of $5.2 million.", ["the company", "a net loss", "$5.2 million"]),
    ("Apple's annual report shows strong demand for  phones.", ["apple's annual report", "strong demand", "phones"]),
    ("They bought three small factories near New\nYork. They left.", ["they", "three small factories", "new york"]),
    ("It is a very important market; the U.S. economy grew.", ["it", "a very important market", "the u.s. economy"]),
    ("", []),
    (None, []),
    ("... !!!", []),
    ("12 13 14", ["12 13 14"]),
]


def tokens(text):
    return [text[a:b] for spans in chunks.split(text) for a, b in spans]


def test_hand_tagged_sentences():
    got = chunks.tagged([tokens(s) for s, _ in TAGGED])
    pairs = [(a, b) for g, (_, want) in zip(got, TAGGED, strict=True) for a, b in zip(g, want, strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs), list(zip(got, TAGGED, strict=True))


@pytest.mark.parametrize(("text", "want"), CHUNKS)
def test_chunks(text, want):
    assert chunks.chunks_of([text])[0] == want


def plain(text):
    """Chunks by one sentence and one tag at a time."""
    out = []
    for spans in chunks.split(text or ""):
        words = [text[a:b] for a, b in spans]
        best = {t: (chunks._BEGIN[i] + chunks.likely(words[0], True)[i], t) for i, t in enumerate(chunks.TAGS)}
        for w in words[1:]:
            row = chunks.likely(w, False)
            new = {}
            for j, t in enumerate(chunks.TAGS):
                score, before = max(((best[p][0] + chunks._STEP[i][j], -i) for i, p in enumerate(chunks.TAGS)))
                new[t] = (score + row[j], best[chunks.TAGS[-before]][1] + t)
            best = new
        path = max((best[t][0], -i) for i, t in enumerate(chunks.TAGS))[1]
        tags = best[chunks.TAGS[-path]][1]
        for m in re.finditer(chunks._CHUNK, tags):
            found = " ".join(text[spans[m.start()][0] : spans[m.end() - 1][1]].lower().split())
            if found not in out:
                out.append(found)
    return out


def test_query_is_a_plain_loop(spark, sf):
    got = {(r.conv_id, r.turn, r.role): (r.n, r.chunks) for r in entry.queries()["q118_noun_chunks"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert len(got) == len({(r.conv_id, r.turn, r.role) for r in rows}) > 0
    for r in rows:
        want = plain(r.text)
        assert got[r.conv_id, r.turn, r.role] == (len(want), "|".join(want))


def test_long_texts_and_blocks(monkeypatch):
    texts = ["The old market grew " * n for n in (1, 7, 3)] + ["word " * 50_000, "the new " * 20_000]
    whole = chunks.chunks_of(texts)
    monkeypatch.setattr(chunks, "CELLS", 16)
    assert chunks.chunks_of(texts[:3]) == whole[:3]
    assert whole[3] == [("word " * 50_000).strip()]
