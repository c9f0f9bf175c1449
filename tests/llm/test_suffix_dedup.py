import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import suffix_dedup as S


def brute(texts):
    """Covered bytes of each text, by looking up every string of 100 bytes."""
    seen, out = set(), []
    for raw in texts:
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            else:
                seen.add(raw[p : p + 100])
        out.append(bytes(covered))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = "abcde é\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([60, 99, 100, 101, 150, 400]))) for _ in range(8)]
    out = []
    for i in range(150):
        parts = [rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 70) :], "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))]) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if i % 6 == 0 and out:
            copy = list(rng.choice(out))
            for _ in range(min(3, len(copy))):
                copy[rng.randrange(len(copy))] = "z"
            text = "".join(copy)
        out.append(text)
    return [*out, "x" * 900, "x" * 900, "ab" * 300, out[3]]


def test_rows_are_brute_force(table, texts):
    got = {r.doc_id: r for r in S.suffix_dedup(table(texts)).collect()}
    for i, (raw, covered) in enumerate(zip([t.encode() for t in texts], brute([t.encode() for t in texts]), strict=True)):
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", covered)]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(covered), len(spans), hashlib.sha256(kept).hexdigest())
        assert [(s.start, s.end) for s in got[i].spans] == spans


def test_small_groups_and_pieces(spark, table, texts, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    monkeypatch.setattr(S, "PIECE", 300)
    test_rows_are_brute_force(table, texts)


def test_frequent_grams(spark, table, texts, monkeypatch):
    """A task deals out few rows of a gram; the rest are sorted in groups of their own."""
    monkeypatch.setattr(S, "SEND", 8)
    test_rows_are_brute_force(table, texts)


def test_order_is_by_doc_id(table):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    rows = [(9, text, None, None, None), (-4, text, None, None, None), (None, text, None, None, None), (None, text, None, None, None)]
    got = {r.doc_id: r.n_removed for r in S.suffix_dedup(table(rows)).collect()}
    assert got == {9: 300, -4: 0, None: 300}


def test_repeated_rows(table):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    rows = [(1, text, None, None, None)] * 3 + [(2, text[:99], None, None, None)] * 2
    got = sorted(r.n_removed for r in S.suffix_dedup(table(rows)).collect())
    assert got == [0, 0, 0, 300, 300]


def test_removed_text(table, texts):
    got = {r.doc_id: r for r in S.remove_repeats(table(texts)).collect()}
    for i, (text, covered) in enumerate(zip(texts, brute([t.encode() for t in texts]), strict=True)):
        left = bytes(b for b, c in zip(text.encode(), covered, strict=True) if not c).decode("utf-8", "ignore")
        if left.strip() or not text.strip():
            assert got[i].text == left and got[i].n_chars == len(left)
        else:
            assert i not in got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40), st.integers(100, 140)), min_size=2, max_size=40))
def test_equal_windows(places):
    import numpy as np

    base = [bytes([97 + i]) * 40 + b"common prefix of some length " * 6 + bytes([97 + i % 2]) * 60 for i in range(6)]
    context = np.frombuffer(b"".join(base), np.uint8)
    start = np.array([i * len(base[0]) + at for i, at, _ in places])
    key = np.array([k for _, _, k in places])
    got = S.equal_windows(context, start, key)
    strings = [(k, context[s : s + 100].tobytes()) for s, k in zip(start.tolist(), key.tolist(), strict=True)]
    for i in range(len(strings)):
        for j in range(i):
            same = strings[i] == strings[j]
            assert same == (got[i] >= 0 and got[i] == got[j])
        assert (got[i] >= 0) == (strings.count(strings[i]) > 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40), st.integers(0, 3)), min_size=0, max_size=60), st.integers(0, 3))
def test_suffix_order(places, letters):
    """The suffix array is the sorted order of (key, string)."""
    import numpy as np

    rng = random.Random(letters)
    base = [bytes(rng.choice(b"ab\xff\x00"[: letters + 1]) for _ in range(40)) + b"common prefix of some length " * 6 + bytes([97 + i % 2]) * 60 for i in range(6)]
    context = np.frombuffer(b"".join(base), np.uint8)
    start = np.array([i * len(base[0]) + at for i, at, _ in places], np.int64)
    key = np.array([k for _, _, k in places], np.int64)
    order, equal = S.suffix_order(context, start, key)
    strings = [(int(key[i]), context[start[i] : start[i] + 100].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(len(places))) and strings == sorted(strings)
    assert equal.tolist() == [i > 0 and strings[i] == strings[i - 1] for i in range(len(strings))]


def test_late_rows_stand_in_bounded_groups(table, monkeypatch):
    """A separator that fills long texts: no group of a batch holds more than GROUP rows of a gram."""
    import pyarrow as pa

    monkeypatch.setattr(S, "GROUP", 16)
    monkeypatch.setattr(S, "SEND", 8)
    rng = random.Random(3)
    texts = ["".join("-" * 40 + "".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(40)) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array([0] * 10, pa.int64()), pa.array(texts)], ["o", "tell", "text"])
    rows = [r for out in S._first_pass(batch, {}) for r in out.to_pylist()]
    late = {}
    for r in rows:
        if r["end"] == S._STRETCH:
            late.setdefault((r["a"], r["u"]), []).append(r)
    assert late and max(map(len, late.values())) <= 16
    test_rows_are_brute_force(table, texts)
