"""Suffix-array dedup: bytes under a string of 100 bytes that also starts earlier, by deep-shallow suffix sorting.

A sparse suffix array: of the 69 grams of 32 bytes in each 100-byte string, the one with the least hash is its
anchor, so equal strings have equal anchors at equal places.  Strings that follow one another share anchors, one in
35 bytes or so.  Only anchors are dealt out, by gram.  An anchor's strings, as one stretch of up to 168 bytes, have a
128-bit digest with its gram: occurrences after a digest's first are covered as a whole, without a comparison of their
bytes.  What remains are stretches that share a gram but differ, around edits and passage ends.  Their suffixes are
sorted: by multikey quicksort on 8-byte words to a shallow depth, then, where prefixes go on being equal, by blind
tries that look only at bytes in which a group differs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, map_arrow, stored

#: Bytes in a string, in an anchor's gram, and grams in a string.
LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Bytes hashed at once; suffixes sorted by quicksort up to this depth; stretches in a group that are sorted at once.
PIECE, SHALLOW, GROUP = 1 << 18, 16, 2048
#: Bits of a text's hash that tell apart documents of the same doc_id.
TELL_BITS = 18

_M = (1 << 64) - 1
_RNG = np.random.Generator(np.random.PCG64(60_013))
_BYTES = _RNG.integers(0, _M, 256, np.uint64, endpoint=True)
_ODD = _RNG.integers(0, _M, 16, np.uint64, endpoint=True) | np.uint64(1)
#: Rows of a gram that a task deals out by gram; what is added to the numbers of groups whose gram has stretches elsewhere.
SEND, _FAR = 64, 1 << 40
NULL_ID = (1 << 63) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text number, first and last start of an anchor's strings, the anchor's place, gram hash, stretch digest."""
    n, h, grams = len(raw), _BYTES[raw], {}
    for level in range(6):  # grams of 2 to 64 bytes, each from two halves
        k = 1 << level
        joined = np.zeros(n, np.uint64)
        if n > k:
            joined[: n - k] = h[: n - k] * _ODD[level] + h[k:]
        h = joined ^ (joined >> np.uint64(29))
        if 2 * k in (GRAM, 64):
            grams[2 * k] = h
    place = np.uint64((1 << 20) - 1)
    least = ((grams[GRAM] * _ODD[8]) & ~place) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.concatenate((np.minimum(least[: n - width], least[width:]), least[max(0, n - width) :])) if n > width else least
        width *= 2
    rest = WINDOW - width
    if rest and n > rest:
        least = np.concatenate((np.minimum(least[: n - rest], least[rest:]), least[n - rest :]))
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    start = np.flatnonzero(np.arange(n) + LENGTH <= ends[text])
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = (least[start] & place).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]])
    first = np.flatnonzero(new)
    s, e, i = start[first], start[np.append(first[1:], len(start)) - 1], at[first]
    wide = grams[64]
    u = _mix(wide[s] * _ODD[9] + wide[np.minimum(s + 64, e + LENGTH - 64)] * _ODD[10] + wide[e + LENGTH - 64] * _ODD[11] + ((i - s) * 128 + e - s).astype(np.uint64) * _ODD[12])
    base = (ends - lengths)[text[s]]
    return text[s], s - base, e - base, i - base, _mix(grams[GRAM][i]), u


def _pieces(texts: list[bytes]):
    """(number, offset, bytes) of parts of texts that overlap by one string less a byte, in blocks of about PIECE bytes."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE) if len(raw) >= LENGTH else ():
            part = raw[at : at + PIECE + LENGTH - 1]
            if size + len(part) > PIECE + LENGTH and held:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _pack(start, tell, ahead, more):
    """One long: the first string's start, the text's hash, and how far the gram and the last string start after it."""
    return (start << 32) | (tell << 14) | (ahead << 7) | more


_TELL = (1 << TELL_BITS) - 1
_NAMES = ("a", "u", "o", "m", "end")
#: In ``end``, where no span ends: an occurrence of a digest, a stretch that is to be sorted in any case, or the notice,
#: first of its gram's rows by the least digest, that there are such stretches.
_OCCURRENCE, _STRETCH, _NOTICE = -1, -2, -3
_LEAST = -(1 << 63)


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns.values()], list(columns))


def _spans(o: np.ndarray, tell: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Covered spans of documents, merged."""
    order = np.lexsort((start, tell, o))
    o, tell, start, end = o[order], tell[order], start[order], end[order]
    out: list[tuple] = []
    if len(o):
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (tell[1:] != tell[:-1])
        owner = np.cumsum(new) - 1
        reach = np.maximum.accumulate(end + (owner << 32)) - (owner << 32)
        cut = new.copy()
        cut[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(cut)
        return o[at], tell[at], start[at], reach[np.append(at[1:], len(o)) - 1]
    return o, tell, start, end


def _first_pass(batch: pa.RecordBatch, sent: dict[int, int]):
    """A batch's first occurrences of digests, and spans that earlier ones in the batch cover.

    ``sent`` counts a task's rows of grams that are frequent in a batch.  After SEND of a gram the task deals out no
    more: such rows are stretches to be sorted, in a group of the batch's own.  So around a passage that a third of
    all documents holds, a gram's rows in one place grow with tasks, not with documents.
    """
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    o, tell = batch.column("o").to_numpy(), batch.column("tell").to_numpy().astype(np.int64)
    found = []
    for block in _pieces(texts):
        number, s, e, i, a, u = anchors(np.frombuffer(b"".join(p for _, _, p in block), np.uint8), np.array([len(p) for _, _, p in block]))
        own = np.array([x[0] for x in block])[number] if len(number) else number
        at = np.array([x[1] for x in block])[number] if len(number) else number
        found.append((a.view(np.int64), u.view(np.int64), o[own], _pack(s + at, tell[own], i - s, e - s)))
    if not found:
        return
    a, u, o, m = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((m, o, u, a))
    a, u, o, m = a[order], u[order], o[order], m[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (u[1:] != u[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & ((o != o[head]) | (m != m[head]))
    co, ct, cs, ce = _spans(o[later], (m[later] >> 14) & _TELL, m[later] >> 32, (m[later] >> 32) + (m[later] & 127) + LENGTH)
    zero = np.zeros(len(co), np.int64)
    a, u, o, m = a[new], u[new], o[new], m[new]
    end = np.full(len(a), _OCCURRENCE)
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(start, len(a)))
    for at, n in zip(start[size > SEND // 8].tolist(), size[size > SEND // 8].tolist(), strict=True):
        room = max(0, SEND - sent.get(int(a[at]), 0))
        sent[int(a[at])] = SEND - room + n
        if n > room:
            end[at + room : at + n] = _STRETCH
    late = end == _STRETCH
    # groups of the batch's own have at most GROUP rows of a gram
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), np.arange(len(a)), 0))
    group = ((int(_mix(o[late][:1].astype(np.uint64) ^ m[late][:1].astype(np.uint64))[0]) >> 2) | 1 << 61) + rank // GROUP if late.any() else 0
    note = np.unique(a[late])
    none = np.zeros(len(note), np.int64)
    u = np.where(late, a, u)
    a = np.where(late, group, a)
    key = _mix(o.astype(np.uint64) + m.astype(np.uint64)).view(np.int64)
    # a stretch carries its group in a; it and spans may go to any task
    deal = np.concatenate((np.where(late, key, a), _mix(co.astype(np.uint64)).view(np.int64), note))
    columns = {"a": (a, zero, note), "u": (u, zero, none + _LEAST), "o": (o, co, none), "m": (m, _pack(cs, ct, zero, zero), none), "end": (end, ce, none + _NOTICE)}
    yield _rows(deal=deal, **{k: np.concatenate(v) for k, v in columns.items()})


def _resolve(batches):
    """Rows sorted by gram, digest and order: covered spans pass; a digest's later rows are covered; the first rows of a
    gram's digests, if there are several, need sorting.  State is one row, however large a group is."""
    last = None  # of the rows so far: gram, digest, the digest's first row, whether it has been given, rows given of the gram
    noted = None  # the gram of the last row, if it has a notice
    for batch in batches:
        a, u, o, m, end = (batch.column(c).to_numpy() for c in _NAMES)
        span, late = end >= 0, end == _STRETCH
        outs = [(np.zeros(span.sum(), np.int64), o[span], m[span], end[span]), (a[late], o[late], m[late], np.full(late.sum(), -1, np.int64), u[late])]
        rows = ~span & ~late
        real = end[rows] == _OCCURRENCE
        grams = a[rows]
        hot = np.concatenate((grams[~real], np.array([] if noted is None else [noted], np.int64)))
        if len(grams):
            noted = grams[-1] if (hot == grams[-1]).any() else None
        a, u, o, m = (x[rows][real] for x in (a, u, o, m))
        if len(a):
            same_a = np.zeros(len(a), bool)
            same_u = np.zeros(len(a), bool)
            same_a[1:] = a[1:] == a[:-1]
            same_u[1:] = same_a[1:] & (u[1:] == u[:-1])
            if last:
                same_a[0] = a[0] == last[0]
                same_u[0] = same_a[0] and u[0] == last[1]
            else:
                last = (0, 0, 0, 0, False, 0)
            index = np.where(same_u, -1, np.arange(len(a)))
            head = np.maximum.accumulate(index)
            ho, hm = np.where(head < 0, last[2], o[head]), np.where(head < 0, last[3], m[head])
            later = same_u & ((o != ho) | (m != hm))
            outs.append((np.zeros(later.sum(), np.int64), o[later], m[later], (m[later] >> 32) + (m[later] & 127) + LENGTH))
            firsts = np.flatnonzero(~same_u)
            fa = a[firsts]
            far = np.isin(fa, hot) * _FAR
            if len(firsts) == 0:
                yield from _emit(outs)
                continue
            before = np.append(same_a[firsts[0]], fa[1:] == fa[:-1])
            after = np.append(fa[1:] == fa[:-1], False)
            # the last first row waits for what follows it
            give = before | after | (far > 0)
            rank = np.arange(len(firsts)) - np.maximum.accumulate(np.where(before, 0, np.arange(len(firsts))))
            carried = last[5] if before[0] else 0
            lead = np.cumsum(~before) == 0
            if before[0] and not last[4]:
                outs.append(tuple(np.array([x], np.int64) for x in (far[0], last[2], last[3], -1, last[0])))
                carried = 1
            rank = np.where(lead, np.arange(len(firsts)) + carried, rank)
            at = firsts[give]
            outs.append((rank[give] // GROUP + far[give], o[at], m[at], np.full(len(at), -1, np.int64), a[at]))
            last = (int(a[-1]), int(u[-1]), int(o[firsts[-1]]), int(m[firsts[-1]]), bool(give[-1]), int(rank[-1]) + 1)
        yield from _emit(outs)


def _emit(outs):
    full = [x if len(x) == 5 else (*x, np.zeros(len(x[0]), np.int64)) for x in outs]
    g, o, m, end, a = (np.concatenate(x) for x in zip(*full, strict=True))
    if len(o):
        yield _rows(a=a, g=g, o=o, m=m, end=end)


def _starts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of segments, of flags that tell where one begins."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _quicksort(order: np.ndarray, pos: np.ndarray, new: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the segments of ``order`` at places ``pos``, on 8-byte words, all segments in step.

    A round splits each segment by the median of three of its words into less, equal and greater.  The equal part goes
    on with the next word.  Returns places and segment flags of what is equal to the shallow depth.
    """
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    depth = np.zeros(len(pos), np.int64)
    table = np.stack(words)
    while len(pos):
        first, size = _starts(new)
        segment = np.repeat(np.arange(len(first)), size)
        rows = order[pos]
        word = table[depth, rows]
        three = np.sort(np.stack((word[first], word[first + size // 2], word[first + size - 1])), axis=0)
        pivot = three[1][segment]
        part = (word > pivot).astype(np.int64) + (word >= pivot)
        counts = np.stack([np.add.reduceat(part == k, first, dtype=np.int64) for k in range(3)])
        base = first + np.cumsum(counts, axis=0) - counts
        target = np.empty(len(pos), np.int64)
        for k in range(3):
            mine = part == k
            nth = np.cumsum(mine)
            target[mine] = (base[k] - (nth[first] - mine[first]))[segment[mine]] + nth[mine] - 1
        moved, kinds = np.empty_like(rows), np.empty_like(part)
        moved[target], kinds[target] = rows, part
        order[pos] = moved
        depth = depth + (kinds == 1)
        new = new.copy()
        new[1:] |= kinds[1:] != kinds[:-1]
        first, size = _starts(new)
        many, done = np.repeat(size > 1, size), depth == len(words)
        if (many & done).any():
            deep.append((pos[many & done], new[many & done]))
        pos, new, depth = pos[many & ~done], new[many & ~done], depth[many & ~done]
    if not deep:
        return pos, new
    where, flags = (np.concatenate(x) for x in zip(*deep, strict=True))
    return where, flags


def _blind_tries(order: np.ndarray, pos: np.ndarray, new: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Order segments of ``order`` at places ``pos`` by tries that look only at bytes in which a segment differs.

    ``matrix`` holds the bytes beyond the shallow depth.  A node of a trie is a segment, its branch the first byte in
    which the segment's strings differ, its children in the order of that byte.  Returns the places whose string is
    equal to the one before.
    """
    equal: list[np.ndarray] = [np.empty(0, np.int64)]
    rows = order[pos]
    while len(pos):
        first, size = _starts(new)
        differs = np.minimum.reduceat(matrix, first, axis=0) != np.maximum.reduceat(matrix, first, axis=0)
        branch, inner = differs.argmax(1), np.repeat(differs.any(1), size)
        equal.append(pos[~inner & ~new])
        byte = matrix[np.arange(len(pos)), np.repeat(branch, size)]
        segment = np.repeat(np.arange(len(first)), size)
        at = np.argsort(segment * 256 + byte, kind="stable")
        rows, matrix, byte = rows[at], matrix[at], byte[at]
        order[pos] = rows
        new = new.copy()
        new[1:] |= (byte[1:] != byte[:-1]) & inner[1:]
        _, size = _starts(new)
        go = inner & np.repeat(size > 1, size)
        pos, new, rows, matrix = pos[go], new[go], rows[go], matrix[go]
    return np.concatenate(equal)


def suffix_order(context: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of the LENGTH-byte strings at ``start``, by key and then by bytes, and whether each string is
    equal to the one before it.  Deep-shallow: multikey quicksort to SHALLOW bytes, blind tries beyond."""
    order = np.argsort(key, kind="stable")
    equal = np.zeros(len(order), bool)
    if not len(order):
        return order, equal
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    _, size = _starts(new)
    many = np.flatnonzero(np.repeat(size > 1, size))
    if len(many):
        words, rest = (np.lib.stride_tricks.sliding_window_view(context, n) for n in (8, LENGTH - SHALLOW))
        shallow = [words[start + depth].copy().view(">u8").ravel().astype(np.uint64) for depth in range(0, SHALLOW, 8)]
        pos, flags = _quicksort(order, many, new[many], shallow)
        if len(pos):
            equal[_blind_tries(order, pos, flags, rest[start[order[pos]] + SHALLOW])] = True
    return order, equal


def equal_windows(context: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Classes of equal LENGTH-byte strings at ``start`` among those of the same key; -1 for a string without an equal."""
    order, equal = suffix_order(context, start, key)
    out = np.full(len(start), -1, np.int64)
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))
    several = equal.copy()
    several[:-1] |= equal[1:]
    out[order[several]] = order[head[several]]
    return out


def _sort_stretches(a, g, o, m, contexts: list[bytes]):
    """Of stretches in whole groups (a, g), in order: covered spans, and digests of strings that other groups may hold."""
    sizes = np.array([len(c) for c in contexts])
    more, ahead = m & 127, (m >> 7) & 127
    count = more + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    context = np.frombuffer(b"".join(contexts), np.uint8)
    start = (np.cumsum(sizes) - sizes)[owner] + within
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
    group = np.cumsum(new) - 1
    key = group[owner] * 128 + ahead[owner] - within
    found = equal_windows(context, start, key)
    place, tell = (m >> 32)[owner] + within, ((m >> 14) & _TELL)[owner]
    order = np.lexsort((tell, place, o[owner], found))
    f, oo, pp, tt = found[order], o[owner][order], place[order], tell[order]
    head = np.ones(len(f), bool)
    head[1:] = f[1:] != f[:-1]
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (f >= 0) & ((oo != oo[at]) | (pp != pp[at]) | (tt != tt[at]))
    spans = _spans(oo[later], tt[later], pp[later], pp[later] + LENGTH)
    big = ((np.bincount(group)[group] >= GROUP) | (g > 0))[owner]  # only then may other groups hold the gram
    first = np.zeros(len(f), bool)
    first[order] = (f < 0) | head
    ask = np.flatnonzero(big & first)
    return spans, (o[owner][ask], place[ask], tell[ask], [hashlib.blake2b(context[start[i] : start[i] + LENGTH].tobytes(), digest_size=16).digest() for i in ask])


def _compare(batches):
    """Stretches sorted by group and order to covered spans, and to digests where a gram has several groups."""
    names = ("a", "g", "o", "m")

    def run(rows):
        columns = [np.array([r[i] for r in rows], np.int64) for i in range(4)]
        (o, tell, s, e), (ao, ap, at, digests) = _sort_stretches(*columns, [r[4] for r in rows])
        ids = np.concatenate((o, ao))
        ends = np.concatenate((e, np.full(len(ao), -1, np.int64)))
        packed = np.concatenate((_pack(s, tell, 0, 0), _pack(ap, at, 0, 0)))
        return pa.RecordBatch.from_arrays([pa.array([None] * len(o) + digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(packed, pa.int64()), pa.array(ends, pa.int64())], ["d", "o", "m", "end"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), batch.column("context").to_pylist(), strict=True):
            if len(held) >= GROUP and row[:2] != held[-1][:2]:
                yield run(held)
                held = []
            held.append(row)
    if held:
        yield run(held)


def _later_digests(batches):
    """Rows sorted by digest and order: all but a digest's first are covered."""
    last = None
    for batch in batches:
        rows = []
        for d, o, m in zip(*(batch.column(c).to_pylist() for c in ("d", "o", "m")), strict=True):
            if last and d == last[0]:
                if (o, m) != last[1:]:
                    rows.append((o, m, (m >> 32) + LENGTH))
            else:
                last = (d, o, m)
        if rows:
            o, m, e = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            o, t, s, e = _spans(o, (m >> 14) & _TELL, m >> 32, e)
            yield _rows(o=o, m=_pack(s, t, 0, 0), end=e)


def _contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for o, text, wanted in zip(batch.column("o").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
        for w in wanted:
            s = w["m"] >> 32
            out.append((w["a"], w["g"], o, w["m"], text[s : s + (w["m"] & 127) + LENGTH]))
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["a", "g", "o", "m", "context"])


def covered_spans(keyed: DataFrame) -> DataFrame:
    """o, tell, start, end of spans of documents (o, tell, text) under strings that start earlier; spans may overlap.

    Rows are dealt by key without a number of partitions, so that adaptive execution joins small ones: tables then have
    as many files as their size asks for.
    """
    spark = keyed.sparkSession
    bounded_batches(spark)
    rows = map_arrow(keyed, _first_pass, "deal bigint, a bigint, u bigint, o bigint, m bigint, end bigint", dict)
    dealt = rows.repartition("deal").drop("deal").sortWithinPartitions("a", "u", "o", "m")
    state = stored(dealt.mapInArrow(_resolve, "a bigint, g bigint, o bigint, m bigint, end bigint"), "anchors")
    wanted = state.where(F.col("end") < 0).groupBy("o", F.expr(f"(m >> 14) & {_TELL}").alias("tell")).agg(F.collect_set(F.struct("a", "g", "m")).alias("wanted"))
    sought = map_arrow(keyed.join(wanted, ["o", "tell"]).select("o", "text", "wanted"), _contexts, "a bigint, g bigint, o bigint, m bigint, context binary")
    compared = stored(sought.repartition("a", "g").sortWithinPartitions("a", "g", "o", "m").mapInArrow(_compare, "d binary, o bigint, m bigint, end bigint"), "stretches")
    asked = compared.where(F.col("end") < 0).select("d", "o", "m").repartition("d").sortWithinPartitions("d", "o", "m")
    more = asked.mapInArrow(_later_digests, "o bigint, m bigint, end bigint")
    parts = [x.where(F.col("end") >= 0).select("o", "m", "end") for x in (state, compared)]
    spans = parts[0].unionByName(parts[1]).unionByName(more)
    return spans.select("o", F.expr(f"(m >> 14) & {_TELL}").alias("tell"), F.shiftright("m", 32).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def _keyed(documents: DataFrame, *extra: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("o"), F.xxhash64(text).bitwiseAND(F.lit(_TELL)).alias("tell"), text.alias("text"), *extra)


def _merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for packed in sorted(spans or ()):
        start, end = packed >> 32, packed & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _with_spans(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its covered spans, rows of the same o and tell next to one another."""
    spans = covered_spans(keyed.select("o", "tell", "text")).groupBy("o", "tell").agg(F.collect_list(F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("end")).alias("spans"))
    return keyed.repartition("o", "tell").sortWithinPartitions("o", "tell").join(spans, ["o", "tell"], "left")


class _Seen:
    """Tells a repeated row: same doc_id and text as one before it."""

    def __init__(self) -> None:
        self.key, self.texts = None, set()

    def __call__(self, key: tuple, raw: bytes) -> bool:
        if key != self.key:
            self.key, self.texts = key, set()
        digest = hashlib.blake2b(raw, digest_size=16).digest()
        again = digest in self.texts
        self.texts.add(digest)
        return again


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and its removed spans.

    A string is earlier if its doc_id is smaller or, within a document, its start.  Strings are judged on the input.
    A null text is empty.  Null doc_ids come last, as one id.  Among rows of one doc_id, places and then hashes of
    the texts decide; of repeated rows, all but one are copies, so removed if they have 100 bytes.
    """
    keyed = _keyed(documents)

    def run(batch: pa.RecordBatch, seen) -> pa.RecordBatch:
        out = []
        for o, tell, text, spans in zip(*(batch.column(c).to_pylist() for c in ("o", "tell")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged = [(0, len(text))] if seen((o, tell), text) and len(text) >= LENGTH else _merged(spans)
            digest, at = hashlib.sha256(), 0
            for start, end in merged:
                digest.update(text[at:start])
                at = end
            digest.update(text[at:])
            out.append((None if o == NULL_ID else o, len(text), sum(e - s for s, e in merged), len(merged), digest.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return map_arrow(_with_spans(keyed), run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>", _Seen)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents without their removed bytes, as the same columns; n_chars, if there, counts anew.

    Bytes of a character that is cut apart go with it.  A document goes if only white space is left of more; what was
    null or blank before stays as it was.
    """
    names = documents.columns
    rest = F.struct(*(F.col(c) for c in names if c != "text"), F.col("text").isNull().alias("_null"))
    keyed = _keyed(documents, rest.alias("row"))

    def run(batch: pa.RecordBatch, seen) -> pa.RecordBatch:
        out, gone = [], []
        for o, tell, text, spans in zip(*(batch.column(c).to_pylist() for c in ("o", "tell")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged = [(0, len(text))] if seen((o, tell), text) and len(text) >= LENGTH else _merged(spans)
            parts, at = [], 0
            for start, end in merged:
                parts.append(text[at:start])
                at = end
            out.append(b"".join([*parts, text[at:]]).decode("utf-8", "ignore"))
            gone.append(bool(merged and text.strip()) and not out[-1].strip())
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(gone)], ["row", "left", "gone"])

    joined = _with_spans(keyed)
    kind = joined.schema["row"].dataType.simpleString()
    done = map_arrow(joined.select("o", "tell", "text", "spans", "row"), run, f"row {kind}, left string, gone boolean", _Seen).where(~F.col("gone"))
    text = F.when(~F.col("row._null"), F.col("left"))
    new = {"text": text} | ({"n_chars": F.coalesce(F.length("left").cast("bigint"), F.lit(0))} if "n_chars" in names else {})
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))
