"""MinHash near-dedup: improved consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.common import bounded_batches, doc_text, forget, map_arrow, small_enough, stored
from evidentia.llm.components import components

#: Words in a shingle, the similarity that links two texts, bands, and samples in a band.  A pair of similarity 0.8
#: shares no band with probability (1 - 0.8 ** 4) ** 20 = 2e-5.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: A shingle that fewer than this share of documents hold weighs like one that this share holds.  So the shingles
#: whose document frequency matters number at most a text's mean shingles over RARE, however many documents there are.
RARE = 1e-3
#: A shingle's weight is 1 + ln(tf), times 1 to 1 + SPREAD by its inverse document frequency.  In a large group of near
#: copies, shared shingles are frequent and edits are rare.  At this spread, edits do not outweigh them so far that a
#: pair of plain similarity 0.8 would share no band: in a group of a third of all documents its weighted similarity is
#: 0.74, and it shares none with probability 7e-4.
SPREAD = 0.5
#: Shingles that are sampled at once, so that all arrays stay in a core's cache.
CHUNK = 16_384
#: Rows of a shingle in a tile, on each side; keys that may each hold more than this share of all rows.
BLOCK, HOT_KEYS = 2_048, 1_000
#: Parts in which tasks send their counts of slots.
SLOT_PARTS = 64

_M = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashed word shingles of many texts at once."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20_011))
        self.bytes = rng.integers(0, _M, 256, np.uint64, endpoint=True)
        self.places = rng.integers(0, _M, SHINGLE, np.uint64, endpoint=True) | np.uint64(1)
        self.fold = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
        self.base = 0x9E3779B97F4A7C15 | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def words(self, text: str | None) -> bytes:
        """The text's words in lower case, each with one space before it."""
        kept = (text or "").lower().encode("utf-8", "surrogatepass").translate(self.fold).split()
        return b" " + b" ".join(kept) if kept else b""

    def __call__(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of non-empty ``words``: distinct shingles, their number in the text, and where each text's begin."""
        joined = b"".join(rows) + b" "
        raw = np.frombuffer(joined, np.uint8)
        self._powers(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.bytes[raw] * self.up[: len(raw)])))
        gaps = np.flatnonzero(raw == 32)
        word = _mix((sums[gaps[1:]] - sums[gaps[:-1] + 1]) * self.down[gaps[:-1] + 1])
        ends = np.cumsum([len(r) for r in rows])
        first = np.searchsorted(gaps[:-1], np.concatenate(([0], ends[:-1])))
        count = np.diff(np.append(first, len(word)))
        full = np.zeros(len(word), np.uint64)
        n = len(word)
        for i in range(min(SHINGLE, n)):
            full[: n - i] += word[i:] * self.places[i]
        doc = np.repeat(np.arange(len(rows)), count)
        keep = np.arange(n) - first[doc] + SHINGLE <= count[doc]
        for d in np.flatnonzero(count < SHINGLE).tolist():
            keep[first[d]] = True
            full[first[d]] = sum(int(w) * int(p) for w, p in zip(word[first[d] : first[d] + count[d]], self.places, strict=False)) & _M
        shingle, doc = _mix(full[keep]), doc[keep]
        edges = np.searchsorted(doc, np.arange(len(rows) + 1)).tolist()
        for a, b in zip(edges, edges[1:], strict=False):  # text by text: a sort of values alone, with no second key
            shingle[a:b].sort()
        new = np.ones(len(doc), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return shingle[at], np.diff(np.append(at, len(doc))), np.searchsorted(doc[at], np.arange(len(rows)))


class Weights:
    """Log weights of shingles from their number in the text and their document frequency.

    ``shingles``, in order, are those that at least RARE of the documents hold; ``factors`` their log factors.  Only
    slots that are ``hot`` hold such shingles.  ``levels`` grow with the number of shingles in a slot.
    """

    def __init__(self, documents: int, shingles: np.ndarray, frequencies: np.ndarray, slots: np.ndarray) -> None:
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.factors = self._factor(frequencies[order].astype(np.float64) / max(1, documents))
        self.most = float(self._factor(np.zeros(1))[0])
        self.shift = np.uint64(64 - (len(slots).bit_length() - 1))
        self.hot = slots >= RARE * documents
        self.levels = np.minimum(255, 8 * np.log2(1.0 + slots)).astype(np.uint8)

    @staticmethod
    def _factor(share: np.ndarray) -> np.ndarray:
        return np.log1p(SPREAD * np.log(np.clip(share, RARE, 1)) / math.log(RARE)).astype(np.float32)

    def __call__(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        out = np.log1p(np.log(tf)).astype(np.float32) + np.float32(self.most)
        if len(self.shingles):
            maybe = np.flatnonzero(self.hot[(shingle >> self.shift).astype(np.intp)])
            at = np.minimum(np.searchsorted(self.shingles, shingle[maybe]), len(self.shingles) - 1)
            found = self.shingles[at] == shingle[maybe]
            out[maybe[found]] += self.factors[at[found]] - np.float32(self.most)
        return out


class Sampler:
    """Improved consistent weighted sampling.  For each sample, a shingle's r and c follow Gamma(2, 1), beta is uniform.

    The draws come from bits of the shingle's hash, through tables of the distribution's quantiles.  A text's sample
    is its least ln a; equal shingles of equal quantized weight give equal values, so the value names the sample.
    """

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(40_009))
        self.factors = rng.integers(0, _M, BANDS * ROWS, np.uint64, endpoint=True) | np.uint64(1)
        u = (np.arange(65_536) + 0.5) / 65_536
        x = np.full(65_536, 1.5)
        for _ in range(60):  # Newton's steps to the quantiles of Gamma(2, 1), whose CDF is 1 - (1 + x) exp(-x)
            x = np.clip(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4, x * 4 + 1e-9)
        self.r, self.log_c = x.astype(np.float32), np.log(x).astype(np.float32)
        self.bands = rng.integers(0, _M, ROWS, np.uint64, endpoint=True) | np.uint64(1)

    def __call__(self, shingle: np.ndarray, log_weight: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Band hashes, one row per text."""
        out = np.full((len(self.factors), len(start)), np.inf, np.float32)
        text = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(shingle))))
        size = min(CHUNK, len(shingle))
        draw, place = np.empty(size, np.uint64), np.empty(size, np.uint64)
        room = np.empty((3, size), np.float32)
        low, mask = np.uint64(32), np.uint64(0xFFFF)
        for a in range(0, len(shingle), CHUNK):
            h, lw, own = shingle[a : a + CHUNK], log_weight[a : a + CHUNK], text[a : a + CHUNK]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            named = own[at]
            u, i, (beta, r, t) = draw[: len(h)], place[: len(h)], room[:, : len(h)]
            index = i.view(np.intp)  # of 16 bits, so never negative
            for k, factor in enumerate(self.factors):
                np.multiply(h, factor, out=u)
                np.right_shift(u, np.uint64(48), out=i)
                np.take(self.r, index, out=r, mode="clip")
                np.right_shift(u, np.uint64(16), out=i)
                i &= mask
                np.multiply(i, np.float32(1 / 65_536), out=beta, dtype=np.float32, casting="unsafe")
                np.divide(lw, r, out=t)
                t += beta
                np.floor(t, out=t)
                t -= beta
                t += np.float32(1)
                t *= r  # r (floor(ln weight / r + beta) - beta + 1)
                np.right_shift(u, low, out=i)
                i &= mask
                np.take(self.log_c, index, out=r, mode="clip")
                r -= t
                out[k, named] = np.minimum(out[k, named], np.minimum.reduceat(r, at))
        bits = out.view(np.uint32).astype(np.uint64).reshape(BANDS, ROWS, -1)
        bands = _mix((bits * self.bands[None, :, None]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95))
        return bands.T.view(np.int64)


def _blocks(rows: list[bytes], most: int = 1 << 19):
    held, size = [], 0
    for i, row in enumerate(rows):
        if row:
            held.append(i)
            size += len(row)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _slot_counts(documents: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many distinct shingles of documents fall into each of 2 ** bits slots, and the number of documents with words.

    Each task counts in one fixed array and sends it in SLOT_PARTS parts.  A part of all tasks is added up by itself,
    so no task reads whole arrays, however many tasks there are, and the driver gets each part once.
    """
    names, size = ["part", "n", "counts"], 1 << bits
    shift, width = np.uint64(64 - bits), (1 << bits) // SLOT_PARTS

    def count(batches):
        shingler, total, n = Shingler(), np.zeros(size, np.int64), 0
        for batch in batches:
            rows = [shingler.words(t) for t in batch.column(0).to_pylist()]
            for block in _blocks(rows):
                n += len(block)
                np.add.at(total, (shingler([rows[i] for i in block])[0] >> shift).astype(np.intp), 1)
        if n:
            packed = [zlib.compress(total[i * width : (i + 1) * width].astype("<i4").tobytes(), 1) for i in range(SLOT_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int32()), pa.array([n] * SLOT_PARTS, pa.int64()), pa.array(packed, pa.binary())], names)

    def add(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for part, n, packed in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                held = totals.setdefault(part, [0, np.zeros(width, np.int64)])
                held[0] += n
                held[1] += np.frombuffer(zlib.decompress(packed), "<i4")
        if totals:
            packed = [zlib.compress(x.tobytes(), 1) for _, x in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array(packed, pa.binary())], names)

    shape = "part int, n bigint, counts binary"
    rows = sorted(documents.select("text").mapInArrow(count, shape).repartition(SLOT_PARTS, "part").mapInArrow(add, shape).collect())
    if not rows:
        return np.zeros(size, np.int64), 0
    return np.concatenate([np.frombuffer(zlib.decompress(r.counts), "<i8") for r in rows]), rows[0].n


def document_frequencies(documents: DataFrame) -> Weights:
    """The weights, from exact document frequencies of all shingles that at least RARE of all documents hold.

    A first pass counts shingles by slot: only slots with that many can hold such a shingle.  A second one counts the
    shingles of those slots, each by itself, added up in the tasks before they are shuffled.  The slots' number
    follows the texts' mean length, so that a slot holds about a quarter of RARE by chance, and changes only how many
    shingles the second pass counts in vain.  The driver gets at most mean shingles / RARE rows of 16 bytes.
    """
    mean = documents.select(F.avg(F.length("text"))).first()[0] or 0
    bits = min(24, max(12, math.ceil(math.log2(1 + 4 * mean / 6 / RARE))))
    slots, n = _slot_counts(documents, bits)
    least = RARE * n
    hot = slots >= least
    if not n or not hot.any():
        return Weights(n, np.empty(0, np.uint64), np.empty(0, np.int64), slots)
    sent = documents.sparkSession.sparkContext.broadcast(np.packbits(hot))
    shift = np.uint64(64 - bits)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        names, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return names, np.bincount(place, np.concatenate([c for _, c in held]), len(names)).astype(np.int64)

    def count(batches):
        shingler, marks, held, size = Shingler(), np.unpackbits(sent.value).astype(bool), [], 0
        for batch in batches:
            rows = [shingler.words(t) for t in batch.column(0).to_pylist()]
            for block in _blocks(rows):
                shingle = shingler([rows[i] for i in block])[0]
                own = shingle[marks[(shingle >> shift).astype(np.intp)]]
                held.append((own, np.ones(len(own), np.int64)))
                size += len(own)
                if size > 1 << 20:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1 << 19:  # a task gives up what it has rather than hold more
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in held[0]], ["h", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in merged(held)], ["h", "n"])

    counted = documents.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counted.toArrow()
    return Weights(n, got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy(), slots)


def sign(documents: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, key (a digest of the words; null if there are none) and bands of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        shingler, sampler, weights, seen = state
        rows = [shingler.words(t) for t in batch.column("text").to_pylist()]
        keys = [hashlib.blake2b(r, digest_size=16).digest() if r else None for r in rows]
        bands: dict[bytes, np.ndarray] = {}
        todo = []
        for row, key in zip(rows, keys, strict=True):
            if key in seen:
                bands[key] = seen[key]
            elif key is not None and key not in bands:
                bands[key] = None
                todo.append((row, key))
        for block in _blocks([r for r, _ in todo]):
            shingle, tf, start = shingler([todo[i][0] for i in block])
            for i, own in zip(block, sampler(shingle, weights(shingle, tf), start), strict=True):
                bands[todo[i][1]] = own
        if len(seen) > 20_000:
            seen.clear()
        seen.update(bands)
        empty = np.empty(0, np.int64)
        own = [bands[k] if k else empty for k in keys]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), listed], ["doc_id", "key", "bands"])

    return map_arrow(documents, run, "doc_id bigint, key binary, bands array<bigint>", lambda: (Shingler(), Sampler(), sent.value, {}))


def _texts(documents: DataFrame) -> DataFrame:
    """(key, words) of each text with words.  A task gives a text once, and a later step drops what other tasks repeat."""

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        shingler, seen = state
        keys, rows = [], []
        for text in batch.column("text").to_pylist():
            row = shingler.words(text)
            key = hashlib.blake2b(row, digest_size=16).digest()
            if row and key not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                rows.append(row)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["key", "words"])

    return map_arrow(documents.select("text"), run, "key binary, words binary", lambda: (Shingler(), set()))


def similar(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts' weighted Jaccard similarity is at least ``similarity``, or that without weights is."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)
    one = pairs.join(texts.select(F.col("key").alias("u"), F.col("words").alias("u_words")), "u")
    two = one.join(texts.select(F.col("key").alias("v"), F.col("words").alias("v_words")), "v")

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        shingler, weights, kept = state
        columns = [batch.column(c).to_pylist() for c in ("u", "v", "u_words", "v_words")]
        todo = {k: w for keys, words in ((columns[0], columns[2]), (columns[1], columns[3])) for k, w in zip(keys, words, strict=True) if k not in kept}
        if len(kept) > 2000:
            old, own = dict(kept), {*columns[0], *columns[1]}
            kept.clear()
            kept.update((k, old[k]) for k in own if k in old)
        keys = list(todo)
        for block in _blocks([todo[k] for k in keys]):
            shingle, tf, start = shingler([todo[keys[i]] for i in block])
            weight = np.exp(weights(shingle, tf).astype(np.float64))
            for i, a, b in zip(block, start, np.append(start[1:], len(shingle)), strict=True):
                kept[keys[i]] = (shingle[a:b], weight[a:b], weight[a:b].sum())
        good = []
        for u, v in zip(columns[0], columns[1], strict=True):
            (hu, wu, nu), (hv, wv, nv) = kept[u], kept[v]
            at = np.minimum(np.searchsorted(hv, hu), len(hv) - 1)
            same = hv[at] == hu
            both, count = np.where(same, np.minimum(wu, wv[at]), 0).sum(), same.sum()
            good.append(bool(both >= (similarity - 1e-9) * (nu + nv - both) or count >= (similarity - 1e-9) * (len(hu) + len(hv) - count)))
        return batch.select(["u", "v"]).filter(pa.array(good))

    return map_arrow(two.select("u", "v", "u_words", "v_words"), run, "u binary, v binary", lambda: (Shingler(), sent.value, {}))


def prefixes(texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """plain, rare, key, c, total and after, for each text's rarest shingles: once by weights, once (``plain``) by number.

    Shingles stand in one order for all texts, rare ones first.  All that two texts share comes from their first common
    shingle on, so similar texts have it where at least ``similarity`` of either's total still follows: ``after``,
    with the shingle itself.  What stands later is left out.  Shingles go by 32 bits of their hash.
    """
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch, state):
        shingler, weights = state
        keys, parts, rows = (batch.column(c).to_pylist() for c in ("key", "c", "words"))
        for block in _blocks(rows, 1 << 17):
            shingle, tf, start = shingler([rows[i] for i in block])
            factor = weights(shingle, np.ones(len(shingle)))
            owner = np.repeat(np.arange(len(block)), np.diff(np.append(start, len(shingle))))
            order = np.lexsort((shingle, weights.levels[(shingle >> weights.shift).astype(np.intp)], -factor, owner))
            rare = (shingle[order] >> np.uint64(8)).astype(np.uint32).view(np.int32)
            for plain in (False, True):
                weight = np.ones(len(shingle)) if plain else np.exp(weights(shingle, tf).astype(np.float64))[order]
                total = np.bincount(owner, weight, len(block))
                upto = np.cumsum(weight) - weight
                after = total[owner] - (upto - upto[start][owner])
                keep = after >= (similarity - 1e-6) * total[owner]
                own = owner[keep]
                columns = [pa.array(np.full(len(own), plain)), pa.array(rare[keep]), *(pa.array([x[i] for i in block], pa.binary()).take(pa.array(own)) for x in (keys, parts)), pa.array(total[own]), pa.array(after[keep] * (1 + 1e-9))]
                yield pa.RecordBatch.from_arrays(columns, ["plain", "rare", "key", "c", "total", "after"])

    return map_arrow(texts.select("key", "c", "words"), run, "plain boolean, rare int, key binary, c binary, total double, after double", lambda: (Shingler(), sent.value))


def _meet(rows: list[tuple], similarity: float) -> tuple[list[bytes], list[bytes]]:
    """Pairs of a tile's heads and members (key, c, total, after, apart, head) of different components that may be similar."""
    heads, members = [r for r in rows if r[5]], [r for r in rows if not r[5]]
    if not heads or not members:
        return [], []
    numbers: dict = {}
    part = np.array([numbers.setdefault(r[1], len(numbers)) for r in members])
    total, after, apart = (np.array([r[i] for r in members]) for i in (2, 3, 4))
    u, v = [], []
    for key, c, own, left, _, _ in heads:
        both = np.minimum(after, left)
        ok = (part != numbers.get(c, -1)) & (np.minimum(total, own) >= (similarity - 1e-6) * np.maximum(total, own)) & (both >= (similarity - 1e-6) * (total + own - both))
        for j in np.flatnonzero(ok).tolist():
            if not apart[j] or key < members[j][0]:
                u.append(key)
                v.append(members[j][0])
    return u, v


def dealt_prefixes(rows: DataFrame) -> DataFrame:
    """Rows of ``prefixes`` by tiles (plain, rare, i, j), each of at most about BLOCK heads and BLOCK members.

    A head is a row outside the largest component of its shingle; shingles of one component alone go.  A shingle's
    members go to as many tiles as hold heads, so with few heads the rows are as many as members, not more.
    """
    per = rows.groupBy("plain", "rare", "c").agg(F.count("*").alias("n")).groupBy("plain", "rare").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    per = per.select("plain", "rare", F.col("main.c").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("km"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("kh"))
    sized = rows.join(per, ["plain", "rare"]).withColumn("apart", F.col("c") != F.col("main"))
    slot = lambda k: F.pmod(F.xxhash64("key"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    heads = sized.where("apart").withColumn("head", F.lit(True)).withColumn("i", slot("kh")).withColumn("j", every("km"))
    members = sized.withColumn("head", F.lit(False)).withColumn("j", slot("km")).withColumn("i", every("kh"))
    return heads.unionByName(members).select("plain", "rare", "i", "j", "key", "c", "total", "after", "apart", "head")


def may_be_similar(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, h) pairs of different components that by an exact bound may be similar: they share a shingle of their
    prefixes, after which enough of both follows."""
    dealt = dealt_prefixes(rows)
    names = ("key", "c", "total", "after", "apart", "head")

    def run(batches):
        held, group = [], None
        for batch in batches:
            keys = zip(*(batch.column(x).to_pylist() for x in ("plain", "rare", "i", "j")), strict=True)
            own = zip(*(batch.column(x).to_pylist() for x in names), strict=True)
            u, v = [], []
            for key, row in zip(keys, own, strict=True):
                if key != group:
                    for out, found in zip((u, v), _meet(held, similarity), strict=True):
                        out += found
                    held, group = [], key
                held.append(row)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["key", "h"])
        u, v = _meet(held, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["key", "h"])

    bounded_batches(rows.sparkSession)
    return dealt.repartition("plain", "rare", "i", "j").sortWithinPartitions("plain", "rare", "i", "j").mapInArrow(run, "key binary, h binary")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key and c, its component, of all nodes in buckets (band, key) with several components."""
    own = members.select("band", "key").join(labels.select(F.col("u").alias("key"), F.col("v").alias("c")), "key", "left").withColumn("c", F.coalesce("c", "key"))
    several = own.groupBy("band").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    return own.join(several.select("band"), "band", "left_semi").select("key", "c").distinct()


def _by_key(rows: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Left join of two stored tables on a key of which ``found`` has each once.

    Keys of more than 1 / HOT_KEYS of the rows, at most HOT_KEYS of them, are joined by broadcast, so the rows of a hot
    key stay in their own tasks.
    """
    least = rows.count() / HOT_KEYS
    hot = rows.groupBy(on).agg(F.count("*").alias("_n")).where((F.col("_n") > least) & F.col(on).isNotNull()).select(on)
    hot = stored(hot, "hot")
    named = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    rows = rows.join(named, on, "left")
    few = rows.where("_hot").drop("_hot").join(F.broadcast(found.join(F.broadcast(hot), on, "left_semi")), on, "left")
    return few.unionByName(rows.where(F.col("_hot").isNull()).drop("_hot").join(found, on, "left"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and kept for each document.

    Documents are in one class if a chain of pairs links them, each of the same words or of weighted Jaccard
    similarity ``similarity`` or more; or of as much without weights, so that weights lose no link of that kind.  class_id is the least doc_id of the class; this document is kept (of repeated
    rows with this doc_id, one).  A text without words (null, empty, signs only) is a class of its own, kept.  Texts
    of one to four words have one shingle of all words.  A class without any doc_id has a null class_id, and its rows
    are kept.

    Texts of the same words are one node.  In each band's bucket the node that shares most buckets with others, so
    likely the original, is tested against all.  Where a bucket holds several components even then, its nodes are
    joined on their rarest shingles, and pairs of different components are tested if an exact bound on what the two
    can share allows it.  So every pair of different components that shares a bucket is tested or bounded, and no
    bucket gives all its pairs.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    documents = doc_text(documents)
    weights = document_frequencies(documents)
    signed = keep(sign(documents, weights), "signed")
    nodes = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.any_value("bands").alias("bands"))
    member = keep(nodes.select("key", F.posexplode("bands").alias("b", "band")), "bands")
    buckets = member.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = keep(member.join(buckets, "band"), "met")
    degrees = shared.groupBy("key").agg(F.sum("n").alias("degree"))
    shared = keep(shared.join(degrees, "key").select("band", "key", "b", "degree"), "shared")
    leads = shared.groupBy("band").agg(F.max(F.struct("degree", "key"))["key"].alias("lead"))
    led = shared.join(leads, "band").where(F.col("key") != F.col("lead"))
    tested = keep(led.select(F.least("key", "lead").alias("u"), F.greatest("key", "lead").alias("v")).distinct(), "pairs")
    texts = keep(_texts(documents).join(degrees.select("key"), "key", "left_semi").groupBy("key").agg(F.any_value("words").alias("words")), "texts")
    links = keep(similar(tested, texts, weights, similarity), "links")

    def test(pairs: DataFrame) -> None:
        nonlocal tested, links
        new = keep(pairs.select(F.least("key", "h").alias("u"), F.greatest("key", "h").alias("v")).distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
        links = keep(links.unionByName(similar(new, texts, weights, similarity)), "links")
        tested = tested.unionByName(new)

    labels = components(links)
    rest = keep(_unsettled(shared, labels), "rest")
    if not small_enough(rest, 0):
        test(may_be_similar(keep(prefixes(texts.join(rest, "key"), weights, similarity), "prefixes"), similarity))
        labels = components(links)
    rows = keep(_by_key(signed.select("doc_id", "key"), labels.select(F.col("u").alias("key"), F.col("v").alias("c")), "key").select("doc_id", F.coalesce("c", "key").alias("c")), "classes")
    least = stored(rows.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("least")), "least")
    rows = stored(_by_key(rows, least, "c").select("doc_id", "c", "least"), "members")
    for table in made:
        forget(table)
    out = rows.select("doc_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.col("c").isNull().alias("alone"))
    heads = out.where((F.col("doc_id") == F.col("class_id")) & ~F.col("alone")).withColumn("n", F.row_number().over(W.partitionBy("class_id").orderBy("doc_id")))
    heads = heads.select("doc_id", "class_id", (F.col("n") == 1).alias("kept"))
    others = out.where(~F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)) | F.col("alone")).select("doc_id", "class_id", (F.col("alone") | F.col("class_id").isNull()).alias("kept"))
    return heads.unionByName(others)


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each class.  Documents with a null doc_id, which no verdict can name, stay."""
    classes = stored(near_duplicates(documents), "near")
    gone = classes.where(~F.col("kept") & (F.col("doc_id") != F.col("class_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    left = documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
    again = classes.where(~F.col("kept") & (F.col("doc_id") == F.col("class_id"))).select(F.col("doc_id").alias("_again")).distinct()
    if small_enough(again, 0):
        return left
    same = left["doc_id"] == again["_again"]
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
