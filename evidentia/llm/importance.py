"""Importance resampling towards a target distribution, by hashed word features and Gumbel noise."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, stored

#: Buckets of features; the table of their gains, 8 bytes a bucket, goes to every task.
BUCKETS = 10_000
#: Words in the longest run that is a feature.
LONGEST_RUN = 1
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Documents drawn of every hundred that have enough words.
PERCENT = 10
#: Enters the noise of each document.
SEED = 2024
#: Bytes that are scanned at once; a batch of longer texts is cut between words.
BLOCK = 1 << 22
#: Words still open after so many steps are ended one by one, by the library's CRC over the bytes that are left.
STEPS = 40

_BYTES = np.arange(256)
#: Bytes of words: digits, letters, and all of characters beyond ASCII.
IN_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = (_BYTES + 32 * ((_BYTES >= 0x41) & (_BYTES <= 0x5A))).astype(np.uint8)


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 of the polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table.astype(np.uint32)


CRC = _crc_table()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC register after ``lengths[i]`` bytes of ``data`` from ``starts[i]``, for all i in step."""
    order = np.argsort(-np.minimum(lengths, STEPS + 1).astype(np.int16), kind="stable")
    now, at, most = state[order], starts[order], lengths[order]
    # words are sorted by length, so those still open are always the first ones
    open_at = np.searchsorted(-np.minimum(most, STEPS + 1), -np.arange(STEPS + 1), side="left")
    for k in range(STEPS):
        n = open_at[k]
        if not n:
            break
        now[:n] = CRC[(now[:n] ^ data[at[:n] + k]) & 0xFF] ^ (now[:n] >> np.uint32(8))
    for i in range(open_at[STEPS]):
        rest = data[at[i] + STEPS : at[i] + most[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each word of ``data``; text i lies in offsets[i] to offsets[i + 1].

    Words begin and end where the class of bytes changes, and at the borders of texts.
    """
    inside = IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK bytes, none of which ends inside a word."""
    at = 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data) and IN_WORD[data[stop]]:
            gaps = np.flatnonzero(~IN_WORD[data[at:stop]])
            if gaps.size:
                stop = at + int(gaps[-1]) + 1
            while stop < len(data) and IN_WORD[data[stop]] and IN_WORD[data[stop - 1]]:  # a word longer than a block
                more = np.flatnonzero(~IN_WORD[data[stop : stop + BLOCK]])
                stop = stop + int(more[0]) if more.size else min(stop + BLOCK, len(data))
        yield at, stop
        at = stop


def features(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks: the bucket of each feature, its text's number, and the number of words in each text so far seen."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    cuts = list(_blocks(data)) if longest == 1 else [(0, len(data))]  # runs of words may not be cut
    for low, high in cuts:
        part = LOWER[data[low:high]]
        starts, lengths, text = words_of(part, np.clip(offsets - low, 0, len(part)))
        if not len(starts):
            continue
        whose = np.searchsorted(offsets, starts + low, side="right") - 1
        count = np.bincount(whose, minlength=len(texts))
        state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), part, starts, lengths)
        found, owner = [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)], [whose]
        first = np.arange(len(starts))
        for k in range(1, longest):
            keep = first + k < len(starts)
            keep[keep] = whose[first[keep] + k] == whose[first[keep]]
            first, state = first[keep], state[keep]
            state = CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
            state = advance(state, part, starts[first + k], lengths[first + k])
            found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
            owner.append(whose[first])
        yield np.concatenate(found), np.concatenate(owner), count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): how often a feature of any text falls into each bucket.  Each task sends its sums only."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _, _ in features(batch.column(0), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Of each bucket: the floor of 1000 times the log of its share in ``target`` over that in ``source``, each plus one."""

    def counts(df: DataFrame) -> list[int]:
        found = {r.bucket: r.n for r in bucket_counts(df, buckets, longest).collect()}  # a row a bucket at most
        return [found.get(b, 0) for b in range(buckets)]

    s, t = counts(source), counts(target)
    s_all, t_all = sum(s), sum(t)
    ratio = lambda a, b: (float(b + 1) * float(s_all + buckets)) / (float(a + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(s, t, strict=True)], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; the weight is the floored mean of its features' gains, or 0."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            words, count, total = (np.zeros(n, np.int64) for _ in range(3))
            for found, owner, seen in features(batch.column(1), len(gain), longest):
                words += seen
                count += np.bincount(owner, minlength=n)
                total += np.bincount(owner, weights=gain[found], minlength=n).astype(np.int64)  # sums below 2^53 are exact
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, from the digest of seed and id; rows without an id share one draw."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, score: str, ties: list[str], percent: int) -> DataFrame:
    """Rows with ``rank`` 1, 2, ... by falling ``score``, then by ``ties`` (nulls last), for the first ``percent`` of them.

    A range sort deals rows out evenly, equal ones too; the position within a partition and the rows before it
    make the rank.  What is summed over all is one number a partition.
    """
    spark = rows.sparkSession
    order = [F.col(score).desc(), *(F.col(c).asc_nulls_last() for c in ties), F.col("_spread")]
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = spread.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    laid = stored(laid, "ranked")
    sizes = sorted((r._part, r.n) for r in laid.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    before, total = [], 0
    for part, size in sizes:
        before.append((part, total))
        total += size
    starts = F.broadcast(spark.createDataFrame(before, "_part int, _before bigint"))
    rank = F.col("_before") + F.col("_at") + 1
    most = total * percent // 100
    return laid.join(starts, "_part").withColumn("rank", F.when(rank <= most, rank)).drop("_part", "_before", "_at", "_spread")


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``documents``.

    Features are runs of 1 to ``longest`` words of whole texts, hashed to buckets; a bucket's gain compares its share in
    ``target`` with that in ``documents``.  Of the rows with ``least_words`` words, the best ``percent`` by weight plus noise
    are drawn, which samples without replacement in proportion to exp(weight / 1000); the others' rank is null.

    A null text has no features; its weight is 0.  Ties go to smaller doc_ids, null ones last, then to fewer features.
    Repeated rows are each a row.  Of an empty target, all gains stem from ``documents`` alone.  Only doc_id and text are
    read, so other columns of any name do not matter.
    """
    gain = gains(documents, target, buckets, longest)
    rows = stored(weighted(documents, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighted")
    enough = F.col("n_words") >= least_words
    drawn = ranked(rows.where(enough), "score", ["doc_id", "n_features"], percent)
    return drawn.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))
