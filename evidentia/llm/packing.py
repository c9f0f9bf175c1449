"""Best-fit packing under conflicts: bins in residual order carry source and duplicate-cluster bitmaps."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.common import WORD_PATTERN, stored

#: Words in a bin.
CAPACITY = 2048
#: A group is packed by itself; groups hold about this many pieces that do not fill a bin, whatever the input's size.
GROUP_PIECES = 3000
#: Rows of an output batch.
OUT_ROWS = 8192
#: Documents of one source that a bin may hold; of one duplicate cluster it holds one.
PER_SOURCE = 4


def pack(items: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing of (size, key, source, cluster): for each item its bin, its place and its offset.

    Open bins stand in one list per room left.  A search starts at the tightest room that fits and goes on through
    rooms and bins until no bitmap conflicts.  A bin has ``per_source`` source bitmaps, of sources that it holds at
    least once, twice and so on; an item conflicts if its bit stands in the last, or its cluster's in the cluster
    bitmap.  Pieces of the same document have a cluster of their own each.
    """
    sources: dict = {}
    clusters: dict = {}
    full: list[int] = []  # per bin: sources that it takes no more
    held: list[list[int]] = []  # per bin: one source bitmap per number held
    marks: list[int] = []  # per bin: cluster bitmap
    load: list[int] = []
    number: list[int] = []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    out: list = [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1])):
        size, _, source, cluster = items[i]
        s = 1 << sources.setdefault(source, len(sources))
        c = 1 << clusters.setdefault(cluster, len(clusters))
        found = -1
        for at in range(bisect_left(rooms, size), len(rooms)):
            for b in by_room[rooms[at]]:
                if not (full[b] & s or marks[b] & c):
                    found = b
                    break
            if found >= 0:
                break
        if found < 0:
            found = len(load)
            load.append(0)
            number.append(0)
            marks.append(0)
            full.append(0)
            held.append([0] * per_source)
        else:
            room = capacity - load[found]
            by_room[room].remove(found)
            if not by_room[room]:
                del by_room[room]
                del rooms[bisect_left(rooms, room)]
        out[i] = (found, number[found], load[found])
        load[found] += size
        number[found] += 1
        marks[found] |= c
        for level in range(per_source):
            if not held[found][level] & s:
                held[found][level] |= s
                break
        full[found] = held[found][-1]
        room = capacity - load[found]
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            insort(by_room[room], found)
    return out


def duplicate_cluster(text: Column) -> Column:
    """Equal for texts of the same words, in lower case."""
    return F.xxhash64(F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1), " "))


def numbered_copies(sized: DataFrame) -> DataFrame:
    """With ``copy``: rows of one key are numbered from 0, in any order, as they are the same.

    Those of one key in one partition (the upper bits of ``place``) are numbered there, from the number of those in the
    partitions before; so not even a key that a third of all rows has meets in one task.
    """
    place = F.shiftright("place", 33)
    repeated = sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = sized.join(repeated, "key", "left_semi").select("key", "place", place.alias("part"))
    counts = some.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = stored(counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("before")), "copies")  # stored, so that the rows of a hot key can be split
    own = some.withColumn("own", F.row_number().over(W.partitionBy("key", "part").orderBy("place")) - 1)
    numbers = own.join(starts, ["key", "part"]).select("place", (F.col("before") + F.col("own")).alias("copy"))
    return sized.join(numbers, "place", "left").withColumn("copy", F.coalesce("copy", F.lit(0)).cast("bigint"))


def best_fit_pack(documents: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_pieces: int = GROUP_PIECES, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, size, source, cluster, bin_id, bin_slot, bin_offset, bin_capacity.

    A text of more than ``capacity`` words is cut into pieces of at most that many, so no word is lost.  A piece of
    ``capacity`` words is a bin by itself: only a text's last piece needs packing, so a group's state has one entry
    per document, however long texts are.  Null and empty texts have one piece of size 0, which fits any bin with
    room: it counts for no source and no cluster.  A null source is a source.  Repeated rows are packed each; they
    share a cluster, so never a bin.  ``cluster`` names a column to use in place of the texts' own words.  Groups are
    dealt by a hash of doc_id, text and, among rows that are the same in both, a number, so no group grows with such
    rows; each is sorted by size and hash, so reruns agree.  Only sizes and hashes are shuffled.
    """
    text = F.col("text").cast("string")
    mark = F.col(cluster).cast("bigint") if cluster else duplicate_cluster(text)
    sized = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), mark.alias("cluster"),
        F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint").alias("words"), F.xxhash64("doc_id", text).alias("key"),
    )
    sized = numbered_copies(stored(sized.withColumn("place", F.monotonically_increasing_id()), "pieces"))
    whole = F.when(F.col("words") % capacity == 0, F.greatest(F.lit(0), F.expr(f"words div {capacity}") - 1)).otherwise(F.expr(f"words div {capacity}"))
    rest = sized.withColumn("piece", whole.cast("int")).withColumn("size", F.col("words") - F.col("piece").cast("bigint") * capacity)
    groups = max(1, -(-sized.count() // group_pieces))
    rest = rest.withColumn("group", F.pmod(F.hash("key", "copy", F.lit(7)), F.lit(groups)).cast("bigint"))
    columns = ("doc_id", "piece", "size", "source", "cluster", "key", "group")
    dealt = rest.select(*columns).repartition(min(groups, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // 64))), "group").sortWithinPartitions("group", F.desc("size"), "key", "piece", "doc_id")
    names = ("doc_id", "piece", "size", "source", "cluster", "bin_id", "bin_slot", "bin_offset", "bin_capacity")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32())

    def flush(rows: list[tuple]):
        group = rows[0][6]
        items = [(r[2], (r[5], r[1]), r[3] if r[2] else (i,), r[4] if r[1] == 0 and r[2] else (r[5], r[1], i)) for i, r in enumerate(rows)]
        bins, out = 0, []
        for r, (b, slot, offset) in zip(rows, pack(items, capacity, per_source), strict=True):
            out.append((*r[:5], f"{group}-{b}", slot, offset, capacity))
            bins = max(bins, b + 1)
        for r in rows:  # the pieces that fill a bin, those of long texts in many batches
            for piece in range(r[1]):
                out.append((r[0], piece, capacity, r[3], r[4], f"{group}-{bins}", 0, 0, capacity))
                bins += 1
                if len(out) >= OUT_ROWS:
                    yield out
                    out = []
        yield out

    def batches_of(rows: list[tuple]):
        for out in flush(rows):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held and row[6] != held[0][6]:
                    yield from batches_of(held)
                    held = []
                held.append(row)
        if held:
            yield from batches_of(held)

    return dealt.mapInArrow(run, "doc_id bigint, piece int, size bigint, source string, cluster bigint, bin_id string, bin_slot int, bin_offset bigint, bin_capacity int")
