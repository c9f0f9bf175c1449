"""CSV files read in byte ranges, also where quoted fields hold line ends.

A line of a range may lie inside a quoted field that an earlier range opened.  So each range is first read as a
function: from whether it starts inside quotes to whether it ends there, with the number of records either way.  A prefix
scan over a file's ranges then gives where each really starts and the number of its first record.  In the second read
each task assembles its records; only what is cut by the end of a range meets by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.tables import stored

#: Ranges whose starts may be broadcast, some tens of MB; beyond, lines are dealt by range and sorted instead.
RANGES = 200_000
#: Records of a block, within which long rows are listed.
BLOCK = 10_000
OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line.  A quote opens a field only at its start; within, two are one; one
    that neither a comma nor the line's end follows makes the rest of the field plain text."""
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at or at > n:
            return False


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines in the files' order within each range, with file and range."""
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").text(paths)
    return read.select(F.col("_metadata.file_path").alias("s3_key"), F.col("_metadata.file_block_start").alias("range"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each range's rows, as they come: (file, range, other columns of its first row, lines without carriage returns)."""
    now = None
    for batch in batches:
        keys, starts, values = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        names = keys.to_pylist()
        for i in range(len(values)):
            if now != (names[i], starts[i]):
                now = (names[i], starts[i])
                yield (*now, [c[i].as_py() for c in batch.columns[3:]])
            line = values[i]
            yield line[:-1] if line.endswith("\r") else line


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[list] = []
    for x in _runs(batches):
        if isinstance(x, tuple):
            done.append([x[0], x[1], False, True, 0, 0])
            continue
        last = done[-1]
        for side in (0, 1):  # begun outside, begun inside
            inside = last[2 + side]
            if not inside and x:
                last[4 + side] += 1
            if '"' in x:
                last[2 + side] = ends_inside(x, inside)
    columns = list(zip(*done, strict=True)) if done else [[]] * 6
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["s3_key", "range", "from_out", "from_in", "n_out", "n_in"])


def ranges(lines: DataFrame) -> DataFrame:
    """s3_key, range, inside (it starts within quotes), n, first (number of its first record), owner (the range whose record goes on)."""
    rows = lines.mapInArrow(_summaries, "s3_key string, `range` bigint, from_out boolean, from_in boolean, n_out bigint, n_in bigint")
    before = W.partitionBy("s3_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("swaps", swaps)
    known = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("end"), "swaps")), ignorenulls=True).over(before)
    rows = rows.withColumn("known", known)
    inside = (F.coalesce(F.col("known.end"), F.lit(0)) + F.col("swaps") - F.coalesce(F.col("known.swaps"), F.lit(0))) % 2 == 1
    rows = rows.withColumn("inside", inside).withColumn("n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    owner = F.last(F.when(F.col("n") > 0, F.col("range")), ignorenulls=True).over(before)
    return rows.select("s3_key", "range", "inside", "n", first.alias("first"), owner.alias("owner"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, number, text, owner, range): owner is null for whole records; else the range whose record the piece is of."""
    out: list[tuple] = []
    open_lines: list[str] = []
    key = start = number = owner = None
    inside = False

    def closed(whole: bool) -> None:
        if open_lines:
            record = number is not None
            out.append((key, number, "\n".join(open_lines), None if whole and record else start if record else owner, start))

    def sent() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["s3_key", "number", "text", "owner", "range"])

    following = 0
    for x in _runs(batches):
        if isinstance(x, tuple):
            closed(not inside)
            open_lines = []
            key, start, (inside, following, owner) = x
            number = None
            continue
        if not inside:
            if not x:
                continue
            number, following = following, following + 1
        was = inside
        inside = ends_inside(x, inside) if '"' in x else inside
        open_lines.append(x)
        if not inside:
            closed(not was or number is not None)
            open_lines, number = [], None
            if len(out) >= 1000:
                yield sent()
                out = []
    closed(not inside)
    yield sent()


def records(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """s3_key, number (from 0 in each file, the header included) and text of each record; and how many each file has.

    Empty lines are no records.  A carriage return before a line end is no part of it.
    """
    lines = _lines(spark, paths)
    starts = stored(ranges(lines), "csv-ranges")
    if starts.count() <= RANGES:
        placed = lines.join(F.broadcast(starts), ["s3_key", "range"])
    else:
        placed = lines.withColumn("_place", F.monotonically_increasing_id()).join(starts, ["s3_key", "range"]).repartition("s3_key", "range").sortWithinPartitions("s3_key", "range", "_place")
    rows = placed.select("s3_key", "range", "value", "inside", "first", "owner").mapInArrow(_records, "s3_key string, number bigint, text string, owner bigint, `range` bigint")
    pieces = rows.where(F.col("owner").isNotNull()).groupBy("s3_key", "owner").agg(F.max("number").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "text"))), lambda p: p.text), "\n").alias("text"))
    whole = rows.where(F.col("owner").isNull()).select("s3_key", "number", "text").unionByName(pieces.select("s3_key", "number", "text"))
    return whole, starts.groupBy("s3_key").agg(F.max(F.col("first") + F.col("n")).alias("n"))


def parsed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Records by their columns, all strings; ``_long`` tells a record of more fields than columns."""
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "_corrupt"])
    out = rows.withColumn("_row", F.from_csv("text", ddl, OPTIONS))
    return out.select("s3_key", "number", *(F.col("_row").getField(n).alias(n) for n in names), (F.col("_row._corrupt").isNotNull() & F.col("_row").getField(names[-1]).isNotNull()).alias("_long"))


def numbered(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows that are not ``_long``, with row_index, their number among these in the file.

    Long rows are counted by blocks of BLOCK records; a prefix sum over a file's blocks and the long rows of the own
    block tell how many came before.  Without long rows, which one job finds out, numbers stay as they are.
    """
    block = F.floor(F.col("number") / BLOCK)
    long = stored(rows.where("_long").select("s3_key", "number", block.alias("_block")), "csv-long")
    kept = rows.where(~F.col("_long")).drop("_long")
    if long.isEmpty():
        return kept.withColumn("row_index", F.col("number").cast("int")).drop("number")
    found = long.groupBy("s3_key", "_block").agg(F.array_sort(F.collect_list("number")).alias("_these"))
    blocks = totals.select("s3_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / BLOCK))).alias("_block")).join(found, ["s3_key", "_block"], "left")
    before = F.coalesce(F.sum(F.size(F.coalesce("_these", F.array().cast("array<bigint>")))).over(W.partitionBy("s3_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_before", before)
    own = F.coalesce(F.size(F.filter("_these", lambda x: x < F.col("number"))), F.lit(0))
    placed = kept.withColumn("_block", block).join(blocks, ["s3_key", "_block"])
    return placed.withColumn("row_index", (F.col("number") - F.col("_before") - F.when(F.col("_these").isNull(), 0).otherwise(own)).cast("int")).drop("number", "_block", "_these", "_before")
