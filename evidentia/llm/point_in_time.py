"""Point-in-time features of sales, by merge-sort trees over each client's events.

Clicks, sales and lines of all clients are laid in one order, by client and event time, by a range sort that cuts even
one client's events into many partitions.  Each sale adds edges to that order: where its windows begin, its own time t,
and the end of its label.  Between two edges lies a window, so a feature is a sum over a range of positions of the
events with ``avail <= t``.  UNIT consecutive rows are a unit.  A unit holds a merge-sort tree over its positions:
dyadic blocks, sorted by availability, with prefix sums and the prefix maximum of clicks.  Whole units between two
edges form dyadic blocks of units in turn; those are sorted by availability on the cluster, and the probes of a block
are merged into that order, which is their binary search.  Nothing that grows with the input meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import stored

#: Days of the windows of features.
WINDOWS = (2, 14)
#: Days after t in which a sale makes the label true.
LABEL_DAYS = 7
#: Minutes from arrival until a row can be seen.
DELAY_MINUTES = 240
#: A sale's t lies up to so many seconds, by a CRC of its id, after the sale.
JITTER_SECONDS = 259_200
#: Rows of a unit: what one tree in a task's memory holds, some tens of MB.  Twice the range of 16 bits at most.
UNIT = 131_072

DAY = 86_400_000_000
#: Availability of what is never seen.
NEVER = 1 << 62
#: Stands for a null id, below all others.
NO_ID = -(1 << 63)
CLICK, SALES, POINT, AT, AHEAD, BEHIND = 0, 1, 2, 3, 4, 5  # kinds of rows; from BEHIND on: the lower edges by window
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents")


def micros(spark: SparkSession, column: str, df: DataFrame) -> Column:
    """Epoch microseconds of a timestamp; one without a zone is UTC, whatever the session's zone."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz" and spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        gap = F.col(column) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.try_multiply(gap.cast("interval second").cast("decimal(20,6)"), F.lit(1_000_000)).cast("bigint")
    return F.unix_micros(F.col(column).cast("timestamp"))


def cents(column: str) -> Column:
    """floor(100 x + 0.5); 0 where x is null or not finite."""
    x = F.col(column).cast("double")
    return F.when(F.abs(x) < 9e16, F.floor(x * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint")


def _pieces(lines: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(client, at, avail, w, n): what makes distinct items a sum.

    A line of item i is seen at t in window d if t lies in [a, e + d), where e is its sale's time and a its
    availability.  Items count once, so the intervals of a client's item are merged.  First, in the cluster's map tasks,
    those of one dyadic stretch of e that all reach over the stretch's end plus d, which makes them one interval; so a
    client's item keeps few pieces, however many lines it has.  A window over the pieces cuts off what an earlier
    one covers.  A piece that is no continuation is a row of the tree, at e with availability a; others are a pair of
    points that the window's lower edge t - d counts: 1 from start - d on, -1 from e on.
    """
    ends = [d * DAY for d in windows]
    first = F.coalesce(*(F.when(F.col("a") < F.col("e") + F.lit(d), F.lit(w)) for w, d in enumerate(ends)))
    gap = F.element_at(F.array(*(F.lit(d) for d in ends)), F.col("first") + 1)
    floor = lambda k: F.shiftleft(F.shiftright(F.col("e"), k), k)
    level = F.coalesce(*(F.when(F.col("a") < floor(k) + gap, F.lit(k)) for k in (36, 30, 24, 18, 12, 6)), F.lit(0))
    rows = lines.where(F.col("item").isNotNull()).select("client", "item", "e", F.greatest("a", "e").alias("a")).withColumn("first", first).where(F.col("first").isNotNull()).withColumn("level", level)
    stretch = F.coalesce(*(F.when(F.col("level") == k, floor(k)) for k in (36, 30, 24, 18, 12, 6)), F.col("e"))
    merged = rows.groupBy("client", "item", "first", "level", stretch.alias("stretch")).agg(F.min("a").alias("a"), F.max("e").alias("e"))
    earlier = Window.partitionBy("client", "item").orderBy("a", "e", "first", "level", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    out = merged.select("client", "item", "a", "e", "first", *(F.max(F.when(F.col("first") <= w, F.col("e"))).over(earlier).alias(f"p{w}") for w in range(len(ends))))
    row = lambda at, avail, w, n: F.struct(at.cast("bigint").alias("at"), avail.cast("bigint").alias("avail"), F.lit(w).alias("w"), F.lit(n).alias("n"))
    found = []
    for w, d in enumerate(ends):
        prev, seen = F.col(f"p{w}"), F.col("first") <= w
        adds = seen & (prev.isNull() | (F.col("e") > prev))
        plain = adds & (prev.isNull() | (F.col("a") > prev + d)) & (F.col("a") >= F.col("e"))
        start = F.greatest(F.col("a") - d, prev)
        found += [F.when(plain, row(F.col("e"), F.col("a"), w, 1)), F.when(adds & ~plain, row(start, F.lit(NEVER), w, 1)), F.when(adds & ~plain, row(F.col("e"), F.lit(NEVER), w, -1))]
    return out.select("client", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("client", "x.*")


def laid_rows(spark: SparkSession, sales: DataFrame, clicks: DataFrame, lines: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Events, points and edges with the columns of the common order."""
    k = len(windows)
    items = [f"i{w}" for w in range(k)]
    numbers = ["n", "c", "n2", "c2", *items]
    columns = ["client", "at", "edge", "kind", "id", "avail", *numbers]

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        zero = {"edge": F.lit(0), "id": F.lit(NO_ID), **{c: F.lit(0) for c in numbers}} | given
        types = {"edge": "int", "kind": "int"}
        return df.select(*((zero[c] if c in zero else F.col(c)).cast(types.get(c, "bigint")).alias(c) for c in columns))

    delay = DELAY_MINUTES * 60_000_000
    sold = sales.select(F.col("sale_id").cast("bigint").alias("sale_id"), F.col("client_id").cast("bigint").alias("client"), micros(spark, "sold_at", sales).alias("e"), (micros(spark, "arrived_at", sales) + delay).alias("seen"), cents("total").alias("cents")).where(F.col("client").isNotNull() & F.col("e").isNotNull())
    clicked = clicks.where(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("arrived_at").isNotNull())
    names = [c for c in ("click_id", "ts", "arrived_at", "client_id", "kind", "value") if c in clicks.columns]
    rest = [F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in clicks.columns if c not in names)), {"ignoreNullFields": "false"}).cast("binary")).alias("_rest")] if len(clicks.columns) > len(names) else []
    clicked = clicked.select(*names, *rest).dropDuplicates()
    events = rows(clicked, client=F.col("client_id"), at=micros(spark, "ts", clicks), kind=F.lit(CLICK), id=F.coalesce(F.col("click_id"), F.lit(NO_ID)), avail=micros(spark, "arrived_at", clicks) + delay, n=F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("int"), c=cents("value"))

    shipped = lines.select(F.col("sale_id").cast("bigint").alias("sale_id"), F.col("item_id").cast("bigint").alias("item"), micros(spark, "shipped_at", lines).alias("shipped"), cents("amount").alias("cents")).where(F.col("sale_id").isNotNull() & F.col("shipped").isNotNull())
    known = sold.where(F.col("sale_id").isNotNull() & F.col("seen").isNotNull()).select("sale_id", "client", "e", "seen")
    seen_lines = stored(shipped.join(known, "sale_id").select("client", "e", F.greatest("seen", "shipped").alias("a"), "item", "cents"), "seen-lines")
    tree = rows(sold, at=F.col("e"), kind=F.lit(SALES), avail=F.coalesce("seen", F.lit(NEVER)), n=F.lit(1), c=F.col("cents"))
    tree = tree.unionByName(rows(seen_lines, at=F.col("e"), kind=F.lit(SALES), avail=F.col("a"), n2=F.lit(1), c2=F.col("cents")))
    flags = {f"i{w}": F.when(F.col("w") == w, F.col("n")).otherwise(0) for w in range(k)}
    pieces = _pieces(seen_lines, windows)
    tree = tree.unionByName(rows(pieces, kind=F.when(F.col("avail") < NEVER, SALES).otherwise(POINT), n=F.lit(0), **flags))
    tree = tree.groupBy("client", "at", "avail", "kind").agg(*(F.sum(c).alias(c) for c in numbers))
    events = events.unionByName(rows(tree, **{c: F.col(c) for c in numbers}))

    jitter = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(0)) % JITTER_SECONDS
    probes = sold.select("client", F.coalesce("sale_id", F.lit(NO_ID)).alias("id"), (F.col("e") + jitter * 1_000_000).alias("t")).groupBy("client", "id", "t").agg(F.count("*").alias("times"))
    edge = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
    edges = [edge(AT, F.col("t")), edge(AHEAD, F.col("t") + LABEL_DAYS * DAY), *(edge(BEHIND + w, F.col("t") - d * DAY) for w, d in enumerate(windows))]
    laid = probes.select("client", "id", "t", "times", F.explode(F.array(*edges)).alias("x")).select("client", "id", "t", "times", "x.*")
    return events.unionByName(rows(laid, at=F.col("at"), edge=F.lit(1), kind=F.col("kind"), id=F.col("id"), avail=F.col("t"), n=F.col("times")))


def tree_sums(values: np.ndarray, avail: np.ndarray, clicks: np.ndarray, low: np.ndarray, high: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the sum of the rows of ``values`` at positions low to high - 1 with avail <= t, and the last click there or -1.

    A merge-sort tree, level by level: blocks of 2^level positions, each sorted by availability, with prefix sums and
    the prefix maximum of click positions.  A range takes at most two blocks of a level, each by a binary search.
    """
    m, out = len(values), np.zeros((len(low), values.shape[1]), np.int64)
    last = np.full(len(low), -1, np.int64)
    by_avail = np.argsort(avail, kind="stable")
    rank = np.empty(m, np.int64)
    rank[by_avail] = np.arange(m)
    upto = np.searchsorted(avail[by_avail], t, side="right")
    q = np.flatnonzero(low < high)
    low, high, level = low[q], high[q], 0
    while len(q):
        order = by_avail[np.argsort((by_avail >> level).astype(np.uint16), kind="stable")] if level else np.arange(m)  # 16 bits: sorted by counting
        keys = (order >> level) * m + rank[order]
        sums = np.zeros((m + 1, values.shape[1]), np.int64)
        np.cumsum(values[order], axis=0, out=sums[1:])
        top = np.maximum.accumulate(np.where(clicks[order], order, -1))  # positions of earlier blocks are lower
        for odd, block in (((low & 1) == 1, low), ((high & 1) == 1, high - 1)):
            which = np.flatnonzero(odd)
            if not len(which):
                continue
            b, of = block[which], q[which]
            at, begin = np.searchsorted(keys, b * m + upto[of]), b << level
            out[of] += sums[at] - sums[begin]
            best = np.where(at > begin, top[np.maximum(at - 1, 0)], -1)
            last[of] = np.maximum(last[of], np.where(best >= begin, best, -1))
        low, high, level = (low + 1) >> 1, high >> 1, level + 1
        more = low < high
        q, low, high = q[more], low[more], high[more]
    return out, last


def _scan_schema(k: int) -> str:
    return "w int, part int, unit bigint, client bigint, id bigint, t bigint, times bigint, whole boolean, has_low boolean, has_t boolean, k_label int, ahead bigint, last_at bigint, last_id bigint, " + ", ".join(f"{c} bigint" for c in (*SUMS, *(f"i{w}" for w in range(k))))


def _scan(k: int, unit_rows: int):
    """Over rows in the common order: each probe's share of each unit; the events of units of one client; sums of the partition."""
    schema = pa.schema([*((f"{c}", {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]) for c, kind in (x.split() for x in _scan_schema(k).split(", ")))])
    names = schema.names

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        empty = {"int": lambda: np.zeros(n, np.int32), "bigint": lambda: np.zeros(n, np.int64), "boolean": lambda: np.zeros(n, bool)}
        kinds = dict(x.split() for x in _scan_schema(k).split(", "))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(np.asarray(columns[c] if c in columns else empty[kinds[c]]()), schema.field(c).type) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, unit = TaskContext.get().partitionId(), 0
        ran = np.zeros(1 + k, np.int64)  # sales, and points by window, of the partition so far

        def of_unit(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal ran
            kind = x["kind"]
            is_event = kind <= SALES
            event = np.flatnonzero(is_event)
            click, sale = kind[event] == CLICK, kind[event] == SALES
            n, c = x["n"][event], x["c"][event]
            values = np.stack([click, n * click, c * click, n * sale, c * sale, x["n2"][event], x["c2"][event], *(x[f"i{w}"][event] for w in range(k))], axis=1).astype(np.int64)
            steps = np.stack([x["n"] * (kind == SALES), *(x[f"i{w}"] * (kind == POINT) for w in range(k))], axis=1)
            runs = ran + np.cumsum(steps, axis=0)
            ran = runs[-1]
            before = np.cumsum(is_event)  # events up to a row
            edge = np.flatnonzero(kind >= AT)
            if len(edge):
                order = edge[np.lexsort((x["avail"][edge], x["id"][edge], x["client"][edge]))]
                key = [x[c][order] for c in ("client", "id", "avail")]
                new = np.ones(len(order), bool)
                new[1:] = np.any([a[1:] != a[:-1] for a in key], axis=0)
                probe, first = np.cumsum(new) - 1, order[new]
                p = len(first)
                where = np.full((p, 2 + k), -1, np.int64)
                where[probe, kind[order] - AT] = order
                at_row, ahead_row = where[:, 0], where[:, 1]
                has_t, has_ahead = at_row >= 0, ahead_row >= 0
                ahead = np.where(has_ahead, runs[ahead_row, 0], 0) - np.where(has_t, runs[at_row, 0], 0)
                high = np.where(has_t, before[at_row], len(event))
                for w in range(k):
                    low_row = where[:, 2 + w]
                    has_low = low_row >= 0
                    low = np.where(has_low, before[low_row], 0)
                    low = np.where(has_low | has_t, low, high)
                    sums, last = tree_sums(values, x["avail"][event], click, low, high, x["avail"][first]) if len(event) else (np.zeros((p, 7 + k), np.int64), np.full(p, -1))
                    item = sums[:, 7 + w] + np.where(has_low, runs[low_row, 1 + w], 0)
                    some = last >= 0
                    row = event[np.maximum(last, 0)] if len(event) else np.zeros(p, np.int64)
                    given = {c: sums[:, i] for i, c in enumerate(SUMS)}
                    whole = has_t & has_low & has_ahead
                    label_part = has_ahead.astype(np.int32) - has_t.astype(np.int32)
                    batch = batch_of(p, w=np.full(p, w, np.int32), part=np.full(p, part, np.int32), unit=np.full(p, unit), client=x["client"][first], id=x["id"][first], t=x["avail"][first], times=x["n"][first], whole=whole, has_low=has_low, has_t=has_t, k_label=label_part, ahead=ahead, last_at=pa.array(x["at"][row], mask=~some), last_id=pa.array(x["id"][row], mask=~some), i0=item, **given)
                    yield batch.filter(pa.array(has_low | has_t | has_ahead))  # a probe may be here with another window's edge only
            if len(event) and x["client"][0] == x["client"][-1]:  # it may lie between two edges of its client
                keep = x["avail"][event] < NEVER
                seen = event[keep]
                given = {c: values[keep, i] for i, c in enumerate((*SUMS, *(f"i{w}" for w in range(k))))}
                m, clicked = len(seen), click[keep]
                yield batch_of(m, w=np.full(m, -1, np.int32), part=np.full(m, part, np.int32), unit=np.full(m, unit), client=x["client"][seen], t=x["avail"][seen], last_at=pa.array(x["at"][seen], mask=~clicked), last_id=pa.array(x["id"][seen], mask=~clicked), **given)

        held: list[pa.RecordBatch] = []
        size = 0

        def taken(rows: list[pa.RecordBatch]) -> pa.Table:
            return pa.Table.from_batches(rows)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < unit_rows:
                continue
            table, at = taken(held), 0
            while size - at >= unit_rows:
                piece = table.slice(at, unit_rows)
                yield from of_unit({c: piece.column(c).to_numpy() for c in piece.column_names})
                at, unit = at + unit_rows, unit + 1
            held = table.slice(at).to_batches()
            size -= at
        if size:
            piece = taken(held)
            yield from of_unit({c: piece.column(c).to_numpy() for c in piece.column_names})
            unit += 1
        yield batch_of(1, w=np.full(1, -2, np.int32), part=np.full(1, part, np.int32), unit=np.full(1, unit), ahead=ran[:1], **{f"i{w}": ran[1 + w : 2 + w] for w in range(k)})

    return run


def _merge_schema(k: int) -> str:
    return "w int, part int, client bigint, id bigint, t bigint, first boolean, level int, block bigint, end_level int, end_block bigint, last_at bigint, last_id bigint, " + ", ".join(f"{c} bigint" for c in (*SUMS, *(f"i{w}" for w in range(k))))


def _merge(k: int):
    """Over events and probes by (level, block, avail): each probe's prefix sums in its block, as far as this partition has it."""
    kinds = dict(x.split() for x in _merge_schema(k).split(", "))
    types = {"int": (pa.int32(), np.int32), "bigint": (pa.int64(), np.int64), "boolean": (pa.bool_(), bool)}
    measures = [*SUMS, *(f"i{w}" for w in range(k))]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(np.asarray(columns[c] if c in columns else np.zeros(n, types[t][1])), types[t][0]) for c, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start = now = None
        total, best = np.zeros(7 + k, np.int64), (NO_ID, NO_ID, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c) for c in batch.schema.names}
            level, block = x["level"].to_numpy(), x["block"].to_numpy()
            if start is None:
                start = now = (int(level[0]), int(block[0]))
            n = len(level)
            new = np.ones(n, bool)
            new[1:] = (level[1:] != level[:-1]) | (block[1:] != block[:-1])
            new[0] = (int(level[0]), int(block[0])) != now
            if new[0]:
                total, best = np.zeros(7 + k, np.int64), (NO_ID, NO_ID, False)
            group = np.cumsum(new) - new[0]
            values = np.stack([x[c].to_numpy() for c in measures], axis=1)
            sums = np.cumsum(values, axis=0)
            heads = np.flatnonzero(new[1:]) + 1
            base = np.zeros((1 + len(heads), 7 + k), np.int64)
            base[0], base[1:] = -total, sums[heads - 1]
            sums -= base[group]
            clicked = np.asarray(x["last_at"].is_valid())
            at, key = (np.append(x[c].fill_null(NO_ID).to_numpy(), best[i]) for i, c in enumerate(("last_at", "last_id")))
            valid = np.append(clicked, best[2])
            order = np.lexsort((key, at, valid))
            rank = np.empty(n + 1, np.int64)
            rank[order] = np.arange(n + 1)
            rank[~valid] = -1
            high = np.maximum.accumulate(np.where(np.arange(n) == 0, np.maximum(rank[:n], rank[n]), rank[:n]) + group * (n + 2)) - group * (n + 2)
            of = order[np.maximum(high, 0)]
            probe = np.flatnonzero(x["is_probe"].to_numpy() == 1)
            if len(probe):
                w = x["w"].to_numpy()[probe]
                given = {c: sums[probe, i] for i, c in enumerate(SUMS)}
                first = (level[probe] == start[0]) & (block[probe] == start[1])
                none = high[probe] < 0
                yield batch_of(len(probe), w=w, part=np.full(len(probe), part, np.int32), client=x["client"].take(pa.array(probe)), id=x["id"].take(pa.array(probe)), t=x["avail"].take(pa.array(probe)), first=first, level=level[probe], block=block[probe], last_at=pa.array(at[of[probe]], mask=none), last_id=pa.array(key[of[probe]], mask=none), i0=sums[probe, 7 + w], **given)
            now, total = (int(level[-1]), int(block[-1])), sums[-1].copy()
            best = (int(at[of[-1]]), int(key[of[-1]]), True) if high[-1] >= 0 else (NO_ID, NO_ID, False)
        if start is not None:
            none = np.array([not best[2]])
            yield batch_of(1, w=np.full(1, -2, np.int32), part=np.full(1, part, np.int32), level=np.full(1, start[0], np.int32), block=np.full(1, start[1]), end_level=np.full(1, now[0], np.int32), end_block=np.full(1, now[1]), last_at=pa.array(np.full(1, best[0]), mask=none), last_id=pa.array(np.full(1, best[1]), mask=none), **{c: total[i : i + 1] for i, c in enumerate(measures)})

    return run


def _whole_units(spans: DataFrame, events: DataFrame, widest: int, k: int) -> DataFrame:
    """The probes' sums over the whole units between their edges, by dyadic blocks of units; several rows a probe."""
    spark = spans.sparkSession
    levels = F.sequence(F.lit(0), F.lit(max(0, (widest - 1).bit_length() - 1)))
    measures = [*SUMS, *(f"i{w}" for w in range(k))]
    placed = events.select(F.explode(levels).alias("level"), "g", F.col("t").alias("avail"), F.lit(0).alias("is_probe"), F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("client"), F.lit(0).cast("bigint").alias("id"), "last_at", "last_id", *measures)
    placed = placed.withColumn("block", F.expr("shiftright(g, level)")).drop("g")
    low, high = F.expr("-shiftright(-(g_low + 1), level)"), F.expr("shiftright(g_t, level)")  # the units after the one of the lower edge, before that of t
    some = spans.select("client", "id", "t", "w", "g_low", "g_t", F.explode(levels).alias("level")).withColumn("low", low).withColumn("high", high).where("low < high")
    blocks = F.filter(F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)), lambda x: x.isNotNull())
    null = F.lit(None).cast("bigint")
    asked = some.select("level", F.explode(blocks).alias("block"), F.col("t").alias("avail"), F.lit(1).alias("is_probe"), "w", "client", "id", null.alias("last_at"), null.alias("last_id"), *(F.lit(0).cast("bigint").alias(c) for c in measures))
    order = ["level", "block", "avail", "is_probe", "last_at", "last_id", "client", "id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = placed.select(asked.columns).unionByName(asked).repartitionByRange(n, *order).sortWithinPartitions(*order)
    merged = stored(both.mapInArrow(_merge(k), _merge_schema(k)), "merged")
    ends = merged.where("w = -2")
    carried = ends.select("part", "level", "block").alias("p").join(ends.alias("q"), F.expr("q.end_level = p.level AND q.end_block = p.block AND q.part < p.part")).groupBy("p.part").agg(*(F.sum(f"q.{c}").alias(f"more_{c}") for c in measures), F.max(F.when(F.col("q.last_at").isNotNull(), F.struct("q.last_at", "q.last_id"))).alias("more_last"))
    got = merged.where("w >= 0").withColumn("from", F.when(F.col("first"), F.col("part"))).join(F.broadcast(carried.withColumnRenamed("part", "from")), "from", "left")  # a row a partition
    item = F.col("i0") + F.coalesce(F.element_at(F.array(*(F.col(f"more_i{w}") for w in range(k))), F.col("w") + 1), F.lit(0))
    last = F.greatest(F.when(F.col("last_at").isNotNull(), F.struct("last_at", "last_id")), F.col("more_last"))
    return got.select("client", "id", "t", "w", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in SUMS), item.alias("n_items"), last.alias("last"))


def point_in_time(sales: DataFrame, clicks: DataFrame, lines: DataFrame, windows: Sequence[int] = WINDOWS, unit_rows: int = UNIT) -> DataFrame:
    """One row per sale and window: what was known at the sale's time t, and whether the client bought again after it.

    Result: sale_id, d (days), t_us, label, n_clicks, n_purchases, click_cents, last_click_id, n_sales, sale_cents, n_lines,
    n_items, line_cents.  A sale without client_id or sold_at gives no row; repeated sale rows give repeated rows and
    count as often.  A null sale_id has no lines and a CRC of 0.  Clicks that equal another in all columns count once.
    A null ts, arrived_at or shipped_at is never seen; amounts that are null or not finite are 0 cents; a null click_id
    is below all others, and is null as the last one.  Rows of equal time are on the same side of every edge.  Empty
    tables give no rows or zeros.  Further columns count in the equality of clicks only.
    """
    spark, k = sales.sparkSession, len(windows)
    if list(windows) != sorted(set(windows)) or windows[0] <= 0 or not 0 < unit_rows <= UNIT:
        raise ValueError(f"windows must be distinct and rising, units hold up to {UNIT} rows")
    order = ["client", "at", "edge", "id", "avail", "kind"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = laid_rows(spark, sales, clicks, lines, windows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    scanned = stored(laid.mapInArrow(_scan(k, unit_rows), _scan_schema(k)), "scanned")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    items = [f"i{w}" for w in range(k)]
    offsets = F.broadcast(scanned.where("w = -2").select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("unit", "ahead", *items))))
    rows = scanned.where("w >= 0").join(offsets, "part")
    points = F.element_at(F.array(*(F.col(f"before_{c}") for c in items)), F.col("w") + 1)
    g = F.col("before_unit") + F.col("unit")
    last = F.when(F.col("last_at").isNotNull(), F.struct("last_at", "last_id"))
    rows = rows.select("client", "id", "t", "w", "times", "whole", *SUMS, (F.col("i0") + F.when(F.col("has_low"), points).otherwise(0)).alias("n_items"), (F.col("ahead") + F.col("k_label") * F.col("before_ahead")).alias("ahead"), last.alias("last"), F.when(F.col("has_low"), g).alias("g_low"), F.when(F.col("has_t"), g).alias("g_t"))
    keys, adds = ["client", "id", "t", "w"], [*SUMS, "n_items"]
    cut = rows.where(~F.col("whole")).groupBy(*keys).agg(F.max("times").alias("times"), *(F.sum(c).alias(c) for c in (*adds, "ahead")), F.max("last").alias("last"), F.max("g_low").alias("g_low"), F.max("g_t").alias("g_t"))
    cut = stored(cut, "cut")
    apart = F.col("g_t") - F.col("g_low") >= 2
    widest = cut.agg(F.max(F.col("g_t") - F.col("g_low"))).first()[0] or 0
    out = [rows.where("whole").select(*keys, "times", *adds, "ahead", "last")]
    if widest < 2:
        out.append(cut.select(*out[0].columns))
    else:
        events = scanned.where("w = -1").join(offsets, "part").withColumn("g", g)
        between = _whole_units(cut.where(apart), events, widest, k).withColumn("times", F.lit(0).cast("bigint")).withColumn("ahead", F.lit(0).cast("bigint"))
        both = cut.where(apart).select(*out[0].columns).unionByName(between)
        out += [cut.where(~apart).select(*out[0].columns), both.groupBy(*keys).agg(F.max("times").alias("times"), *(F.sum(c).alias(c) for c in (*adds, "ahead")), F.max("last").alias("last")).select(*out[0].columns)]
    got = out[0]
    for more in out[1:]:
        got = got.unionByName(more)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    days = F.element_at(F.array(*(F.lit(d) for d in windows)), F.col("w") + 1)
    got = got.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return got.select(named("id").alias("sale_id"), days.alias("d"), F.col("t").alias("t_us"), (F.col("ahead") > 0).alias("label"), "n_clicks", "n_purchases", "click_cents", named("last.last_id").alias("last_click_id"), "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
