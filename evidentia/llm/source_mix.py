"""Mixing sources to target weights: a curriculum over training time, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.common import WORD_PATTERN, stored

#: Weights that the sources take in turn, by code point order of their names, null last.
WEIGHTS = (5, 2, 1)
#: All targets' share of all sizes, and a source's most in its own size.
TOTAL, MOST = 1.5, 2
#: How a source's rate changes over training, by turn: from (1 - slope) to (1 + slope) times its mean.
SLOPES = (-0.5, 0.0, 0.5)
#: A source's documents fall into this many slots by hash, so that running sums need no whole source in one task.
SLOTS = 65_536


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """source, source_size, target and slope of each source of (source, size).

    Water-filling in one pass: sources in order of 2 * size / weight stop one after the other; the first that does
    not stop sets the level at which the rest share by weight.  One row per source stands in the unpartitioned
    windows, so these tasks hold the list of sources, never documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn") % len(values)).cast("int") + 1)
    per = per.withColumn("turn", turn).withColumn("weight", pick(weights).cast("double")).withColumn("slope", pick(slopes).cast("double")).withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "turn")
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))).withColumn("all", F.sum("source_size").over(whole).cast("double"))
    level = (F.lit(TOTAL) * F.col("all") - F.col("before")) / F.col("rest")
    per = per.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    level = F.max("level").over(whole)
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"), "slope")


def _invert(share: Column, slope: Column) -> Column:
    """The time at which a source whose rate goes from 1 - slope to 1 + slope has given this share of its words."""
    return F.when(slope == 0, share).otherwise((slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope))


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, positions and passes, by training position.

    Within a source, documents stand in the order of a hash.  Each is taken floor(target / source_size) times; one
    more pass takes documents from the front until floor(target) words are reached, where it stops inside a document.
    Taken words so add up to floor(target), and no document exceeds twice its size.

    A source's rate at time t is its mean times 1 + slope * (2 t - 1).  Its integral is the source's cumulative demand
    for words.  A copy that is taken stands where this demand reaches the words that the source has given before it:
    the integral, inverted at those words over floor(target).  ``positions`` holds one in [0, 1] for each copy, the
    part of a document that the last pass takes among them; ``position`` is the first, null if nothing is taken.

    Null texts have size 0 and none taken; null sources are one source; a null doc_id is as -1 in the order.
    Documents with the same doc_id and size may change places, which leaves the same rows.  An empty table gives an
    empty result.  With ``key``, a column that no two rows share, the rows carry it, and such documents stand in the
    order of a hash of their columns.
    """
    own = [F.col(key), F.xxhash64(*(c for c in documents.columns if c != key)).alias("_tell")] if key else []
    ties = ["_tell", key] if key else []
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    sized = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *own)
    sized = stored(sized.withColumn("hash", F.md5(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string"))), "sizes")
    slot = F.conv(F.substring("hash", 1, 4), 16, 10).cast("int")
    goals = stored(targets(sized, weights, slopes), "targets")
    slots = sized.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("n"))
    slots = slots.select(F.col("source").alias("_source"), F.col("slot").alias("_slot"), (F.sum("n").over(W.partitionBy("source").orderBy("slot")) - F.col("n")).alias("upto"))
    slots = slots.join(goals, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source")
    rows = sized.withColumn("slot", slot).withColumn("within", F.sum("size").over(W.partitionBy("source", "slot").orderBy("hash", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slot") == F.col("_slot")), "left")
    before = F.col("upto") + F.col("within")
    goal = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), goal - passes * F.col("source_size") - before))
    copies = F.when(F.col("size") > 0, passes + F.when(extra > 0, 1).otherwise(0)).otherwise(0).cast("int")
    counted = rows.withColumn("passes", passes.cast("bigint")).withColumn("taken", (F.col("passes") * F.col("size") + extra).cast("bigint")).withColumn("_before", before).withColumn("_goal", goal)
    at = F.transform(F.sequence(F.lit(0), copies - 1), lambda i: _invert((F.col("_before") + i * F.col("source_size")) / F.col("_goal"), F.col("slope")))
    counted = counted.withColumn("positions", F.when(copies > 0, at).otherwise(F.array().cast("array<double>")))
    first = F.when(F.size("positions") > 0, F.col("positions")[0])
    out = counted.select("doc_id", "source", "size", "source_size", "target", "taken", first.alias("position"), "positions", "passes", *ties[1:])
    return out.orderBy("position", "doc_id")


def apply_mix(documents: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of a mix, in the order of their positions: each as many times as its taken words come to, to the
    nearest whole document.

    One document per source is cut by the mix; here it stays whole or goes.  No two rows may share a ``key``.  Copies
    are dealt by ranges of positions and sorted within, so files follow the curriculum one after the other.
    """
    times = F.when(F.col("size") > 0, F.floor((F.col("taken") + F.col("size") / 2) / F.col("size"))).otherwise(0).cast("int")
    counts = mixed.select(F.col(key).alias("_mix_id"), F.slice("positions", F.lit(1), times).alias("_mix_at")).where(F.size("_mix_at") > 0)
    rows = documents.select(F.struct(*documents.columns).alias("_mix_own"), F.col(key).alias("_mix_key"))
    joined = rows.join(counts, F.col("_mix_key").eqNullSafe(F.col("_mix_id")), "inner")
    placed = joined.select("_mix_own", F.explode("_mix_at").alias("_mix_at"), "_mix_key").orderBy("_mix_at", "_mix_key")
    return placed.select(*(F.col(f"_mix_own.`{c}`").alias(c) for c in documents.columns))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as often as the sources' targets ask for, in the order of the curriculum.

    Rows are told apart by a number of their own that is stored with them, so null and repeated doc_ids are as good as
    others, and columns of any name stay as they are.
    """
    numbered = stored(documents.withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")
    return apply_mix(numbered, mix_sources(numbered, key="_mix_row"), "_mix_row").drop("_mix_row")
