"""Profiles, samples and nested examples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: nulls per column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def info(df: DataFrame) -> DataFrame:
    """One row per column: name, type and non-null values, in one pass."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"c{i}").alias("non_null")) for i, f in enumerate(df.schema)))).alias("x")).select("x.*")


def min_group(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows of keys that have at least ``least`` rows: counts are summed before the shuffle, then joined as a half join."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(keys, key, "left_semi")


def with_group_size(df: DataFrame, key: str, name: str = "group_size") -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias(name))
    other = sizes.withColumnRenamed(key, "_key")
    return df.join(other, df[key].eqNullSafe(other["_key"]), "left").drop("_key")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """Left lookup on a key made unique: the least value, or the first in ``order``."""
    one = table.groupBy(key).agg((F.min_by(value, order) if order else F.min(value)).alias(value))
    return df.join(one, key, "left")


def md5_rank(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(seed)))


def stratified_sample(df: DataFrame, key: str, row_id: str, seed: str = "210", least: int = 3, most: int = 5) -> DataFrame:
    """All rows of small groups; of others, a number from ``least`` to ``most`` set by a hash of the key, by hash order.

    Each task keeps the first rows of a group before the shuffle, and sizes are counted in parts, so no task sees a
    whole group.
    """
    spread = F.conv(F.substring(md5_rank(seed, key), 1, 4), 16, 10).cast("bigint")
    rank = F.row_number().over(W.partitionBy(key).orderBy(md5_rank(seed, row_id), row_id))
    first = df.withColumn("_rn", rank).where(F.col("_rn") <= max(least, most))
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("original_group_size"))
    ranked = first.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    k = F.when(F.col("original_group_size") <= least, F.col("original_group_size")).otherwise(least + spread % (F.least(F.lit(most), F.col("original_group_size")) - least + 1))
    return ranked.withColumn("_k", k).where("_rn <= _k").drop("_rn", "_k")


def fraction_sample(df: DataFrame, row_id: str, share: float = 0.1, seed: str = "1") -> DataFrame:
    """greatest(1, floor(n * share)) rows in hash order.

    Counts per slot of the hash, at most 65,536, tell at which slot the sample ends; slots before it count whole, and
    only the last one is sorted.
    """
    slot = F.conv(F.substring(md5_rank(seed, row_id), 1, 4), 16, 10).cast("int")
    slots = sorted((r.slot, r.n) for r in df.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect())
    need = max(1, int(sum(n for _, n in slots) * share))
    last = 0
    for last, n in slots:
        if n >= need:
            break
        need -= n
    return df.where(slot < last).unionByName(df.where(slot == last).orderBy(md5_rank(seed, row_id), row_id).limit(need))


def fixed_sample(df: DataFrame, row_id: str, n: int = 10, seed: str = "1") -> DataFrame:
    """The first ``n`` rows in hash order; an error if there are fewer.  Each task cuts to ``n`` before the shuffle."""
    got = df.orderBy(md5_rank(seed, row_id), row_id).limit(n)
    return got.crossJoin(df.limit(n).agg(F.count("*").alias("_n"))).where(F.when(F.col("_n") < n, F.raise_error(F.lit(f"fewer than {n} rows"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per element of a list column; a row whose list is null or empty stays once, with a null."""
    return df.select(*(c for c in df.columns if c != column), F.explode_outer(column).alias(name))


def merged(*maps: Column) -> Column:
    """One map of several: of a key's values, the last map's counts.  The order is that of first appearance."""
    both = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    return reduce(both, maps)


def with_rows_named(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is neither null nor blank, in place of rows that are dropped by number."""
    return df.where(F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > 0)


def masked(value: Column, shown: int = 4) -> Column:
    """A secret with all but its last characters as stars; all of a short one."""
    n = F.length(value)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - shown), F.right(value, F.lit(shown))))


def nest_examples(df: DataFrame, key: str, order: Sequence[str], evidence: dict[str, Column], first: Sequence[str] = (), most: int = 5) -> DataFrame:
    """One row per key: an ordered list of evidence structs, the lists of each field, and group sizes.  Needs sampled
    groups, of ``most`` rows at most; what is beyond goes."""
    item = F.struct(*order, *(c.alias(f"_{n}") for n, c in evidence.items()))
    got = df.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(item)), 1, most).alias("_e"), F.max("original_group_size").alias("original_group_size"), F.count("*").alias("sampled_group_size"), *(F.min(c).alias(c) for c in first))
    listed = F.transform("_e", lambda e: F.struct(*(e[f"_{n}"].alias(n) for n in evidence)))
    return got.select(key, *first, listed.alias("evidence"), F.struct(*(F.col(f"_e._{n}").alias(n) for n in evidence)).alias("evidence_structured"), F.struct("original_group_size", "sampled_group_size").alias("metadata"))


def union_tables(*frames: DataFrame) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_rows(candidates: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose keys the known rows do not have."""
    return candidates.join(known.select(*keys).distinct(), list(keys), "left_anti")


def pending(work: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that the manifest does not name as done; what was rate-limited or failed comes again."""
    return new_rows(work, manifest.where(F.col("status") == "done"), keys)
