"""The best k texts of each claim by support or contradiction, exactly, without scoring all pairs.

Both scores grow with the weight of the claim's tokens that a text holds.  Of a claim's tokens, from the rarest to the
commonest, those at the end whose weights together cannot reach the claim's k-th best score need no look-up: a text
that holds no other token cannot be among the best.  So the commonest tokens, whose lists are the longest, drop out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia import lexicons as L
from evidentia.functions import math as M
from evidentia.tables import stored

#: List entries per claim that the first look takes, from its rarest tokens, and texts that it scores for each of k.
#: They give a score that k texts reach; more of them raise it.  The result does not depend on either.
FIRST_ENTRIES, FIRST_TEXTS = 2000, 4
#: Room for the rounding of sums in another order.
SLACK = 1 - 1e-9


def postings(texts: DataFrame, key: str, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """(token, key) rows of the tokens that some claim has: the inverted index, stored."""
    rows = texts.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("_token"))
    return stored(rows.join(vocabulary, "_token", "left_semi"), "postings")


def bounds(parts: DataFrame, lists: DataFrame, claim: str) -> DataFrame:
    """Each claim's tokens that some text has, rarest first: ``before``, entries of rarer ones; ``rest``, weights from here on."""
    sizes = lists.groupBy("_token").agg(F.count("*").alias("_df"))
    order = W.partitionBy(claim).orderBy("_df", "_token")
    known = parts.join(sizes, "_token")
    before = F.coalesce(F.sum("_df").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return known.withColumn("before", before).withColumn("rest", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))


def _scored(pairs: DataFrame, claims: DataFrame, texts: DataFrame, claim: str, key: str, exact: Column) -> DataFrame:
    return pairs.join(claims, claim).join(texts, key).select(claim, key, exact.alias("score")).where(F.col("score") > 0)


def candidates(claims: DataFrame, texts: DataFrame, k: int, claim: str, key: str, tokens: str, parts: Column, exact: Column, upper: Callable[[Column], Column], ceiling: Column) -> DataFrame:
    """(claim, key) pairs that may be among a claim's best k; all others are certainly not.

    ``parts``: the claim's tokens with weights; ``upper`` of a weight, with the claim's ``_ceiling``, bounds the score of a
    text that holds tokens of that weight.
    """
    spread = claims.select(claim, ceiling.alias("_ceiling"), F.explode(parts).alias("_p")).select(claim, "_ceiling", F.col("_p.token").alias("_token"), F.col("_p.w").alias("_w"))
    lists = postings(texts, key, tokens, spread.select("_token").distinct())
    ranked = stored(bounds(spread, lists, claim), "bounds")
    rare = ranked.where(F.col("before") < FIRST_ENTRIES)
    some = lists.join(rare.select("_token").distinct(), "_token", "left_semi")
    some = some.withColumn("_n", F.row_number().over(W.partitionBy("_token").orderBy(F.xxhash64(key), key))).where(F.col("_n") <= FIRST_ENTRIES)
    met = rare.join(some, "_token").groupBy(claim, key).agg(F.sum("_w").alias("_got"))
    first = met.withColumn("_n", F.row_number().over(W.partitionBy(claim).orderBy(F.desc("_got"), key))).where(F.col("_n") <= FIRST_TEXTS * k).select(claim, key)
    reached = _scored(first, claims, texts, claim, key, exact)
    reached = reached.withColumn("_n", F.row_number().over(W.partitionBy(claim).orderBy(F.desc("score")))).where(F.col("_n") == k).select(claim, F.col("score").alias("_least"))
    bounded = ranked.join(reached, claim, "left").withColumn("_least", F.coalesce("_least", F.lit(0.0)))
    needed = upper(F.col("rest")) >= F.col("_least") * SLACK
    common = F.sum(F.when(~needed, F.col("_w")).otherwise(0.0)).over(W.partitionBy(claim))
    looked = bounded.withColumn("_needed", needed).withColumn("_common", common).where("_needed")
    found = looked.join(lists, "_token").groupBy(claim, key).agg(F.sum("_w").alias("_got"), F.first("_common").alias("_common"), F.first("_least").alias("_least"), F.first("_ceiling").alias("_ceiling"))
    return found.where(upper(F.col("_got") + F.col("_common")) >= F.col("_least") * SLACK).select(claim, key)


def _best(pairs: DataFrame, k: int, claim: str, key: str) -> DataFrame:
    best = F.row_number().over(W.partitionBy(claim).orderBy(F.round("score", 12).desc(), key))  # equal scores may differ in their last bits
    return pairs.withColumn("rank", best).where(F.col("rank") <= k)


def _weights(*columns: tuple[str, float]) -> Column:
    """Tokens of one or more arrays with weight share / size; a token in several gets the sum."""

    def weighed(column: str, share: float) -> Column:
        return F.transform(F.array_distinct(column), lambda t: F.struct(t.alias("token"), (F.lit(share) / F.greatest(F.lit(1), F.size(column))).alias("w")))

    each = [weighed(*c) for c in columns]
    if len(each) == 1:
        return each[0]
    both = F.concat(*each)
    names = F.array_distinct(F.transform(both, lambda x: x.token))
    return F.transform(names, lambda t: F.struct(t.alias("token"), F.aggregate(F.filter(both, lambda x: x.token == t), F.lit(0.0), lambda s, x: s + x.w).alias("w")))


def best_support(claims: DataFrame, texts: DataFrame, k: int, claim: str, key: str, c_tokens: str, c_entities: str, e_tokens: str) -> DataFrame:
    """(claim, key, score, rank): of each claim the k texts of highest support above 0; ties go to the lesser key.

    Tokens and entities are looked for among the text's tokens.  A claim without tokens, or whose tokens no text has,
    gives no row; null arrays count as empty; ids are taken as unique.
    """
    empty = F.array().cast("array<string>")
    a = claims.select(claim, *(F.coalesce(c, empty).alias(n) for c, n in ((c_tokens, "_c"), (c_entities, "_h"))))
    b = texts.select(key, F.coalesce(e_tokens, empty).alias("_e"))
    exact = M.support(F.col("_c"), F.col("_e"), F.col("_h"), F.col("_e"))
    pairs = candidates(a, b, k, claim, key, "_e", _weights(("_c", 0.5), ("_h", 0.5)), exact, lambda x: x, F.lit(1.0))
    return _best(_scored(pairs, a, b, claim, key, exact), k, claim, key)


def best_contradiction(claims: DataFrame, texts: DataFrame, k: int, claim: str, key: str, c_tokens: str, e_tokens: str, antonyms: Sequence[tuple[str, str]] = L.ANTONYMS, negations: Sequence[str] = L.NEGATIONS) -> DataFrame:
    """The same for contradiction, with a claim's and a text's tokens as their entities.

    A text's score is at most that of one with all opposites of the claim's tokens and a negation.
    """
    empty = F.array().cast("array<string>")
    a = claims.select(claim, F.coalesce(c_tokens, empty).alias("_c"))
    b = texts.select(key, F.coalesce(e_tokens, empty).alias("_e"))
    sides = [F.array_contains("_c", x).cast("int") + F.array_contains("_c", y).cast("int") for x, y in antonyms]
    most = 0.7 * sum(sides, F.lit(0)) / F.greatest(F.lit(1), F.size("_c")) + 0.3
    exact = M.contradiction(F.col("_c"), F.col("_e"), F.col("_c"), F.col("_e"), antonyms, negations)
    upper = lambda x: (0.1 + 0.9 * F.least(F.lit(1.0), x)) * F.col("_ceiling") * F.least(F.lit(1.0), x)
    pairs = candidates(a, b, k, claim, key, "_e", _weights(("_c", 1.0)), exact, upper, most)
    return _best(_scored(pairs, a, b, claim, key, exact), k, claim, key)
