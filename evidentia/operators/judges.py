"""Judges' replies to metric scores: long rows, weighted means and variances, uncertainty and escalation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import lexicons as L
from evidentia.functions import math as M


def judge_rows(replies: DataFrame, keys: Sequence[str], reply: str = "reply", metrics: Sequence[str] = L.JUDGED) -> DataFrame:
    """keys, metric, score, confidence, failed: one row per judge reply and metric."""
    body = M.json_block(F.col(reply))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), M.judge_metric(F.col("_body"), m).alias("r")) for m in metrics)))
    rows = replies.select(*keys, body.alias("_body")).select(*keys, F.col("_body").isNull().alias("failed"), each.alias("x"))
    return rows.select(*keys, "failed", F.col("x.metric").alias("metric"), F.col("x.r.score").alias("score"), F.col("x.r.confidence").alias("confidence"))


def ensemble(rows: DataFrame, keys: Sequence[str], count_failed: bool = False) -> DataFrame:
    """score, variance and mean_confidence over judges, weighted by confidence and a little.

    The variance comes from squares about the mean, in one pass over sums that partial aggregation can merge, of
    values within 0 and 1.  Failed judges count as 0 with ``count_failed``; else they do not count.  Where none is
    left, the score is 0 and the variance 1.
    """
    w = F.col("confidence") + 1e-3
    use = F.lit(True) if count_failed else ~F.col("failed")
    on = lambda c: F.sum(F.when(use, c))
    got = rows.groupBy(*keys).agg(on(w).alias("w"), on(w * F.col("score")).alias("ws"), on(w * F.col("score") * F.col("score")).alias("wss"), F.avg(F.when(use, F.col("confidence"))).alias("mean_confidence"))
    mean = F.col("ws") / F.col("w")
    return got.select(*keys, F.coalesce(mean, F.lit(0.0)).alias("score"), F.when(mean.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("wss") / F.col("w") - mean * mean)).alias("variance"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"))


def over_evidence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A claim's score and variance per metric, evidence weighted by max(confidence, 0.3) * max(relevance, 0.2)."""
    w = F.greatest(F.col("mean_confidence"), F.lit(0.3)) * F.greatest(F.col("relevance"), F.lit(0.2))
    return rows.groupBy(*keys).agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"), (F.sum(w * F.col("variance")) / F.sum(w)).alias("variance"))


def uncertainty(variances: Column, unstable_above: float = 0.05, high: float = 0.1, medium: float = 0.05) -> Column:
    """Of a map of variances: their mean, the unstable names, disagreement, level and confidence."""
    n = F.greatest(F.lit(1), F.size(variances))
    mean = F.aggregate(F.map_values(variances), F.lit(0.0), lambda s, x: s + x) / n
    unstable = F.array_sort(F.map_keys(F.map_filter(variances, lambda _, v: v > unstable_above)))
    share = F.size(unstable) / n
    return F.struct(
        mean.alias("mean_variance"), unstable.alias("unstable"), share.alias("disagreement"), (share > 0.2).alias("high_disagreement"),
        F.when(mean > high, "high").when(mean > medium, "medium").otherwise("low").alias("level"), F.greatest(F.lit(0.0), 1 - mean).alias("confidence"),
    )


def uncertainty_score(margin: Column, unstable: Column, disagreement: Column, level: Column, n: Column) -> Column:
    parts = (
        F.least(0.12 * F.size(unstable), F.lit(0.36)) + F.least(disagreement, F.lit(0.3)) + F.when(margin < 0.15, (0.15 - margin) / 0.15 * 0.25).otherwise(0.0)
        + F.when(n < 2, 0.25).when(n < 4, 0.1).otherwise(0.0) + F.when(level == "high", 0.3).when(level == "medium", 0.15).otherwise(0.0)
    )
    return F.least(parts, F.lit(1.0))


def decide(ess: Column, ecs: Column, analysis: Column, n: Column, accept_to: float = 0.3, disagreement_above: float = 0.3, compat: bool = False) -> Column:
    """decision, sorted actions, confidence, uncertainty and its score.

    An accepted claim has no actions.  ``compat`` keeps the older behaviour, in which the names of unstable metrics
    never matched, so they asked for no action.
    """
    margin = F.abs(ess - ecs)
    unstable, spread, level = analysis["unstable"], analysis["disagreement"], analysis["level"]
    score = uncertainty_score(margin, unstable, spread, level, n)
    shaky = lambda *names: F.lit(False) if compat else F.arrays_overlap(unstable, F.array(*map(F.lit, names)))
    worst = (level == "high") | (score > 0.7)
    rules = (
        ("more_evidence", shaky("ESS", "ECS") | (n < 2) | worst),
        ("debate", shaky("LCS") | (margin < 0.1) | (spread > disagreement_above) | worst),
        ("refine_claim", shaky("CMS") & (n > 2)),
        ("rephrase_claim", shaky("HLS")),
        ("global_review", worst),
    )
    actions = F.array_sort(F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda a: a.isNotNull()))
    escalate = score > accept_to
    return F.struct(
        F.when(escalate, "escalate").otherwise("accept").alias("decision"), F.when(escalate, actions).otherwise(F.array().cast("array<string>")).alias("actions"),
        analysis["confidence"].alias("confidence"), level.alias("uncertainty"), score.alias("uncertainty_score"),
    )


def adjudication(reply: Column) -> Column:
    """Three numbers of an adjudicator's reply; 0 for what is missing or no number."""
    v = F.try_parse_json(M.json_block(reply))
    return F.struct(*(F.coalesce(F.try_variant_get(v, f"$.{n}", "double"), F.lit(0.0)).alias(n) for n in ("support_score", "contradiction_score", "confidence")))


def argument(reply: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(M.json_block(reply)), "$.argument", "string")
