"""Claim evaluation in bulk: a first pass over all claims, a second over those that escalate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia import lexicons as L
from evidentia.functions import dates as D
from evidentia.functions import math as M
from evidentia.functions import text as T
from evidentia.operators import evidence as E
from evidentia.operators import judges as J
from evidentia.operators import metrics as X
from evidentia.operators import vector as V
from evidentia.plans import dialogue
from evidentia.plans.providers import HashEmbedder, HashJudge, with_embeddings, with_replies
from evidentia.tables import stored


@dataclass(frozen=True)
class Config:
    """mode: baseline (no judge), single_llm (the first judge) or full (all judges, and the second pass)."""

    mode: str = "full"
    k: int = 5
    k_more: int = 10
    threshold: float = 0.2
    accept_to: float = 0.3
    judges: Sequence = field(default_factory=lambda: (HashJudge("a"), HashJudge("b")))
    embedder: object = field(default_factory=HashEmbedder)
    talker: object = field(default_factory=dialogue.HashTalker)

    def active(self) -> Sequence:
        return {"baseline": (), "single_llm": self.judges[:1], "full": self.judges}[self.mode]


def prepare(claims: DataFrame, as_of, config: Config) -> DataFrame:
    """(claim_id, claim) with time, tokens, entities, sentences and a vector."""
    text = F.col("claim")
    rows = claims.select("claim_id", "claim", D.claim_time(text, F.lit(as_of).cast("timestamp")).alias("claim_time"), T.tokens(text).alias("tokens"), T.entities_of(text).alias("entities"), T.sentences(text, 1, 1 << 30).alias("sentences"))
    return with_embeddings(rows, "claim", config.embedder, name="claim_vec")


def gather(claims: DataFrame, chunks: DataFrame, k: int, config: Config) -> DataFrame:
    """The k nearest chunks of each claim as evidence, after triage."""
    near = V.knn_batched(claims.select("claim_id", F.col("claim_vec").alias("embedding")), chunks, k, "claim_id", "chunk_id")
    hits = near.join(chunks.drop("embedding"), "chunk_id").withColumn("ev_ord", F.col("rank"))
    found = E.inputs(E.evidence(E.matches(hits).withColumn("ev_ord", F.col("rank"))))
    return V.triage(found.withColumn("relevance", M.relevance(F.col("score"))), k=config.k, threshold=config.threshold).drop("rn", "rank")


def score(claims: DataFrame, evidence: DataFrame, config: Config) -> DataFrame:
    """One row per claim: the metrics, variances, claim and evidence scores and credibility."""
    c = X.claim_metrics(claims).withColumn("LCS0", X.coherence(F.col("sentences"), F.col("entities")))
    pairs = evidence.join(claims.select("claim_id", "claim", "claim_time", F.col("tokens").alias("c_tokens"), F.col("entities").alias("c_entities")), "claim_id")
    pairs = pairs.withColumn("e_tokens", T.tokens(F.col("text"))).withColumn("e_entities", T.entities_of(F.col("text")))
    base = X.evidence_metrics(pairs).join(X.baseline_scores(pairs), "claim_id")
    out = c.select("claim_id", "claim", "CMS", "HLS", "CScope", F.col("LCS0").alias("LCS")).join(base, "claim_id", "left").na.fill(0.0, ["ESS", "ECS", "EAGS", "EAS", "ERS", "ESTS", "SDS", "EVS"]).na.fill(0, ["n"])
    if not config.active():
        zero = F.create_map().cast("map<string,double>")
        e = X.evidence_score({k: F.col(k) for k in L.EVIDENCE_METRICS}, clip=False)
        return out.withColumn("variances", zero).withColumn("credibility", M.shrink(F.col("n"), e, X.claim_score(*(F.col(k) for k in ("CMS", "HLS", "LCS", "CScope")), clip=False)))
    prompts = pairs.select("claim_id", "ev_ord", "relevance", F.concat_ws("\n", F.lit("Judge how the evidence bears on the claim."), F.concat(F.lit("Claim: "), "claim"), F.concat(F.lit("Evidence: "), "text")).alias("prompt"))
    rows = J.judge_rows(with_replies(prompts, "prompt", config.active()), ["claim_id", "ev_ord", "relevance", "judge"])
    each = J.ensemble(rows, ["claim_id", "ev_ord", "relevance", "metric"])
    judged = J.over_evidence(each, ["claim_id", "metric"]).groupBy("claim_id").pivot("metric", list(L.JUDGED)).agg(F.first("score").alias("score"), F.first("variance").alias("var"))
    agree = each.where(F.col("metric") == "ESS").groupBy("claim_id").agg(X.weighted(F.col("score"), F.col("mean_confidence")).alias("EAGS"))
    wide = judged.select("claim_id", *(F.col(f"{m}_score").alias(m) for m in L.JUDGED), *(F.col(f"{m}_var").alias(f"v_{m}") for m in L.JUDGED))
    out = out.drop(*L.JUDGED, "EAGS").join(wide, "claim_id", "left").join(agree, "claim_id", "left").na.fill(0.0, [*L.JUDGED, "EAGS"]).na.fill(1.0, [f"v_{m}" for m in L.JUDGED])
    cv = (F.col("v_CMS") + F.col("v_HLS") + F.col("v_LCS")) / 4
    ev = X.evidence_variance(F.col("v_ESS"), F.col("v_ECS"))
    e = X.penalised(X.evidence_score({k: F.col(k) for k in L.EVIDENCE_METRICS}), ev)
    cs = X.claim_score(*(F.col(k) for k in ("CMS", "HLS", "LCS", "CScope")))
    names = [*((m, F.col(f"v_{m}")) for m in L.JUDGED), ("claim_variance", cv), ("evidence_variance", ev)]
    return out.withColumn("variances", F.create_map(*(x for n, v in names for x in (F.lit(n), v)))).withColumn("credibility", M.shrink(F.greatest(F.lit(1), F.col("n")), e, cs)).drop(*(f"v_{m}" for m in L.JUDGED))


def _decided(scored: DataFrame, config: Config, number: int) -> DataFrame:
    decision = J.decide(F.col("ESS"), F.col("ECS"), F.col("_analysis"), F.col("n"), config.accept_to)
    return scored.withColumn("_analysis", J.uncertainty(F.col("variances"))).withColumn("decision", decision).drop("_analysis").withColumn("pass", F.lit(number))


def evaluate(claims: DataFrame, chunks: DataFrame, as_of, config: Config | None = None, given: DataFrame | None = None) -> DataFrame:
    """Per claim: metrics, credibility, the first pass's decision, and the pass that counts.

    In full mode, claims that escalate are evaluated once more, as their actions say: in other words
    (rephrase_claim), on ``k_more`` chunks alone (global_review), or on these beside what they had (more_evidence).
    A debate then sets ESS and ECS; credibility stays, and credibility_post_debate counts the new values.  Model calls
    are dear, so what they give is written to the shared folder and read from there by all that follows.  ``given``
    is evidence, as ``gather`` gives it, that the first pass takes in place of the nearest chunks.
    """
    config = config or Config()
    ready = stored(prepare(claims, as_of, config), "claims")
    chunks = stored(chunks, "chunks")
    first = stored(gather(ready, chunks, config.k, config) if given is None else given, "evidence")
    one = _decided(stored(score(ready, first, config), "pass1"), config, 1)
    if config.mode != "full":
        return one.drop("decision")
    one = one.withColumn("credibility_post_debate", F.col("credibility"))
    again = stored(one.where(F.col("decision.decision") == "escalate").select("claim_id", "decision"), "escalated")
    does = lambda action: F.array_contains("decision.actions", action)
    told = dialogue.rephrase(claims.select("claim_id", "claim").join(again, "claim_id"), does("rephrase_claim"), config.talker)
    todo = stored(prepare(told, as_of, config), "claims")
    more = gather(todo, chunks, config.k_more, config).join(again, "claim_id").where(does("more_evidence") | does("global_review"))
    had = first.join(again, "claim_id").where(~does("global_review"))
    fresh = more.join(had.select("claim_id", "text").distinct(), ["claim_id", "text"], "left_anti")
    both = had.select(*first.columns).unionByName(fresh.select(*first.columns))
    ranked = stored(V.triage(both, k=config.k, threshold=config.threshold).drop("rn"), "evidence")
    two = stored(score(todo, ranked, config), "pass2").join(again, "claim_id").withColumn("pass", F.lit(2))
    heard = dialogue.debate(todo.join(again.where(does("debate")), "claim_id", "left_semi"), ranked, config.talker).select("claim_id", "verdict")
    two = two.join(heard, "claim_id", "left").withColumn("ESS", F.coalesce("verdict.support_score", "ESS")).withColumn("ECS", F.coalesce("verdict.contradiction_score", "ECS"))
    e = X.evidence_score({k: F.col(k) for k in L.EVIDENCE_METRICS})
    cs = X.claim_score(*(F.col(k) for k in ("CMS", "HLS", "LCS", "CScope")))
    post = F.when(F.col("verdict").isNull(), F.col("credibility")).otherwise(M.shrink(F.greatest(F.lit(1), F.col("n")), X.penalised(e, F.col("variances.evidence_variance")), cs))
    two = two.withColumn("credibility_post_debate", post)
    return one.join(again, "claim_id", "left_anti").unionByName(two.select(*one.columns))
