"""Systems against an oracle: metric errors, gaps and gains."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia import lexicons as L
from evidentia.operators import evidence as E
from evidentia.plans import pipeline
from evidentia.tables import stored


def metric_errors(metrics: DataFrame, oracle: str = "oracle", key: str = "claim_id") -> DataFrame:
    """Absolute differences from the oracle on metrics that both have, of (key, system, metric, value)."""
    truth = metrics.where(F.col("system") == oracle).select(key, "metric", F.col("value").alias("truth"))
    return metrics.where(F.col("system") != oracle).join(truth, [key, "metric"]).select(key, "system", "metric", F.abs(F.col("value") - F.col("truth")).alias("error"))


def metric_mae(errors: DataFrame, key: str = "claim_id") -> DataFrame:
    return errors.groupBy(key, "system").agg(F.avg("error").alias("mae"))


def gaps(scores: DataFrame, key: str = "claim_id") -> DataFrame:
    """Oracle less system of rows with oracle, baseline, single and full scores."""
    return scores.select(key, *(F.abs(F.col("oracle") - F.col(s)).alias(f"{s}_gap") for s in ("baseline", "single", "full")))


def report(gap: DataFrame, helped: float = 0.1, failed: float = 0.2) -> DataFrame:
    """One row: mean gaps, what a judge and an escalation gain, failures and how many claims each helped."""
    llm, esc = F.col("baseline_gap") - F.col("single_gap"), F.col("single_gap") - F.col("full_gap")
    return gap.agg(
        F.count("*").alias("n"), *(F.avg(f"{s}_gap").alias(f"{s}_gap") for s in ("baseline", "single", "full")), F.avg(llm).alias("llm_gain"), F.avg(esc).alias("escalation_gain"),
        F.count_if(F.col("full_gap") > failed).alias("failures"), F.count_if(llm > helped).alias("llm_helped"), F.count_if(esc > helped).alias("escalation_helped"),
    )


def gold_evidence(rows: DataFrame) -> DataFrame:
    """Evidence items of a gold table's rows (claim_id, ev_ord, text, ...), all of them, with the metrics' defaults."""
    return E.inputs(E.evidence(rows, "gold"))


def run_modes(claims: DataFrame, gold: DataFrame, chunks: DataFrame, as_of, config: pipeline.Config | None = None) -> DataFrame:
    """claim_id, system, credibility and a map of metrics: the full plan on a claim's gold evidence (oracle), and each
    mode (baseline, single, full) on the evidence that it finds itself."""
    config = config or pipeline.Config()
    names = (*L.EVIDENCE_METRICS, *L.CLAIM_METRICS)
    given = gold_evidence(gold)
    runs = [("oracle", "full", given), ("baseline", "baseline", None), ("single", "single_llm", None), ("full", "full", None)]
    out = None
    for system, mode, own in runs:
        got = pipeline.evaluate(claims, chunks, as_of, replace(config, mode=mode), own)
        rows = got.select("claim_id", F.lit(system).alias("system"), "credibility", F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))).alias("metrics"))
        out = rows if out is None else out.unionByName(rows)
    return stored(out, "modes")


def gold_report(runs: DataFrame) -> DataFrame:
    """One row per claim: each system's score, mean metric error and gap to the oracle."""
    long = runs.select("claim_id", "system", F.explode("metrics").alias("metric", "value"))
    mae = metric_mae(metric_errors(long)).groupBy("claim_id").pivot("system", ["baseline", "single", "full"]).agg(F.first("mae"))
    wide = runs.groupBy("claim_id").pivot("system", ["oracle", "baseline", "single", "full"]).agg(F.first("credibility"))
    errors = mae.select("claim_id", *(F.col(s).alias(f"{s}_mae") for s in ("baseline", "single", "full")))
    return wide.join(errors, "claim_id").join(gaps(wide), "claim_id")
