"""Deterministic metrics of claims in bulk: one grouped aggregation over (claim, evidence) rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import lexicons as L
from evidentia.functions import dates as D
from evidentia.functions import math as M


def weighted(value: Column, weight: Column) -> Column:
    """Sum of value * weight over the sum of weights and a little; 0 for none."""
    return F.coalesce(F.sum(value * weight) / (F.sum(weight) + L.EPS), F.lit(0.0))


def recency(claim_at: Column, evidence_at: Column, half_life: float = 90.0) -> Column:
    d = D.decay(claim_at, evidence_at, half_life)
    return M.clip01(F.coalesce(F.avg(d), F.lit(0.5)) * (0.7 + 0.3 * F.count(d) / F.count("*")))


def known_share(kind: Column) -> Column:
    return F.count_if(kind != "unknown") / F.count("*")


def source_trust(relevance: Column, kind: Column) -> Column:
    return M.clip01(F.sum(relevance * M.source_weight(kind)) / (F.sum(relevance) + L.EPS) * known_share(kind))


def source_diversity(domain: Column) -> Column:
    valid = F.when((domain != "") & (domain != "unknown"), domain)
    n = F.count(valid)
    spread = 0.8 * (F.count_distinct(valid) / F.greatest(F.lit(1), n)) * (n / F.count("*")) + 0.2 * F.count_distinct(domain) / F.count("*")
    return F.when(n > 0, spread).otherwise(F.lit(0.0))


def verifiability(kind: Column) -> Column:
    return F.avg(M.verifiable(kind)) * known_share(kind)


def agreement(value: Column) -> Column:
    return F.coalesce(1 - F.var_pop(value), F.lit(0.0))


def evidence_metrics(evidence: DataFrame, key: str = "claim_id", half_life: float = 90.0) -> DataFrame:
    """n, EAS, ERS, ESTS, SDS, EVS per claim of rows with claim_time, timestamp, relevance, source_type, domain."""
    return evidence.groupBy(key).agg(
        F.count("*").alias("n"),
        M.evidence_amount(F.count("*")).alias("EAS"),
        recency(F.col("claim_time"), F.col("timestamp"), half_life).alias("ERS"),
        source_trust(F.col("relevance"), F.col("source_type")).alias("ESTS"),
        source_diversity(F.col("domain")).alias("SDS"),
        verifiability(F.col("source_type")).alias("EVS"),
    )


def baseline_scores(pairs: DataFrame, key: str = "claim_id", antonyms=L.ANTONYMS, negations: Sequence[str] = L.NEGATIONS) -> DataFrame:
    """ESS, ECS and EAGS per claim of rows with c_tokens, e_tokens, c_entities, e_entities, relevance."""
    args = [F.col(c) for c in ("c_tokens", "e_tokens", "c_entities", "e_entities")]
    return mean_scores(pairs, key, M.support(*args), M.contradiction(*args, antonyms, negations))


def mean_scores(pairs: DataFrame, key: str, support: Column, contradiction: Column) -> DataFrame:
    """ESS, ECS and EAGS per claim of rows with relevance."""
    scored = pairs.select(key, "relevance", support.alias("s"), contradiction.alias("c"))
    return scored.groupBy(key).agg(weighted(F.col("s"), F.col("relevance")).alias("ESS"), weighted(F.col("c"), F.col("relevance")).alias("ECS"), agreement(F.col("s")).alias("EAGS"))


def claim_metrics(claims: DataFrame, hedges: Sequence[str] = L.HEDGES) -> DataFrame:
    """CMS, HLS and CScope of rows with tokens and entities."""
    return claims.withColumn("CMS", M.measurable(F.col("entities"))).withColumn("HLS", M.hedging(F.col("tokens"), hedges)).withColumn("CScope", M.claim_scope(F.size("entities")))


def _words(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.array_distinct(F.split(F.trim(F.lower(F.coalesce(s, F.lit("")))), r"\s+")))


def coherence(sentences: Column, entities: Column, antonyms=L.ANTONYMS, negations: Sequence[str] = L.NEGATIONS) -> Column:
    """LCS: one less the mean contradiction over pairs of a claim's sentences; 1 for fewer than two.

    A claim's own sentences stay in one row as an array, so pairs need no join; only their sum is held.  For claims of
    few sentences; ``long_coherence`` takes any number.
    """
    words = _words(sentences)
    score = lambda a, b: M.contradiction(a, b, entities, entities, antonyms, negations)
    rest = lambda at: F.slice(words, at + 2, F.size(words))
    step = lambda z, a: F.struct((z["at"] + 1).alias("at"), F.aggregate(rest(z["at"]), z["sum"], lambda s, b: s + score(a, b)).alias("sum"))
    total = F.aggregate(words, F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")), step)["sum"]
    mean = total / (F.size(words) * (F.size(words) - 1) / 2 + L.EPS)
    return F.when(F.coalesce(F.size(words), F.lit(0)) < 2, F.lit(1.0)).otherwise(1 - mean)


#: Bytes of sentences that are summed at once, unless one claim has more.
SLICE_BYTES = 2 << 20


def pair_sums(claims: pa.Array, opposites: Sequence[tuple[str, str]], negations: Sequence[str]) -> np.ndarray:
    """Of each list of sentences, in lower case, the sum of contradictions over its pairs, for equal entities.

    Tokens are numbers in the order of token, claim and sentence; what stands before one in its group are running sums.
    """
    lengths = pc.fill_null(pc.list_value_length(claims), 0).to_numpy(zero_copy_only=False)
    out, many = np.zeros(len(claims)), int(lengths.sum())
    if not many:
        return out
    split = pc.ascii_split_whitespace(claims.flatten())
    coded = split.flatten().dictionary_encode()
    sentence = np.repeat(np.arange(many), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    keys = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + sentence)
    keys = keys[np.diff(keys, prepend=-1) > 0]  # a sentence's tokens count once
    token = keys // many
    sentence = keys - token * many
    claim = np.repeat(np.arange(len(claims)), lengths)[sentence]
    size = np.maximum(1, np.bincount(sentence, minlength=many))
    first = np.concatenate([[True], (token[1:] != token[:-1]) | (claim[1:] != claim[:-1])])
    start = np.flatnonzero(first)[np.cumsum(first) - 1]

    marks = sorted({*negations, *(x for pair in opposites for x in pair)})
    codes = dict(zip(marks, pc.index_in(pa.array(marks, coded.dictionary.type), value_set=coded.dictionary).to_pylist(), strict=True))

    def having(words: Sequence[str]) -> np.ndarray:
        found = np.zeros(many, bool)
        for code in (codes[w] for w in words if codes[w] is not None):
            found[sentence[slice(*np.searchsorted(keys, (code * many, (code + 1) * many)))]] = True
        return found

    kinds = [(0.3 / size, having(negations)), *((having([x]) * 0.7 / size**2, having([y])) for x, y in opposites)]
    for weight, second in kinds:
        if second.any() and weight.any():
            before = np.concatenate([[0.0], np.cumsum(weight[sentence])])
            at = np.flatnonzero(second[sentence])
            out += np.bincount(claim[at], before[at] - before[start[at]], minlength=len(claims))
    return out


def long_coherence(sentences: Column, entities: Column, antonyms=L.ANTONYMS, negations: Sequence[str] = L.NEGATIONS) -> Column:
    """LCS as ``coherence`` has it, for claims of any number of sentences: no pair is formed.

    The contradiction of two sentences is a sum over the tokens they share, and over the opposites that stand one in
    each (or a negation in the second), of what the first weighs.  So running sums of these weights, by opposites and
    token, in the order of sentences, give the sum over all pairs.  Time and memory grow with a claim's tokens; a null
    sentence is an empty one.  The sentences are worked out once: their number is counted where the sums are.
    """
    both = [p for x, y in antonyms for p in ((x, y), (y, x))]
    negative = sorted(set(negations))

    @F.arrow_udf("double")
    def mean_of_pairs(claims: pa.Array) -> pa.Array:
        size = max(1, len(claims) * SLICE_BYTES // max(1, claims.nbytes))
        n = pc.fill_null(pc.list_value_length(claims), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([np.zeros(0), *(pair_sums(claims[at : at + size], both, negative) for at in range(0, len(claims), size))])
        return pa.array(sums / (n * (n - 1) / 2 + L.EPS), pa.float64(), mask=n < 2)

    mean = mean_of_pairs(F.transform(sentences, lambda s: F.trim(F.lower(F.coalesce(s, F.lit(""))))))
    return F.when(mean.isNull(), F.lit(1.0)).otherwise(1 - (0.1 + 0.9 * M.overlap(entities, entities)) * mean)


def claim_score(cms: Column, hls: Column, lcs: Column, scope: Column, clip: bool = True) -> Column:
    mean = (cms + (1 - hls) + lcs + scope) / 4
    return M.clip01(mean) if clip else mean


def evidence_score(m: dict[str, Column], clip: bool = True) -> Column:
    mean = sum(((1 - m[k]) if k == "ECS" else m[k]) for k in L.EVIDENCE_METRICS) / len(L.EVIDENCE_METRICS)
    return M.clip01(mean) if clip else mean


def evidence_variance(v_ess: Column, v_ecs: Column) -> Column:
    return (v_ess + v_ecs) / len(L.EVIDENCE_METRICS)


def penalised(score: Column, variance: Column) -> Column:
    return score * F.exp(-variance)
