"""Numbers, vectors and judge replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia import lexicons as L


def clip01(x: Column) -> Column:
    """Within 0 and 1; NaN as 0, null as null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + L.EPS)


def relevance(cos: Column) -> Column:
    return (1 + cos) / 2


def overlap(a: Column, b: Column) -> Column:
    """The share of a's members that b has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


def share(n: Column, of: Column) -> Column:
    return n / F.greatest(F.lit(1), of)


def support_of(shared: Column, n_tokens: Column, named: Column, n_entities: Column) -> Column:
    """``support`` from counts of what a text holds of the claim's tokens and entities."""
    return 0.5 * share(shared, n_tokens) + 0.5 * share(named, n_entities)


def contradiction_of(shared: Column, n_tokens: Column, named: Column, n_entities: Column, opposed: Column, negated: Column) -> Column:
    """``contradiction`` from counts, of opposites too, and whether the text has a negation."""
    against = 0.7 * share(opposed, n_tokens) + 0.3 * F.coalesce(negated.cast("double"), F.lit(0.0))
    return (0.1 + 0.9 * share(named, n_entities)) * against * share(shared, n_tokens)


def support(claim_tokens: Column, evidence_tokens: Column, claim_entities: Column, evidence_entities: Column) -> Column:
    return 0.5 * overlap(claim_tokens, evidence_tokens) + 0.5 * overlap(claim_entities, evidence_entities)


def antonym_pairs(a: Column, b: Column, antonyms: Sequence[tuple[str, str]] = L.ANTONYMS) -> Column:
    """Pairs of opposites, one word in a and one in b, read in both directions of the table.

    Few words of a text have opposites: these are found by a hash lookup before the table is looked at.
    """
    opposites: dict[str, list[str]] = {}
    for x, y in antonyms:
        opposites.setdefault(x, []).append(y)
    words = F.array(*map(F.lit, opposites))
    table = F.create_map(*(c for x, ys in opposites.items() for c in (F.lit(x), F.array(*map(F.lit, ys)))))
    count = lambda p, q: F.size(F.filter(F.flatten(F.transform(F.array_intersect(p, words), lambda x: F.element_at(table, x))), lambda y: F.array_contains(q, y)))
    return count(a, b) + count(b, a)


def contradiction(claim_tokens: Column, evidence_tokens: Column, claim_entities: Column, evidence_entities: Column, antonyms=L.ANTONYMS, negations: Sequence[str] = L.NEGATIONS) -> Column:
    opposed = antonym_pairs(claim_tokens, evidence_tokens, antonyms) / F.greatest(F.lit(1), F.size(claim_tokens))
    negated = F.arrays_overlap(evidence_tokens, F.array(*map(F.lit, negations))).cast("double")
    about = 0.1 + 0.9 * overlap(claim_entities, evidence_entities)
    return about * (0.7 * opposed + 0.3 * F.coalesce(negated, F.lit(0.0))) * overlap(claim_tokens, evidence_tokens)


def shrink(n: Column, evidence_score: Column, claim_score: Column, k: float = 5.0) -> Column:
    """Credibility: the evidence score counts more, the more evidence there is."""
    share = n / (n + k)
    return share * evidence_score + (1 - share) * claim_score


def source_weight(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for item in L.SOURCE_WEIGHTS.items() for x in item))
    return F.coalesce(F.try_element_at(table, kind), F.lit(L.DEFAULT_SOURCE_WEIGHT))


def verifiable(kind: Column) -> Column:
    return F.coalesce(kind.isin(*L.VERIFIABLE), F.lit(False)).cast("int")


def evidence_amount(n: Column, k: float = 5.0) -> Column:
    return 1 - F.exp(-n / F.lit(float(k)))


def claim_scope(n_entities: Column) -> Column:
    return 1 / (1 + F.log1p(n_entities.cast("double")))


def hedging(tokens: Column, hedges: Sequence[str] = L.HEDGES) -> Column:
    """The share of hedge words; 1 for a claim without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.array_intersect(tokens, F.array(*map(F.lit, hedges)))) / F.size(tokens)).otherwise(F.lit(1.0))


def measurable(entities: Column) -> Column:
    """The share of entities with a digit."""
    return F.size(F.filter(entities, lambda e: e.rlike(r"\p{Nd}"))) / F.greatest(F.lit(1), F.size(entities))


def json_block(reply: Column) -> Column:
    """A model's JSON: between json tags, else from the first brace to the last; null if it does not parse."""
    tagged = F.regexp_extract(reply, r"(?s)<json>(.*?)</json>", 1)
    body = F.when(F.contains(reply, F.lit("<json>")) & reply.rlike(r"(?s)<json>.*?</json>"), F.trim(tagged)).otherwise(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    return F.when(is_json(body), body)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and no more.

    The parser stops after a value and overlooks what follows.  Only a text that is one whole value is both an element
    of a list and the value of a key.
    """
    element, value = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))
    some = F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))
    return some & F.try_parse_json(element).isNotNull() & F.try_parse_json(value).isNotNull()


def tagged_json(reply: Column) -> Column:
    """A model's JSON between json tags, else the whole reply, without a look for braces; null if it does not parse."""
    inner = F.regexp_extract(reply, r"(?s)<json>(.*?)</json>", 1)
    body = F.when(reply.rlike(r"(?s)<json>.*?</json>"), inner).otherwise(reply)
    return F.when(is_json(body), F.trim(body))


def json_after_tag(reply: Column) -> Column:
    """(json, error, raw): what follows the last opening json tag, or all of a reply without one.  A closing tag after
    it is no JSON, so that such a reply is an error with its raw text."""
    body = F.element_at(F.split(reply, "<json>", -1), -1)
    good = is_json(body)
    return F.struct(F.when(good, F.trim(body)).alias("json"), (~good).alias("error"), F.when(~good, reply).alias("raw"))


def judge_metric(reply_json: Column, metric: str) -> Column:
    """score and confidence, clipped.  Takes {metric: {score, confidence}} and {metric: number} (confidence 0.5);
    what is missing or no number counts 0."""
    v = F.try_parse_json(reply_json)
    num = lambda path: F.try_variant_get(v, path, "double")
    bare = num(f"$.{metric}")
    score = F.coalesce(num(f"$.{metric}.score"), bare, F.lit(0.0))
    sure = F.coalesce(num(f"$.{metric}.confidence"), F.when(bare.isNotNull(), F.lit(0.5)), F.lit(0.0))
    return F.struct(clip01(score).alias("score"), clip01(sure).alias("confidence"))


def json_list(reply: Column) -> Column:
    """A model's list of strings: the whole reply, else from the first bracket to the last; else empty."""
    whole, inner = F.from_json(reply, "array<string>"), F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<string>")
    return F.coalesce(whole, inner, F.array().cast("array<string>"))
