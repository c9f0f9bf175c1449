"""Prompts and the operators that send them: entities, rephrasing, debate, adjudication, claim generation, summaries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import math as M
from evidentia.functions import text as T
from evidentia.operators import judges as J
from evidentia.plans.providers import Judge, replies

#: Ways in which a claim can stand to its evidence.
MODES = ("well_supported", "contradictory", "unsupported", "ambiguous")

PROMPTS = {
    "entities": "Name the companies, products, measures and dates of this claim as a JSON list in <json> tags.\nClaim: {claim}",
    "rephrase": "Say this claim again in one plain sentence that can be checked. Keep names and numbers.\nClaim: {claim}",
    "pro": "Argue for the claim from this evidence alone. Answer as JSON with the key argument.\nClaim: {claim}\nEvidence:\n{evidence}",
    "con": "Argue against the claim from this evidence alone. Answer as JSON with the key argument.\nClaim: {claim}\nEvidence:\n{evidence}",
    "adjudicate": "Weigh both sides. Answer as JSON in <json> tags with support_score, contradiction_score and confidence from 0 to 1.\nClaim: {claim}\nFor: {pro}\nAgainst: {con}",
    "generate": "Write one claim about {company} that is {mode} by this evidence.\n{evidence}",
    "overview": "Sum up in two or three sentences how credible the claim is, what supports or contradicts it and what is unsure.\nClaim: {claim}\nMetrics: {metrics}\nCredibility: {credibility}",
    "followup": "Answer this {kind} question about an evaluated claim.\nQuestion: {question}\nClaim: {claim}\nMetrics: {metrics}\nEvidence:\n{evidence}",
}


def prompt(name: str, **parts: Column) -> Column:
    """A template with columns for its fields; null as empty."""
    out, at, text = [], 0, PROMPTS[name]
    while (start := text.find("{", at)) >= 0:
        end = text.index("}", start)
        out += [F.lit(text[at:start]), F.coalesce(parts[text[start + 1 : end]].cast("string"), F.lit(""))]
        at = end + 1
    return F.concat(*out, F.lit(text[at:]))


class HashTalker:
    """Replies from a digest of the prompt: scores for an adjudication, an argument or a list, else a sentence."""

    name = "talker"

    def chat(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for text in prompts:
            raw = hashlib.sha256(text.encode()).digest()
            if text.startswith("Weigh"):
                out.append(f"<json>{json.dumps({'support_score': raw[0] / 255, 'contradiction_score': raw[1] / 255, 'confidence': raw[2] / 255})}</json>")
            elif text.startswith("Argue"):
                out.append(json.dumps({"argument": f"point {raw.hex()[:8]}"}))
            elif text.startswith("Name"):
                words = [w.strip(".,") for w in text.split("Claim: ", 1)[1].split() if w[:1].isupper()]
                out.append(f"<json>{json.dumps(words)}</json>")
            elif text.startswith("Say"):
                out.append(text.split("Claim: ", 1)[1])
            else:
                out.append(f"A statement with the number {raw.hex()[:12]} in it.")
        return out


def ask(df: DataFrame, column: Column, model: Judge, name: str) -> DataFrame:
    """Adds the model's reply to a prompt; null if this call fails after retries."""
    asked = df.withColumn("_prompt", column)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame.pop("_prompt").tolist()
            yield frame.assign(**{name: replies(model, prompts)})

    return asked.mapInPandas(run, shape)


def resolve_entities(claims: DataFrame, texts: Column, model: Judge | None = None) -> DataFrame:
    """Adds ``entities``: sorted, of the extractor and, where these are few or the claim is vague, of the model.

    A model's entity counts only if it stands as whole words in the claim or in one of ``texts``, an array column.
    """
    base = claims.withColumn("entities", F.array_sort(F.array_distinct(F.transform(T.entities_of(F.col("claim")), T.entity_norm))))
    if model is None:
        return base
    need = base.withColumn("_texts", texts).withColumn("_need", T.needs_model(F.col("claim"), F.col("entities")))
    told = ask(need.where("_need"), prompt("entities", claim=F.col("claim")), model, "_reply")
    listed = F.filter(F.transform(M.json_list(F.regexp_extract("_reply", r"(?s)<json>(.*?)</json>", 1)), T.entity_norm), lambda e: e != "")
    seen = F.filter(listed, lambda e: T.in_text(e, F.col("claim")) | F.exists(F.coalesce("_texts", F.array().cast("array<string>")), lambda t: T.in_text(e, t)))
    told = told.withColumn("entities", F.array_sort(F.array_union("entities", F.coalesce(seen, F.array().cast("array<string>"))))).drop("_texts", "_need", "_reply")
    return told.unionByName(need.where("not coalesce(_need, false)").drop("_texts", "_need"))


def rephrase(claims: DataFrame, which: Column, model: Judge) -> DataFrame:
    """The claims, those of ``which`` in the model's words."""
    told = ask(claims.where(which), prompt("rephrase", claim=F.col("claim")), model, "_reply")
    told = told.withColumn("claim", F.coalesce(T.filled(T.strip(F.col("_reply"))), F.col("claim"))).drop("_reply")
    return told.unionByName(claims.where(~F.coalesce(which, F.lit(False))))


def debate(claims: DataFrame, evidence: DataFrame, model: Judge) -> DataFrame:
    """claim_id and verdict (support_score, contradiction_score, confidence) after a plea for and one against.

    A claim has at most the triaged handful of evidence, so its texts fit one row.
    """
    texts = evidence.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ev_ord", "text"))), lambda e: e.text), "\n").alias("evidence"))
    rows = claims.select("claim_id", "claim").join(texts, "claim_id", "left")
    parts = {"claim": F.col("claim"), "evidence": F.col("evidence")}
    for side in ("pro", "con"):
        rows = ask(rows, prompt(side, **parts), model, f"_{side}").withColumn(side, F.coalesce(J.argument(F.col(f"_{side}")), F.lit("")))
    told = ask(rows, prompt("adjudicate", claim=F.col("claim"), pro=F.col("pro"), con=F.col("con")), model, "_reply")
    return told.select("claim_id", "pro", "con", J.adjudication(F.col("_reply")).alias("verdict"))


def generate_claims(examples: DataFrame, model: Judge, modes: Sequence[str] = MODES) -> DataFrame:
    """One row per nested example and mode whose generated claim is valid, with the mode as label."""
    each = examples.withColumn("label", F.explode(F.array(*map(F.lit, modes))))
    shown = F.array_join(F.transform("evidence", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(e.text, 1, 300))), "\n")
    told = ask(each, prompt("generate", company=F.col("company_name"), mode=F.col("label"), evidence=shown), model, "claim")
    return told.where(T.valid_claim(F.col("claim")))


def overview(results: DataFrame, model: Judge) -> DataFrame:
    return ask(results, prompt("overview", claim=F.col("claim"), metrics=F.to_json("metrics"), credibility=F.format_string("%.3f", "credibility")), model, "overview")


def follow_up(questions: DataFrame, model: Judge) -> DataFrame:
    """Answers of (question, claim, metrics map, context); the question's class goes into the prompt."""
    rows = questions.withColumn("kind", T.question_class(F.col("question")))
    return ask(rows, prompt("followup", kind=F.col("kind"), question=F.col("question"), claim=F.col("claim"), metrics=F.to_json("metrics"), evidence=F.col("context")), model, "answer")
