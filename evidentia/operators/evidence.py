"""From rows to documents, chunks, matches and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import schemas as S
from evidentia.functions import dates as D
from evidentia.functions import text as T


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def document_texts(rows: DataFrame) -> DataFrame:
    """Rows with s3_key and row_index, the payload's strings and doc_text, also where it says nothing.

    The text is evidence_text or text, else the title; a title that the text does not hold stands before it.
    """
    body = T.filled(T.payload_value(_column(rows, "evidence_text")), T.payload_value(_column(rows, "text")))
    title = T.payload_value(_column(rows, "title"))
    text = F.when(body.isNull(), title).when((title != "") & ~F.contains(body, title), F.concat(title, F.lit("\n\n"), body)).otherwise(body)
    payload = [T.payload_value(_column(rows, c)).alias(c) for c in S.PAYLOAD]
    return rows.select("s3_key", "row_index", *payload, text.alias("doc_text"))


def documents(rows: DataFrame) -> DataFrame:
    """``document_texts`` without the rows that say nothing."""
    return document_texts(rows).where(~T.noise_text(F.col("doc_text")))


def chunk_id() -> Column:
    return F.sha2(F.concat_ws("|", "s3_key", F.col("row_index").cast("string"), F.col("chunk_index").cast("string")), 256)


def chunked(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """One row per chunk with an id that a second run repeats."""
    rows = docs.select("*", F.posexplode(T.chunks(F.col("doc_text"), size, overlap)).alias("chunk_index", "text")).drop("doc_text")
    return rows.withColumn("chunk_id", chunk_id())


def matches(hits: DataFrame, score: str = "cosine") -> DataFrame:
    """The eight columns of a search result, empty where missing."""
    strings = ("text", "s3_key", "filing_date", "fact_type", "source_url", "news_site")
    keep = [c for c in ("query_id", "claim_id", "rank") if c in hits.columns]
    return hits.select(*keep, *(F.coalesce(_column(hits, c), F.lit("")).alias(c) for c in strings), F.coalesce(F.col(score), F.lit(0.0)).alias("score"), F.coalesce(F.col("chunk_index") if "chunk_index" in hits.columns else F.lit(None), F.lit(0)).cast("int").alias("chunk_index"))


def evidence(found: DataFrame, variant: str = "retrieval") -> DataFrame:
    """Matches to evidence items: text, timestamp, source_type, score, url, domain, relevance.

    ``retrieval`` classifies what no form names; ``gold`` takes the given type, or unknown.  An optional form_type
    column counts before fact_type.
    """
    form = T.filled(_column(found, "form_type"), _column(found, "source_type") if variant == "gold" else _column(found, "fact_type"))
    url, text, site = T.filled(_column(found, "source_url"), _column(found, "url")), _column(found, "text"), _column(found, "news_site")
    other = F.coalesce(form, F.lit("unknown")) if variant == "gold" else T.source_class(url, text)
    kind = F.coalesce(T.form_class(form), other)
    domain = F.coalesce(T.filled(F.lower(site)), F.when(kind == "financial_filing", F.lit("sec.gov")), T.filled(T.web_domain(url)), F.lit("unknown"))
    keys = [c for c in ("claim_id", "query_id", "rank", "ev_ord") if c in found.columns]
    score = F.col("score") if "score" in found.columns else F.lit(None).cast("double")
    return found.where(F.length(text) > 0).select(*keys, text.alias("text"), D.timestamp(T.filled(_column(found, "filing_date"), _column(found, "date"))).alias("timestamp"), kind.alias("source_type"), score.alias("score"), url.alias("url"), domain.alias("domain"), F.coalesce(score, F.lit(0.5)).alias("relevance"))


def inputs(items: DataFrame) -> DataFrame:
    """Evidence with the defaults that the metrics take."""
    return items.withColumn("domain", F.coalesce(T.filled(F.col("domain")), F.lit("unknown"))).withColumn("relevance", F.coalesce("relevance", F.lit(0.5))).withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))


def context(items: DataFrame, key: str, order: str, most: int = 5, chars: int = 300) -> DataFrame:
    """One numbered text per key of its first ``most`` items, each cut to ``chars`` characters."""
    line = F.struct(F.col(order).alias("o"), F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("t"), F.coalesce("url", F.lit("")).alias("u"), F.coalesce("score", F.lit(0.0)).alias("s"))
    got = items.where(F.col(order) <= most).groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("x"))
    shown = F.transform("x", lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e.t, F.lit("\nURL: "), e.u, F.lit("\nScore: "), F.format_string("%.3f", e.s)))
    return got.select(key, F.array_join(shown, "\n\n").alias("context"))


def evidence_counts(ess: Column, ecs: Column, n: Column) -> Column:
    """How many items support and contradict, cut to whole numbers."""
    return F.struct((ess * n).cast("int").alias("supporting"), (ecs * n).cast("int").alias("contradicting"))
