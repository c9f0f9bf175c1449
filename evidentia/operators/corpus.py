"""Companies, filings, facts and news as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia import lexicons as L
from evidentia import schemas as S
from evidentia.functions import text as T

#: Bytes of aliases that one automaton may hold.
ALIAS_BYTES = 16 << 20


def in_ranges(code: Column, ranges=L.TECH_SIC_RANGES) -> Column:
    """Whether a code, read as a number, lies in one of the closed ranges; false for what is no number."""
    n = code.try_cast("int")
    return F.coalesce(T.any_of([n.between(a, b) for a, b in ranges]), F.lit(False))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Of rows with the same keys (nulls are equal), the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def tickers(json: DataFrame, column: str = "json") -> DataFrame:
    """cik, ticker and company_name rows of a JSON object whose values are the rows."""
    row = F.explode(F.map_values(F.from_json(F.col(column), S.TICKERS_JSON)))
    return json.select(row.alias("r")).select(T.cik10(F.col("r.cik_str")).alias("cik"), F.upper(F.col("r.ticker")).alias("ticker"), F.col("r.title").alias("company_name"))


def tech_companies(companies: DataFrame, manual: Sequence[str] = L.MANUAL_TICKERS, ranges=L.TECH_SIC_RANGES) -> DataFrame:
    """Companies by industry code, then those by ticker; a company in both counts by its code."""
    coded = companies.where(in_ranges(F.col("sic"), ranges)).withColumn("manual_include", F.lit(False))
    named = companies.where(F.col("ticker").isin(*manual)).withColumn("manual_include", F.lit(True))
    both = coded.unionByName(named, allowMissingColumns=True)
    return keep_first(both, ["cik"], [F.col("manual_include"), F.col("ticker").asc_nulls_last()]).withColumn("industry_group", F.lit("technology"))


def filings(submissions: DataFrame, first: str, last: str, form: str = "10-K") -> DataFrame:
    """One row per filing of the parallel arrays of (cik, json), of a form and a closed range of ISO dates.  Arrays that
    are shorter or missing give nulls."""
    r = F.from_json("json", S.SUBMISSIONS_JSON).getField("filings").getField("recent")
    names = {"form": "form_type", "accessionNumber": "accession_number", "filingDate": "filing_date", "reportDate": "report_date", "primaryDocument": "primary_document", "primaryDocDescription": "primary_doc_description"}
    rows = submissions.select("cik", F.explode(F.arrays_zip(*(F.coalesce(r.getField(n), F.array().cast("array<string>")).alias(n) for n in names))).alias("x")).select("cik", *(F.col(f"x.{n}").alias(a) for n, a in names.items()))
    bare = F.replace("accession_number", F.lit("-"), F.lit(""))
    folder = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"), F.lit("/"), bare)
    kept = rows.where((F.col("form_type") == form) & F.col("filing_date").between(first, last))
    return kept.withColumn("filing_folder_url", folder).withColumn("index_url", F.concat(folder, F.lit("/"), F.col("accession_number"), F.lit("-index.html"))).dropDuplicates(["cik", "accession_number"])


def company_facts(facts: DataFrame, concepts: Sequence[str] = L.CONCEPTS, first: int = 2020, last: int = 2025) -> DataFrame:
    """Full-year USD facts of (cik, ticker, json): the listed concepts, fiscal years first to last."""
    concept = F.explode(F.map_entries(F.map_filter(F.from_json("json", S.COMPANY_FACTS_JSON).getField("facts").getField("us-gaap"), lambda k, _: k.isin(*concepts))))
    unit = facts.select("cik", "ticker", concept.alias("c")).select("cik", "ticker", F.col("c.key").alias("concept"), F.explode(F.try_element_at(F.col("c.value.units"), F.lit("USD"))).alias("u"))
    kept = unit.where((F.col("u.fp") == "FY") & F.col("u.fy").between(first, last))
    return kept.select("cik", "ticker", "concept", F.col("u.val").alias("value"), F.col("u.fy").alias("fy"), F.col("u.form").alias("form"), F.col("u.filed").alias("filed"), F.col("u.end").alias("end_date"), F.col("u.accn").alias("accession_number"))


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key, each value of the last row in ``order`` in which it is not null."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values))


def sections(pages: DataFrame, form: str = "10-K", cutoff: int = 250_000, least: int = 2000) -> DataFrame:
    """Filings with their discussion section, where one is found in ``html``."""
    return pages.withColumn("mdna_text", T.section(T.html_lines(F.col("html")), form, cutoff, least)).where(F.col("mdna_text").isNotNull()).drop("html").withColumn("section", F.lit("MD&A")).withColumn("mdna_chars", F.length("mdna_text"))


def facts_of(documents: DataFrame, column: str, rules: dict | None = None, least: int = 80, most: int = 900, noise: Column | None = None, negative=L.NEGATIVE_CUES, positive=L.POSITIVE_CUES) -> DataFrame:
    """One row per sentence that a fact rule matches, with its number among the kept-length sentences."""
    rows = documents.select("*", F.posexplode(T.sentences(F.col(column), least, most)).alias("sent_index", "evidence_text")).drop(column)
    s = F.col("evidence_text")
    kept = rows.where(~(T.noise_sentence(s) if noise is None else noise)).withColumn("fact_type", T.fact_type(s, rules)).where(F.col("fact_type").isNotNull())
    return kept.withColumn("direction", T.direction(s, negative, positive))


def dedupe_facts(facts: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first of facts whose text is the same in lower case and white space.  Texts meet by a 256-bit digest."""
    return keep_first(facts.withColumn("_norm", F.sha2(T.collapse(F.lower("evidence_text")), 256)), [*keys, "_norm"], order).drop("_norm")


def with_reliability(articles: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Left lookup by domain; of a domain's labels, the last in ``order`` counts."""
    last = labels.groupBy("domain").agg(*(F.max_by(c, order).alias(c) for c in labels.columns if c not in ("domain", order)))
    return articles.join(last, "domain", "left")


def _found_aliases(padded: DataFrame, key: str, aliases: list[str]) -> DataFrame:
    """(key, _alias) for each alias that a text holds between spaces: one pass over each text by an automaton."""
    sent = padded.sparkSession.sparkContext.broadcast(aliases)
    kind = padded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, alias in enumerate(sent.value):
            automaton.add_word(f" {alias} ", i)
        automaton.make_automaton()
        for batch in batches:
            at, which = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = {i for _, i in automaton.iter(text)} if text else ()
                at += [row] * len(found)
                which += found
            names = pa.array([sent.value[i] for i in which], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), names], [key, "_alias"])

    return padded.mapInArrow(run, f"`{key}` {kind.simpleString()}, _alias string")


def company_mentions(articles: DataFrame, companies: DataFrame, key: str, text: Column) -> DataFrame:
    """Distinct (key, company) pairs where an alias stands in the text as whole words.

    Aliases go to the tasks in shards of at most ALIAS_BYTES, each an automaton that reads a text once; only found pairs
    are shuffled.  Texts of one key count as one.
    """
    names = companies.select(*companies.columns, F.explode(T.company_aliases(F.col("company_name"))).alias("_alias")).where("_alias <> ''")
    size = names.agg(F.coalesce(F.sum(F.length("_alias") + 2), F.lit(0))).first()[0]
    padded = articles.select(F.col(key), F.concat(F.lit(" "), T.company_norm(text), F.lit(" ")).alias("_text"))
    shards = max(1, -(-size // ALIAS_BYTES))
    found = None
    for shard in range(shards):
        some = names.select("_alias").distinct().where(F.pmod(F.xxhash64("_alias"), F.lit(shards)) == shard)
        part = _found_aliases(padded, key, sorted(r[0] for r in some.collect()))  # about ALIAS_BYTES
        found = part if found is None else found.unionByName(part)
    return found.distinct().join(names, "_alias").select(key, *companies.columns).distinct()


def word_mentions(texts: DataFrame, words: DataFrame, key: str, text: Column, word: str) -> DataFrame:
    """Distinct (key, row of ``words``) pairs where the word, of letters, digits and underscores, stands by itself in
    the text, in any case: an equi-join of words with the texts' distinct words."""
    own = texts.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("_word"))
    return own.join(words.withColumn("_word", F.lower(word)).where(F.length("_word") > 0), "_word").select(key, *words.columns).distinct()


def token_pairs(claims: DataFrame, texts: DataFrame, claim: str, key: str, claim_tokens: str, text_tokens: str) -> DataFrame:
    """(claim, key) pairs of a claim and a text that share a token, by an equi-join on tokens.

    All other pairs have support and contradiction scores of 0.  Pairs are made distinct before the shuffle as well.
    """
    a = claims.select(claim, F.explode(F.array_distinct(claim_tokens)).alias("_token"))
    b = texts.select(key, F.explode(F.array_distinct(text_tokens)).alias("_token"))
    return b.join(a, "_token").select(claim, key).distinct()


def select_present(df: DataFrame, front: Sequence[str]) -> DataFrame:
    """Columns of ``front`` that are there first, then the rest in their order."""
    return df.select(*(c for c in front if c in df.columns), *(c for c in df.columns if c not in front))


def with_primary_document(filed: DataFrame) -> DataFrame:
    """Filings that name a document, with its address."""
    named = filed.where(F.length(T.strip(F.coalesce("primary_document", F.lit("")))) > 0)
    return named.withColumn("source_url", F.concat("filing_folder_url", F.lit("/"), "primary_document"))


def about(articles: DataFrame, company: str) -> DataFrame:
    """Articles whose title or text holds the name, in any case; all articles for the name "all"."""
    if company.lower() == "all":
        return articles
    found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(company.lower())) for c in ("title", "text")]
    return articles.where(T.any_of(found))


def combined(mdna: DataFrame, news: DataFrame, companies: DataFrame) -> DataFrame:
    """Facts and news in one table: tickers in upper case, names looked up, rows without ticker or text dropped, and of
    rows that are the same in all columns one."""
    names = ("ticker", "company_name", "evidence_text", "form_type", "filing_date", "source_url")
    table = companies.select(F.upper(T.strip(F.col("ticker"))).alias("ticker"), F.col("company_name").alias("_name")).groupBy("ticker").agg(F.min("_name").alias("_name"))

    def shaped(df: DataFrame) -> DataFrame:
        have = df.withColumn("ticker", F.upper(T.strip(F.col("ticker"))))
        for c in names:
            have = have if c in have.columns else have.withColumn(c, F.lit(None).cast("string"))
        return have.select(*names)

    rows = shaped(mdna).unionByName(shaped(news)).where(F.col("ticker").isNotNull() & F.col("evidence_text").isNotNull())
    return rows.join(table, "ticker", "left").withColumn("company_name", F.coalesce("company_name", "_name")).select(*names).distinct()
