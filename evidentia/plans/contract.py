"""Queries over the driver's tables, one per operator, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.functions import dates as D
from evidentia.functions import math as M
from evidentia.functions import text as T
from evidentia.operators import corpus, curate, evidence, judges, metrics, pairs, vector
from evidentia.plans import evaluate as ev
from evidentia.session import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (table reader) -> DataFrame under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Common words of the invented texts stand in for the lexicons, whose words do not occur in them.
POS, NEG = ("the", "en", "and"), ("in", "de", "of")
PAIRS = (("the", "of"), ("in", "and"), ("to", "that"))
NEGATED = ("was", "not", "que")
HEDGED = ("is", "en", "of")

#: SQL macros of the text functions.
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) BETWEEN 80 AND 900)"


def _count(word_list: tuple[str, ...], text: str) -> str:
    return rf"len(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN {word_list}))"


@query(rf"""SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(t, CAST(i * 850 + 1 AS BIGINT), 1000) AS chunk FROM (
  SELECT doc_id, {_STRIP.format('text')} AS t, unnest(range(CAST(greatest(0, ceil((length({_STRIP.format('text')}) - 1000) / 850.0)) AS BIGINT) + 1)) AS i FROM documents) WHERE length(t) > 0""")
def q01_chunk_text(t):
    return t("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "chunk")).select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), "chunk")


@query(rf"""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ({_COLLAPSE.format('lower(text)')} IN ('', 'stock quotes, and market data', 'stock quotes and market data')) AS BIGINT) AS noise FROM documents GROUP BY source""")
def q02_noise_filter(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.noise_text(F.col("text"))).alias("noise"))


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS sent_index, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))")
def q03_split_sentences(t):
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", F.col("i").cast("bigint").alias("sent_index"), "sentence")


@query(rf"""SELECT doc_id, length(s) < 120 OR contains(lower(s), 'form 10-k') OR contains(lower(s), 'table shows') OR contains(lower(s), '(dollars in millions)')
  OR length(s) - length(replace(s, '|', '')) > 2 OR len(regexp_extract_all(s, '\d')) > 2 AS noise, s AS sentence FROM (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents)""")
def q04_noise_sentence(t):
    rows = t("documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return rows.withColumn("noise", T.noise_sentence(F.col("sentence"), least=120, digits=2))


@query(f"SELECT doc_id, CASE WHEN {_count(NEG, 'text')} > {_count(POS, 'text')} THEN 'negative' WHEN {_count(POS, 'text')} > {_count(NEG, 'text')} THEN 'positive' ELSE 'neutral' END AS direction FROM documents")
def q05_direction(t):
    return t("documents").select("doc_id", T.direction(F.col("text"), NEG, POS).alias("direction"))


_RULES = {"A": lambda s: T.matches(s, (r"\bwas\b", r"\bthat\b.*\bto\b")), "B": lambda s: F.contains(F.lower(s), F.lit("que")), "C": lambda s: T.holds(F.lower(s), ("the", "der"))}


@query(rf"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS sent_index, f AS fact_type FROM (SELECT doc_id, i, CASE WHEN regexp_matches(s[i], '(?i)\bwas\b') OR regexp_matches(s[i], '(?i)\bthat\b.*\bto\b') THEN 'A'
  WHEN contains(lower(s[i]), 'que') THEN 'B' WHEN contains(lower(s[i]), 'the') OR contains(lower(s[i]), 'der') THEN 'C' END AS f
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)) WHERE length(s[i]) >= 100) WHERE f IS NOT NULL""")
def q06_fact_cascade(t):
    got = corpus.facts_of(t("documents").select("doc_id", "text"), "text", _RULES, noise=F.length("evidence_text") < 100)
    return got.select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "fact_type")


@query(rf"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, {_COLLAPSE.format('lower(text)')}")
def q07_fact_dedup(t):
    return corpus.dedupe_facts(t("documents").withColumnRenamed("text", "evidence_text"), ["lang"], ["doc_id"]).select("doc_id")


_DOMAIN = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^www\.', '')"


@query(rf"SELECT page_id, {_DOMAIN} AS domain, replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), 'www.', '') AS news_domain FROM pages")
def q08_extract_domain(t):
    return t("pages").select("page_id", T.web_domain(F.col("url")).alias("domain"), T.news_domain(F.col("url")).alias("news_domain"))


@query(
    "SELECT page_id, CASE "
    + " ".join(f"WHEN {' OR '.join(f'''contains(lower(url), '{w}')''' for w in words)} THEN '{name}'" for what, words, name in T.L.SOURCE_RULES if what == "url")
    + " "
    + " ".join(f"WHEN {' OR '.join(f'''contains(lower(html), '{w}')''' for w in words)} THEN '{name}'" for what, words, name in T.L.SOURCE_RULES if what == "text")
    + " ELSE 'unknown' END AS source_type FROM pages"
)
def q09_classify_source(t):
    return t("pages").select("page_id", T.source_class(F.col("url"), F.col("html")).alias("source_type"))


_FLAT = "html"
for _tag in ("script", "style", "noscript", "table"):
    _FLAT = rf"regexp_replace({_FLAT}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"
_FLAT = rf"regexp_replace(regexp_replace({_FLAT}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
#: Character references of the tables and some more; those that may lack their semicolon, the ampersand last.
_REFERENCES = (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#0*39;?", "''"), ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"), ("&eacute;?", "\u00e9"), ("&#8217;", "\u2019"), ("&amp;?", "&"))


def _decoded(text: str) -> str:
    for name, char in _REFERENCES:
        text = f"regexp_replace({text}, '{name}', '{char}', 'g')"
    return text


_FLAT = _decoded(_FLAT)


@query(f"SELECT page_id, {_COLLAPSE.format(_FLAT)} AS text FROM pages")
def q10_html_to_text(t):
    return t("pages").select("page_id", T.html_flat(F.col("html")).alias("text"))


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 0.9 ELSE false END AS english FROM documents")
def q11_english_enough(t):
    return t("documents").select("doc_id", T.english_enough(F.col("text"), 0.9).alias("english"))


@query(rf"SELECT doc_id, length({_STRIP.format('text')}) >= 300 AND NOT contains(lower({_STRIP.format('text')}), 'eaux') AS article FROM documents")
def q12_article_gate(t):
    return t("documents").select("doc_id", T.like_article(F.col("text"), 300, ("eaux",)).alias("article"))


@query(rf"""SELECT doc_id, CASE WHEN b = '' THEN l WHEN l <> '' AND NOT contains(b, l) THEN l || chr(10) || chr(10) || b ELSE b END AS doc_text FROM
  (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {_STRIP.format('text')} END AS b, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS l FROM documents)
  WHERE NOT (b = '' AND l = '')""")
def q13_row_to_document(t):
    rows = t("documents").select(F.lit("k").alias("s3_key"), F.col("doc_id").alias("row_index"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("evidence_text"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("title"))
    return evidence.documents(rows).select(F.col("row_index").alias("doc_id"), "doc_text")


@query("""SELECT p_partkey, bool_and(by_hand) AS manual_include FROM (SELECT p_partkey, false AS by_hand FROM part WHERE p_size BETWEEN 5 AND 9 OR p_size BETWEEN 20 AND 24
  UNION ALL SELECT p_partkey, true FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')) GROUP BY p_partkey""")
def q14_tech_range_filter(t):
    parts = t("part").select(F.col("p_partkey").alias("cik"), F.col("p_brand").alias("ticker"), F.col("p_size").cast("string").alias("sic"))
    return corpus.tech_companies(parts, ("Brand#11", "Brand#12", "Brand#13"), ((5, 9), (20, 24))).select(F.col("cik").alias("p_partkey"), "manual_include")


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def q15_cik_pad(t):
    return t("customer").select("c_custkey", T.cik10(F.col("c_custkey")).alias("cik"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q16_left_join_company(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def q17_lookup_default(t):
    known = t("labels").select(F.col("doc_id").alias("domain"), "quality", "toxic", F.lit(1).alias("seq"))
    got = corpus.with_reliability(t("documents").select(F.col("doc_id").alias("domain")), known, "seq")
    return got.select(F.col("domain").alias("doc_id"), F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), "toxic")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)")
def q18_semi_min_group(t):
    return curate.min_group(t("events").select("event_id", "user_id"), "user_id", 70).select("event_id")


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS group_size FROM events")
def q19_group_size_window(t):
    return curate.with_group_size(t("events").select("event_id", "user_id"), "user_id").select("event_id", "group_size")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id < 200 AND o.text = d.text)")
def q20_left_anti_new_evidence(t):
    docs = t("documents")
    return curate.new_rows(docs, docs.where("doc_id < 200"), ["text"]).select("doc_id")


@query("""SELECT DISTINCT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events e WHERE NOT EXISTS
  (SELECT 1 FROM events m WHERE m.user_id < 2 AND m.event_type = e.event_type AND date_trunc('week', m.ts) = date_trunc('week', e.ts))""")
def q21_done_set_skip(t):
    work = t("events").select("event_type", F.date_format(F.trunc("ts", "week"), "yyyy-MM-dd").alias("week"), "user_id")
    done = work.where("user_id < 2").select("event_type", "week", F.lit("done").alias("status"))
    return curate.pending(work.select("event_type", "week").distinct(), done, ["event_type", "week"])


_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""SELECT DISTINCT d.doc_id, b.item_id FROM (SELECT doc_id, ' ' || {_NORM.format('text')} || ' ' AS t FROM documents) d JOIN (SELECT item_id, {_NORM.format("array_to_string(string_split(text, ' ')[1:4], ' ')")} AS a FROM benchmark) b
  ON contains(d.t, ' ' || b.a || ' ') WHERE length(b.a) >= 3""")
def q22_alias_containment(t):
    names = t("benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("company_name"))
    return corpus.company_mentions(t("documents"), names, "doc_id", F.col("text")).select("doc_id", "item_id").distinct()


@query("""SELECT c.name, strftime(s, '%Y-%m-%d') AS week, strftime(least(s + INTERVAL 7 DAY - INTERVAL 1 SECOND, TIMESTAMP '2024-02-29 23:59:59'), '%Y%m%d%H%M%S') AS stop
  FROM (SELECT DISTINCT event_type AS name FROM events) c, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-29 23:59:59', INTERVAL 7 DAY)) AS s)""")
def q23_cross_weeks(t):
    names = t("events").select(F.col("event_type").alias("name")).distinct()
    return names.select("name", F.explode(D.weeks(F.lit("2024-01-15").cast("date"), F.lit("2024-02-03").cast("date"))).alias("w")).select("name", "w.week", "w.stop")


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS fy, arg_max(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 3 <> 0) AS price,
  arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'O') AS priority FROM orders GROUP BY 1, 2""")
def q24_last_non_null(t):
    rows = t("orders").select("o_custkey", F.year("o_orderdate").alias("fy"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("priority"))
    return corpus.last_known(rows, ["o_custkey", "fy"], ["o_orderdate", "o_orderkey"], ["price", "priority"])


@query("SELECT min(doc_id) AS doc_id, CAST(NULL AS VARCHAR) AS note FROM documents WHERE lang = 'en' OR lang = 'fr' GROUP BY text")
def q25_union_by_name_dedupe(t):
    docs = t("documents").select("doc_id", "text", "lang")
    both = curate.union_tables(docs.where("lang = 'en'"), docs.where("lang = 'fr'").withColumn("note", F.lit(None).cast("string")))
    return corpus.keep_first(both, ["text"], ["doc_id"]).select("doc_id", "note")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def q26_value_counts(t):
    return curate.value_counts(t("events"), "event_type")


@query("SELECT CAST(count(*) FILTER (user_id % 7 = 0) AS BIGINT) AS user_id, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS value FROM events")
def q27_null_profile(t):
    return curate.null_profile(t("events").select(F.expr("nullif(user_id, user_id - user_id % 7)").alias("user_id"), "value"), ["user_id", "value"])


@query("""SELECT source, doc_id, n AS original_group_size FROM (SELECT source, doc_id, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|210'), doc_id) AS rn,
  CAST('0x' || substr(md5(source || '|210'), 1, 4) AS BIGINT) AS h FROM documents) WHERE rn <= CASE WHEN n <= 3 THEN n ELSE 3 + h % (least(5, n) - 2) END""")
def q28_stratified_sample(t):
    return curate.stratified_sample(t("documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "original_group_size")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|1'), doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM documents)")
def q29_fraction_sample(t):
    return curate.fraction_sample(t("documents").select("doc_id"), "doc_id")


@query("""SELECT source, CAST(max(n) AS BIGINT) AS original_group_size, CAST(count(*) AS BIGINT) AS sampled_group_size, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM
  (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|210'), doc_id) AS rn, CAST('0x' || substr(md5(source || '|210'), 1, 4) AS BIGINT) AS h FROM documents)
  WHERE rn <= CASE WHEN n <= 3 THEN n ELSE 3 + h % (least(5, n) - 2) END GROUP BY source""")
def q30_nest_examples(t):
    picked = curate.stratified_sample(t("documents").select("source", "doc_id", "text"), "source", "doc_id")
    got = curate.nest_examples(picked, "source", ["doc_id"], {"ids": F.col("doc_id").cast("string"), "texts": F.col("text")})
    return got.select("source", "metadata.original_group_size", "metadata.sampled_group_size", F.array_join("evidence_structured.ids", ",").alias("ids"))


_COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) + 1e-6)"
_NEAR = f"(SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COS} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rn FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"


def _near(t, k: int) -> DataFrame:
    v = t("embeddings")
    hits = vector.knn(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, k + 1)
    return corpus.keep_first(hits.where("query_id <> vec_id"), ["query_id", "vec_id"], ["rank"])


@query(f"SELECT query_id, vec_id, round(cosine, 6) AS cosine FROM {_NEAR} WHERE rn <= 10")
def q31_cosine_topk(t):
    hits = _near(t, 10).withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("rn <= 10")
    return hits.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT query_id, vec_id, round((1 + cosine) / 2, 6) AS relevance FROM {_NEAR} WHERE rn <= 5 AND ((1 + cosine) / 2 >= 0.7 OR rn = 1)")
def q32_triage(t):
    scored = _near(t, 10).withColumn("relevance", M.relevance(F.col("cosine")))
    return vector.triage(scored, "query_id", "relevance", "vec_id", threshold=0.7).select("query_id", "vec_id", F.round("relevance", 6).alias("relevance"))


_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
_PAIR = f"(SELECT * FROM (SELECT b.item_id, d.doc_id, c, e FROM (SELECT item_id, {_TOKENS.format('text')} AS c FROM benchmark) b, (SELECT doc_id, {_TOKENS.format('text')} AS e FROM documents) d) WHERE list_has_any(c, e))"


def _pairs(t, head: bool, first: str | None = None) -> DataFrame:
    """Pairs that share a token, with counts; a claim's entities are its first five tokens by name, or all of them."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))
    word = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), r"([\p{L}\p{N}]+)", 1))
    claims = t("benchmark").select("item_id", words("text").alias("c"), word.alias("w"))
    claims = claims.withColumn("h", F.slice(F.array_sort("c"), 1, 5) if head else F.col("c"))
    sized = claims.select("item_id", F.size("c").alias("n"), F.size("h").alias("n_named"), pairs.parts("c", "h", PAIRS, first).alias("parts"))
    texts = t("documents").select("doc_id", words("text").alias("e")).withColumn("negated", F.arrays_overlap("e", F.array(*map(F.lit, NEGATED))))
    return pairs.met(sized, texts, "item_id", "parts", "e")


@query(f"SELECT item_id, doc_id, round(0.5 * len(list_intersect(c, e)) / greatest(1, len(c)) + 0.5 * len(list_intersect(list_sort(c)[1:5], e)) / greatest(1, len(c[1:5])), 6) AS support FROM {_PAIR}")
def q33_support(t):
    return _pairs(t, head=True).select("item_id", "doc_id", F.round(M.support_of(*map(F.col, ("shared", "n", "named", "n_named"))), 6).alias("support"))


_OPPOSED = " + ".join(f"CAST(list_contains(c, '{x}') AND list_contains(e, '{y}') AS INTEGER) + CAST(list_contains(e, '{x}') AND list_contains(c, '{y}') AS INTEGER)" for x, y in PAIRS)


_SHARED = "(len(list_intersect(c, e))::DOUBLE / greatest(1, len(c)))"


@query(f"""SELECT item_id, doc_id, round((0.1::DOUBLE + 0.9::DOUBLE * {_SHARED}) * (0.7::DOUBLE * (({_OPPOSED})::DOUBLE / greatest(1, len(c))) + 0.3::DOUBLE * CAST(list_has_any(e, {list(NEGATED)}) AS INTEGER)) * {_SHARED}, 12) AS contradiction FROM {_PAIR}""")
def q34_contradiction(t):
    score = M.contradiction_of(*map(F.col, ("shared", "n", "named", "n_named", "opposed", "negated")))
    return _pairs(t, head=False).select("item_id", "doc_id", F.round(score, 12).alias("contradiction"))


_KINDS = "CASE event_type WHEN 'click' THEN 'news_article' WHEN 'view' THEN 'unknown' WHEN 'purchase' THEN 'financial_filing' ELSE 'marketing' END"
_ITEMS = f"(SELECT user_id AS claim_id, {_KINDS} AS kind, CASE WHEN event_id % 4 <> 0 THEN ts END AS ts, CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE 'd' || (event_id % 5) END AS domain, (event_id % 10) / 10.0::DOUBLE AS rel, TIMESTAMP '2024-01-20' AS claim_time FROM events)"
_WEIGHT = "CASE kind WHEN 'financial_filing' THEN 0.95::DOUBLE WHEN 'news_article' THEN 0.7 WHEN 'marketing' THEN 0.2 ELSE 0.5 END"
_KNOWN = "(count(*) FILTER (kind <> 'unknown'))::DOUBLE / count(*)"


def _items(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "news_article").when(F.col("event_type") == "view", "unknown").when(F.col("event_type") == "purchase", "financial_filing").otherwise("marketing")
    return t("events").select(
        F.col("user_id").alias("claim_id"), kind.alias("source_type"), F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.col("event_id") % 6 == 0, "unknown").otherwise(F.concat(F.lit("d"), (F.col("event_id") % 5).cast("string"))).alias("domain"), ((F.col("event_id") % 10) / 10).alias("relevance"), F.lit("2024-01-20").cast("timestamp").alias("claim_time"),
    )


def _metric(t, *names: str) -> DataFrame:
    return metrics.evidence_metrics(_items(t)).select("claim_id", *(F.round(n, 6).alias(n) for n in names))


@query(f"SELECT claim_id, round(1 - exp(-count(*) / 5.0::DOUBLE), 6) AS EAS FROM {_ITEMS} GROUP BY claim_id")
def q35_eas(t):
    return _metric(t, "EAS")


@query(f"""SELECT claim_id, round(greatest(0, least(1, coalesce(avg(exp(-greatest(0, epoch_us(claim_time) - epoch_us(ts)) / 1e6 * (0.6931471805599453 / (90.0 * 86400.0)))) FILTER (ts IS NOT NULL), 0.5) * (0.7 + 0.3 * count(ts)::DOUBLE / count(*)))), 6) AS ERS FROM {_ITEMS} GROUP BY claim_id""")
def q36_ers(t):
    return _metric(t, "ERS")


@query(f"SELECT claim_id, round(greatest(0, least(1, sum(rel * {_WEIGHT}) / (sum(rel) + 1e-6) * {_KNOWN})), 6) AS ESTS FROM {_ITEMS} GROUP BY claim_id")
def q37_ests(t):
    return _metric(t, "ESTS")


@query(f"""SELECT claim_id, round(CASE WHEN v > 0 THEN 0.8 * (dv::DOUBLE / v) * (v::DOUBLE / n) + 0.2 * da::DOUBLE / n ELSE 0 END, 6) AS SDS FROM
  (SELECT claim_id, count(*) AS n, count(*) FILTER (domain <> 'unknown') AS v, count(DISTINCT domain) FILTER (domain <> 'unknown') AS dv, count(DISTINCT domain) AS da FROM {_ITEMS} GROUP BY claim_id)""")
def q38_sds(t):
    return _metric(t, "SDS")


@query(f"SELECT claim_id, round(avg(CASE WHEN kind IN ('news_article', 'financial_filing') THEN 1.0::DOUBLE ELSE 0.0 END) * {_KNOWN}, 6) AS EVS FROM {_ITEMS} GROUP BY claim_id")
def q39_evs(t):
    return _metric(t, "EVS")


@query(rf"""SELECT doc_id, round(CAST(count(*) FILTER (rn <= 8 AND regexp_matches(w, '\p{{Nd}}')) AS DOUBLE) / greatest(1, count(*) FILTER (rn <= 8)), 6) AS CMS, round(CASE WHEN count(w) > 0 THEN (count(*) FILTER (w IN {HEDGED}))::DOUBLE / count(w) ELSE 1 END, 6) AS HLS,
  round(1 / (1 + ln(1 + least(8, count(w)))), 6) AS CScope FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM (SELECT d.doc_id, x.w, min(x.i) AS i FROM documents d
  LEFT JOIN (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents)) x ON d.doc_id = x.doc_id GROUP BY 1, 2)) GROUP BY doc_id""")
def q40_cms_hls_cscope(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))
    rows = t("documents").select("doc_id", words.alias("tokens")).withColumn("entities", F.slice("tokens", 1, 8))
    return metrics.claim_metrics(rows, HEDGED).select("doc_id", *(F.round(c, 6).alias(c) for c in ("CMS", "HLS", "CScope")))


_S = r"list_transform(list_filter(string_split(regexp_replace(text, '([.?!])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: true), lambda s: list_distinct(regexp_split_to_array(trim(regexp_replace(lower(s), '\s+', ' ', 'g')), '\s+')))"


@query(f"""WITH s AS (SELECT item_id, unnest({_S}) AS w, generate_subscripts({_S}, 1) AS i FROM benchmark),
  p AS (SELECT a.item_id, a.w AS c, b.w AS e FROM s a JOIN s b ON a.item_id = b.item_id AND a.i < b.i),
  k AS (SELECT item_id, avg((0.7 * ({_OPPOSED}) / greatest(1, len(c)) + 0.3 * CAST(list_has_any(e, {list(NEGATED)}) AS INTEGER)) * len(list_intersect(c, e)) / greatest(1, len(c))) * count(*) / (count(*) + 1e-6) AS m FROM p GROUP BY item_id)
  SELECT b.item_id, round(coalesce(1 - k.m, 1), 6) AS LCS FROM benchmark b LEFT JOIN k USING (item_id)""")
def q41_lcs_pairs(t):
    rows = t("benchmark").select("item_id", T.sentences(F.col("text"), 0, 1 << 30).alias("s"))
    return rows.select("item_id", F.round(metrics.coherence(F.col("s"), F.array(F.lit("x")), PAIRS, NEGATED), 6).alias("LCS"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE least(1, k / 100.0::DOUBLE) END AS score, CASE event_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.9 ELSE 0 END AS confidence, event_id % 3 = 2 AS failed FROM
  (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def q42_judge_json_parse(t):
    k = F.get_json_object("props", "$.k")
    flat = F.concat(F.lit("text {\"ESS\": "), (k.cast("double") / 100).cast("string"), F.lit("} more"))
    nested = F.concat(F.lit('<json>{"ESS": {"score": '), (k.cast("double") / 100).cast("string"), F.lit(', "confidence": 0.9}}</json>'))
    reply = F.when(F.col("event_id") % 3 == 0, flat).when(F.col("event_id") % 3 == 1, nested).otherwise(F.lit("<json>{broken</json> {\"ESS\": 1}"))
    return judges.judge_rows(t("events").select("event_id", reply.alias("reply")), ["event_id"], metrics=("ESS",)).select("event_id", "score", "confidence", "failed")


_JUDGED = "(SELECT user_id AS claim_id, event_id // 500 AS ev_ord, event_type AS judge, least(1, abs(value) / 200)::DOUBLE AS score, (event_id % 11) / 10.0::DOUBLE AS confidence FROM events WHERE event_id % 11 < 10)"
_ENSEMBLE = f"""(SELECT claim_id, ev_ord, sum(w * score) / sum(w) AS score, greatest(0, sum(w * score * score) / sum(w) - (sum(w * score) / sum(w)) ** 2) AS variance, avg(confidence) AS mean_confidence
  FROM (SELECT *, confidence + 1e-3 AS w FROM {_JUDGED}) GROUP BY claim_id, ev_ord)"""


def _ensemble(t) -> DataFrame:
    rows = t("events").where("event_id % 11 < 10").select(F.col("user_id").alias("claim_id"), F.expr("event_id div 500").alias("ev_ord"), F.least(F.lit(1.0), F.abs("value") / 200).alias("score"), ((F.col("event_id") % 11) / 10).alias("confidence"), F.lit(False).alias("failed"))
    return judges.ensemble(rows, ["claim_id", "ev_ord"])


@query(f"SELECT claim_id, ev_ord, round(score, 6) AS score, round(variance, 4) AS variance FROM {_ENSEMBLE}")
def q43_ensemble(t):
    return _ensemble(t).select("claim_id", "ev_ord", F.round("score", 6).alias("score"), F.round("variance", 4).alias("variance"))


_WEIGHED = f"(SELECT claim_id, sum(w * score) / sum(w) AS score, sum(w * variance) / sum(w) AS variance, count(*) AS n FROM (SELECT *, greatest(mean_confidence, 0.3) * greatest((ev_ord % 10) / 10.0::DOUBLE, 0.2) AS w FROM {_ENSEMBLE}) GROUP BY claim_id)"


@query(f"SELECT claim_id, round(score, 6) AS score, round(variance, 4) AS variance FROM {_WEIGHED}")
def q44_evidence_llm_agg(t):
    rows = _ensemble(t).withColumn("relevance", (F.col("ev_ord") % 10) / 10)
    return judges.over_evidence(rows, ["claim_id"]).select("claim_id", F.round("score", 6).alias("score"), F.round("variance", 4).alias("variance"))


_BY_TYPE = "(SELECT user_id AS claim_id, event_type AS metric, round(var_pop(value) / 100000, 8) AS v, avg(abs(value)) / 200 AS s, count(*) AS n FROM events GROUP BY 1, 2)"
_ANALYSED = f"(SELECT claim_id, avg(v) AS mean, count(*) FILTER (v > 0.05) AS bad, count(*) AS m, max(s) AS ess, min(s) AS ecs, max(n) AS n FROM {_BY_TYPE} GROUP BY claim_id)"


def _analysed(t) -> DataFrame:
    per = t("events").groupBy(F.col("user_id").alias("claim_id"), F.col("event_type").alias("metric")).agg(F.round(F.var_pop("value") / 100000, 8).alias("v"), (F.avg(F.abs("value")) / 200).alias("s"), F.count("*").alias("n"))
    return per.groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("variances"), F.max("s").alias("ess"), F.min("s").alias("ecs"), F.max("n").alias("n")).withColumn("a", judges.uncertainty(F.col("variances")))


@query(f"""SELECT claim_id, round(mean, 6) AS mean_variance, CAST(bad AS INTEGER) AS unstable, round(bad / m::DOUBLE, 6) AS disagreement, CASE WHEN mean > 0.1 THEN 'high' WHEN mean > 0.05 THEN 'medium' ELSE 'low' END AS level,
  round(greatest(0, 1 - mean), 6) AS confidence FROM {_ANALYSED}""")
def q45_uncertainty(t):
    return _analysed(t).select("claim_id", F.round("a.mean_variance", 6).alias("mean_variance"), F.size("a.unstable").alias("unstable"), F.round("a.disagreement", 6).alias("disagreement"), "a.level", F.round("a.confidence", 6).alias("confidence"))


_SCORE = """least(1, least(0.12 * bad, 0.36) + least(bad / m::DOUBLE, 0.3) + CASE WHEN abs(ess - ecs) < 0.15 THEN (0.15 - abs(ess - ecs)) / 0.15 * 0.25 ELSE 0 END + CASE WHEN n < 2 THEN 0.25 WHEN n < 4 THEN 0.1 ELSE 0 END
  + CASE WHEN mean > 0.1 THEN 0.3 WHEN mean > 0.05 THEN 0.15 ELSE 0 END)"""


@query(f"""SELECT claim_id, round(sc, 6) AS uncertainty_score, CASE WHEN sc > 0.3 THEN 'escalate' ELSE 'accept' END AS decision, CASE WHEN sc > 0.3 THEN array_to_string(list_sort(list_filter([
  CASE WHEN n < 2 OR worst THEN 'more_evidence' END, CASE WHEN abs(ess - ecs) < 0.1 OR bad / m::DOUBLE > 0.3 OR worst THEN 'debate' END, CASE WHEN worst THEN 'global_review' END], lambda x: x IS NOT NULL)), ',') ELSE '' END AS actions
  FROM (SELECT *, {_SCORE} AS sc, mean > 0.1 OR {_SCORE} > 0.7 AS worst FROM {_ANALYSED})""")
def q46_router(t):
    d = _analysed(t).withColumn("d", judges.decide(F.col("ess"), F.col("ecs"), F.col("a"), F.col("n"), compat=True))
    return d.select("claim_id", F.round("d.uncertainty_score", 6).alias("uncertainty_score"), "d.decision", F.array_join("d.actions", ",").alias("actions"))


@query(f"SELECT claim_id, round(n / (n + 5.0::DOUBLE) * greatest(0, least(1, score)) * exp(-variance) + (1 - n / (n + 5.0::DOUBLE)) * (score + 1) / 2, 6) AS credibility FROM {_WEIGHED}")
def q47_credibility(t):
    rows = _ensemble(t).withColumn("relevance", (F.col("ev_ord") % 10) / 10)
    got = judges.over_evidence(rows, ["claim_id"]).join(rows.groupBy("claim_id").agg(F.count("*").alias("n")), "claim_id")
    e = metrics.penalised(M.clip01(F.col("score")), F.col("variance"))
    return got.select("claim_id", F.round(M.shrink(F.col("n"), e, (F.col("score") + 1) / 2), 6).alias("credibility"))


_SYSTEMS = "(SELECT user_id AS claim_id, CASE event_id % 4 WHEN 0 THEN 'oracle' WHEN 1 THEN 'baseline' WHEN 2 THEN 'single' ELSE 'full' END AS system, event_type AS metric, avg(value) / 100 AS value FROM events GROUP BY 1, 2, 3)"


def _systems(t) -> DataFrame:
    system = F.when(F.col("event_id") % 4 == 0, "oracle").when(F.col("event_id") % 4 == 1, "baseline").when(F.col("event_id") % 4 == 2, "single").otherwise("full")
    return t("events").groupBy(F.col("user_id").alias("claim_id"), system.alias("system"), F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))


@query(f"SELECT s.claim_id, s.system, round(avg(abs(s.value - o.value)), 9) AS mae FROM {_SYSTEMS} s JOIN {_SYSTEMS} o ON s.claim_id = o.claim_id AND s.metric = o.metric AND o.system = 'oracle' WHERE s.system <> 'oracle' GROUP BY 1, 2")
def q48_metric_mae(t):
    return ev.metric_mae(ev.metric_errors(_systems(t))).select("claim_id", "system", F.round("mae", 9).alias("mae"))


@query(f"""WITH w AS (SELECT claim_id, avg(value) FILTER (system = 'oracle') AS o, avg(value) FILTER (system = 'baseline') AS b, avg(value) FILTER (system = 'single') AS s, avg(value) FILTER (system = 'full') AS f FROM {_SYSTEMS} GROUP BY claim_id),
  g AS (SELECT abs(o - b) AS bg, abs(o - s) AS sg, abs(o - f) AS fg FROM w)
  SELECT CAST(count(*) AS BIGINT) AS n, round(avg(bg), 6) AS baseline_gap, round(avg(sg), 6) AS single_gap, round(avg(fg), 6) AS full_gap, round(avg(bg - sg), 6) AS llm_gain, round(avg(sg - fg), 6) AS escalation_gain,
  CAST(count(*) FILTER (fg > 0.2) AS BIGINT) AS failures, CAST(count(*) FILTER (bg - sg > 0.1) AS BIGINT) AS llm_helped, CAST(count(*) FILTER (sg - fg > 0.1) AS BIGINT) AS escalation_helped FROM g""")
def q49_tier_report(t):
    wide = _systems(t).groupBy("claim_id").pivot("system", ["oracle", "baseline", "single", "full"]).agg(F.avg("value"))
    r = ev.report(ev.gaps(wide))
    return r.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in r.dtypes))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'why' WHEN contains(lower(text), 'que') OR contains(lower(text), 'der') THEN 'improve' ELSE 'general' END AS kind FROM (SELECT conv_id, turn, text FROM conversations)")
def q50_question_class(t):
    low = F.lower("text")
    coded = F.when(F.contains(low, F.lit("the")), "why").when(T.holds(low, ("que", "der")), "better").otherwise("hello")
    return t("conversations").select("conv_id", "turn", T.question_class(coded).alias("kind"))


@query("""SELECT doc_id, CASE WHEN len(p) >= 4 THEN p[-4] END AS section, CASE WHEN len(p) >= 3 THEN p[-3] END AS topic, CASE WHEN len(p) >= 2 THEN p[-2] END AS sentiment, CASE WHEN len(q) >= 2 THEN regexp_replace(regexp_replace(q[-2], '^\\s+', ''), '\\s+$', '') END AS clean_text
  FROM (SELECT doc_id, string_split(text, ',') AS p, string_split(text, '"') AS q FROM documents WHERE length(text) > 0)""")
def q51_evidence_text_parse(t):
    return t("documents").where(F.length("text") > 0).select("doc_id", T.evidence_parts(F.col("text")).alias("p")).select("doc_id", "p.section", "p.topic", "p.sentiment", "p.clean_text")


@query("""SELECT conv_id, string_agg('[' || (turn + 1 - lo) || '] ' || substr(text, 1, 300) || chr(10) || 'URL: ' || role || chr(10) || 'Score: ' || printf('%.3f', turn / 8.0::DOUBLE), chr(10) || chr(10) ORDER BY turn) AS context
  FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id""")
def q52_context_join(t):
    rows = t("conversations").withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "rn", "text", F.col("role").alias("url"), (F.col("turn") / 8).alias("score"))
    return evidence.context(rows, "conv_id", "rn")


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(20\\d{2})', 1), '') || '-01-01', '2024-06-01') AS claim_date FROM documents")
def q53_claim_time(t):
    return t("documents").select("doc_id", D.claim_time(F.col("text"), F.lit("2024-06-01").cast("timestamp")).cast("date").cast("string").alias("claim_date"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS found FROM orders")
def q54_extract_date(t):
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return t("orders").select("o_orderkey", D.date_in(F.concat(F.lit("Filed on "), form, F.lit(" by post"))).cast("date").cast("string").alias("found"))


@query("SELECT item_id, length(text) > 20 AND length(text) < 300 AND NOT starts_with(lower(text), 'the evidence') AND NOT contains(lower(text), 'not mentioned') AS valid FROM benchmark")
def q55_valid_claim(t):
    return t("benchmark").select("item_id", T.valid_claim(F.col("text")).alias("valid"))


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession_number, strftime(o_orderdate, '%Y-%m-%d') AS filing_date FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def q56_submissions_zip(t):
    o = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")))).alias("x"))
    recent = F.struct(F.col("x.o_orderstatus").alias("form"), F.transform("x", lambda e: e.o_orderkey.cast("string")).alias("accessionNumber"), F.col("x.d").alias("filingDate"))
    got = corpus.filings(o.select(T.cik10(F.col("o_custkey")).alias("cik"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json")), "1996-01-01", "1997-12-31", "F")
    return got.select("cik", "accession_number", "filing_date")


@query()
def q57_pipeline_full(t):
    from evidentia.plans import pipeline as P
    from evidentia.plans.providers import with_embeddings

    config = P.Config()
    docs = t("documents").select(F.lit("documents").alias("s3_key"), F.col("doc_id").alias("row_index"), "text", F.col("source").alias("news_site"), F.col("lang").alias("language"))
    chunks = with_embeddings(evidence.chunked(evidence.documents(docs)), "text", config.embedder)
    claims = t("benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    got = P.evaluate(claims, chunks, "2024-06-01", config)
    return got.select("claim_id", "n", *(F.round(c, 6).alias(c) for c in ("ESS", "ECS", "CMS", "LCS", "HLS", "EAS", "ERS", "ESTS", "EAGS", "SDS", "EVS", "CScope", "credibility", "credibility_post_debate")), F.col("decision.decision").alias("decision"), "pass")


@query()
def q58_stream_ingest(t):
    import uuid

    from evidentia.streaming import ingest
    from evidentia.tables import shared_dir

    docs = t("documents")
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/evidentia/ingest-{uuid.uuid4().hex}"
    files = docs.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    glob = {"pathGlobFilter": "documents.parquet"} if files[0].endswith("/documents.parquet") else {}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    ingest.ingest(spark, folder, schema, f"{base}/table", f"{base}/state", options=glob).awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("chunk_index").agg(F.count("*").alias("n"))


@query()
def q59_article_parse(t):
    from evidentia.sources import decode

    got = decode.articles(t("pages"))
    return got.select("page_id", F.length("article_text").alias("n"), F.sha2("article_text", 256).alias("sha"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def q60_scale_rollup(t):
    rows = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q61_dimension_lookup(t):
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


_LINES = "html"
for _tag in ("script", "style", "noscript", "table"):
    _LINES = rf"regexp_replace({_LINES}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"
_LINES = rf"regexp_replace(regexp_replace({_LINES}, '(?s)<!--.*?-->', '', 'g'), '(?i)<br\b[^>]*>|</?(?:p|div|li|h[1-4])\b[^>]*>', chr(10), 'g')"
_LINES = _decoded(f"regexp_replace({_LINES}, '(?s)<[^>]*>', '', 'g')")


@query(rf"SELECT page_id, {_STRIP.format('x')} AS text FROM (SELECT page_id, regexp_replace(regexp_replace({_LINES}, '[ \t\r\f\x0B]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM pages)")
def q62_html_lines(t):
    return t("pages").select("page_id", T.html_lines(F.col("html")).alias("text"))


@query("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def q63_top_rows(t):
    return corpus.keep_first(t("documents").withColumn("slot", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("slot <= 3"), ["source", "slot"], ["doc_id"]).select("source", "lang", "doc_id")


@query("SELECT cik, concept, fy, value FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_orderkey % 2 = 0 THEN 'Assets' ELSE 'Revenues' END AS concept, CAST(year(o_orderdate) AS INTEGER) AS fy, round(o_totalprice, 2) AS value FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1996 AND 1998)")
def q64_company_facts(t):
    o = t("orders")
    concept = F.when(F.col("o_orderkey") % 2 == 0, "Assets").otherwise("Revenues")
    unit = F.struct(F.when(F.col("o_orderstatus") == "F", "FY").otherwise("Q1").alias("fp"), F.year("o_orderdate").alias("fy"), F.round("o_totalprice", 2).alias("val"))
    per = o.groupBy("o_custkey", concept.alias("concept")).agg(F.collect_list(unit).alias("USD"))
    per = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.struct("USD").alias("units"))))).alias("us-gaap"))
    json = per.select(T.cik10(F.col("o_custkey")).alias("cik"), F.lit("").alias("ticker"), F.to_json(F.struct(F.struct(F.col("us-gaap")).alias("facts"))).alias("json"))
    return corpus.company_facts(json, first=1996, last=1998).select("cik", "concept", "fy", "value")


@query(r"""SELECT doc_id, file, url, clean AS text FROM (SELECT doc_id, source AS file, lang AS url, CASE WHEN len(string_split(text, '"')) >= 2 THEN regexp_replace(regexp_replace(string_split(text, '"')[-2], '^\s+', ''), '\s+$', '') END AS clean FROM documents) WHERE length(clean) > 0""")
def q65_response_sources(t):
    from evidentia.plans import service

    rows = t("documents").select(F.col("doc_id").alias("query_id"), "text", F.col("source").alias("s3_key"), F.col("lang").alias("source_url"), F.lit(0.0).alias("score"), F.lit(0).alias("chunk_index"))
    return service.sources(rows).select(F.col("query_id").alias("doc_id"), "file", "url", "text")


@query("SELECT event_id FROM events WHERE event_type <> 'click' OR user_id % 3 = 0")
def q66_language_metadata(t):
    from evidentia.plans import service

    rows = t("events").select("event_id", F.col("event_type").alias("domain"), F.when(F.col("user_id") % 3 == 0, "English").when(F.col("user_id") % 3 == 1, "French").alias("language"))
    return service.only_english(rows, "click").select("event_id")


@query(r"""SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, lower(regexp_extract(text, '([\p{L}\p{N}]+)', 1)) AS w FROM benchmark) b JOIN (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents) d
  ON list_contains(d.t, b.w) WHERE b.w <> ''""")
def q67_entity_in_text(t):
    words = t("benchmark").select("item_id", F.regexp_extract("text", r"([\p{L}\p{N}]+)", 1).alias("w"))
    return corpus.word_mentions(t("documents"), words, "doc_id", F.col("text"), "w").select("item_id", "doc_id")


@query()
def q68_claim_generation(t):
    from evidentia.plans import dialogue

    picked = curate.stratified_sample(t("documents").select("source", "doc_id", "text"), "source", "doc_id")
    nested = curate.nest_examples(picked, "source", ["doc_id"], {"text": F.col("text")}).withColumn("company_name", F.col("source"))
    return dialogue.generate_claims(nested, dialogue.HashTalker()).select("source", "label", "claim")


@query()
def q69_entity_resolution(t):
    from evidentia.plans import dialogue

    rows = t("benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    return dialogue.resolve_entities(rows, F.array("claim"), dialogue.HashTalker()).select("claim_id", F.array_join("entities", "|").alias("entities"))


@query(r"SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'en')) AS INTEGER) AS n FROM conversations")
def q70_keyword_count(t):
    return t("conversations").select("conv_id", "turn", T.word_count(F.col("text"), ("the", "en")).cast("int").alias("n"))
