"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import embedding_dedup, html_extract, importance, language_id, license_scan, media, near_dedup, packing, point_in_time, quality_rules, source_mix, suffix_dedup, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir)).drop("spans")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position", F.try_element_at("positions", F.lit(-1)).alias("last_position"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(_documents(spark, sf_dir)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir)).drop("detections")


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_documents(spark, sf_dir))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir)).withColumns({name: F.round(name, 9) for name, *_ in quality_rules.LIMITS})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(_documents(spark, sf_dir))


def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, clicks, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "clicks", "sale_lines"))
    return point_in_time.point_in_time(sales, clicks, lines)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_suffix_dedup, op3_source_mix, op4_media, op5_license_scan, op6_token_counts, op7_packing, op8_html_extract, op9_quality_rules, op10_language_id, op11_point_in_time, op12_importance_resampling, op13_embedding_dedup, pipeline)}

#: The byte table of CRC-32 as a list, for SQL that has no such function.
_CRC_SQL = r"""k AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(coalesce(doc_id, -1) AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
l AS (SELECT *, CASE WHEN (1.5::DOUBLE * total - before) / rest <= cap / weight THEN (1.5::DOUBLE * total - before) / rest END AS lv FROM o),
t AS (SELECT source, source_size, CASE turn % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS a, least(cap, coalesce(max(lv) OVER () * weight, cap)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, CAST(floor(t.target) AS BIGINT) AS goal,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM r),
k AS (SELECT *, greatest(0, least(size, goal - passes * source_size - before)) AS extra FROM p),
c AS (SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END ELSE 0 END AS copies FROM k),
h AS (SELECT *, CASE WHEN copies > 0 THEN before / goal::DOUBLE END AS x, CASE WHEN copies > 0 THEN (before + (copies - 1) * source_size) / goal::DOUBLE END AS y FROM c)
SELECT doc_id, size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken, CASE WHEN a = 0 THEN x ELSE (a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a) END AS position,
  CASE WHEN a = 0 THEN y ELSE (a - 1 + sqrt((1 - a) * (1 - a) + 4 * a * y)) / (2 * a) END AS last_position FROM h
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1)) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
q AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS a, CASE WHEN n_words > 0 THEN n_dup_lines::DOUBLE / n_words ELSE 0 END AS b, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS c, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS e FROM m),
x AS (SELECT lang, source, unnest(['a', 'b', 'c', 'e']) AS rule, unnest([a, b, c, e]) AS x FROM q),
s AS (SELECT lang, source, rule, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln(1.02::DOUBLE)) AS INTEGER) ELSE -100000 END AS bin, count(*) AS n FROM x GROUP BY ALL),
v AS (SELECT *, CASE WHEN bin = -100000 THEN 0::DOUBLE ELSE pow(1.02::DOUBLE, bin) END AS value FROM s),
y AS (SELECT rule, sum(n * value) / sum(n) AS mean FROM v GROUP BY rule),
u AS (SELECT v.*, sum(n) OVER (PARTITION BY lang, source, v.rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, v.rule) AS total, (sum(n * value) OVER (PARTITION BY lang, source, v.rule) + 100 * y.mean) / (sum(n) OVER (PARTITION BY lang, source, v.rule) + 100) AS mean FROM v JOIN y ON v.rule = y.rule),
z AS (SELECT lang, source, greatest(min(value) FILTER (rule = 'a' AND upto >= total * 0.75), max(mean) FILTER (rule = 'a')) * 4 AS ma, greatest(min(value) FILTER (rule = 'b' AND upto >= total * 0.75), max(mean) FILTER (rule = 'b')) * 16 AS mb,
  greatest(min(value) FILTER (rule = 'c' AND upto >= total * 0.75), max(mean) FILTER (rule = 'c')) * 8 AS mc, min(value) FILTER (rule = 'e' AND upto >= total * 0.9) * 1.3 AS me, min(value) FILTER (rule = 'e' AND upto >= total * 0.1) * (1 / 1.3::DOUBLE) AS le FROM u GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_symbols < 5 OR a <= ma) AND (n_dup_lines < 2 OR b <= mb) AND (n_repeat_words < 12 OR c <= mc) AND e <= me AND e >= le AS kept,
  round(ma, 9) AS max_symbols, round(mb, 9) AS max_dup_lines, round(mc, 9) AS max_repeats, round(me, 9) AS max_word_length, round(le, 9) AS min_word_length
FROM q JOIN z ON q.lang IS NOT DISTINCT FROM z.lang AND q.source IS NOT DISTINCT FROM z.source
""",
    "op11_point_in_time": "WITH " + _CRC_SQL
    + r""",
b AS (SELECT CAST(sale_id AS VARCHAR) AS v, any_value(sale_id) AS sale_id FROM sales GROUP BY 1),
j AS (SELECT sale_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(v, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(k.k[(xor(c, x) & 255) + 1], c >> 8))) % 259200 AS s FROM b, k WHERE v IS NOT NULL),
s AS (SELECT row_number() OVER () AS n, sales.sale_id, client_id, epoch_us(sold_at) AS e, epoch_us(arrived_at) + 14400000000 AS a, CASE WHEN abs(total) < 9e16 THEN CAST(floor(100 * total + 0.5) AS BIGINT) ELSE 0 END AS cents, epoch_us(sold_at) + coalesce(j.s, 0) * 1000000 AS t
  FROM sales LEFT JOIN j ON sales.sale_id = j.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
w AS (SELECT s.*, d, t - d * 86400000000 AS lo FROM s, (SELECT unnest([2, 14]) AS d)),
c AS (SELECT DISTINCT * FROM clicks),
cc AS (SELECT client_id, click_id, kind, epoch_us(ts) AS e, epoch_us(arrived_at) + 14400000000 AS a, CASE WHEN abs(value) < 9e16 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents FROM c),
x AS (SELECT w.n, w.d, count(*) AS n_clicks, count(*) FILTER (cc.kind = 'purchase') AS n_purchases, sum(coalesce(cc.cents, 0)) AS click_cents, max({'e': cc.e, 'i': coalesce(cc.click_id, -9223372036854775808)}) AS z
  FROM w JOIN cc ON w.client_id = cc.client_id AND cc.e > w.lo AND cc.e <= w.t AND cc.a <= w.t GROUP BY 1, 2),
y AS (SELECT w.n, w.d, count(*) AS n_sales, sum(coalesce(s.cents, 0)) AS sale_cents FROM w JOIN s ON w.client_id = s.client_id AND s.e > w.lo AND s.e <= w.t AND s.a <= w.t GROUP BY 1, 2),
l AS (SELECT s.client_id, s.e, greatest(s.a, epoch_us(shipped_at)) AS a, item_id, CASE WHEN abs(amount) < 9e16 THEN CAST(floor(100 * amount + 0.5) AS BIGINT) ELSE 0 END AS cents FROM s JOIN sale_lines ON s.sale_id = sale_lines.sale_id WHERE s.a IS NOT NULL AND shipped_at IS NOT NULL),
v AS (SELECT w.n, w.d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(l.cents, 0)) AS line_cents FROM w JOIN l ON w.client_id = l.client_id AND l.e > w.lo AND l.e <= w.t AND l.a <= w.t GROUP BY 1, 2),
u AS (SELECT DISTINCT w.n FROM w JOIN s ON w.client_id = s.client_id AND s.e > w.t AND s.e <= w.t + 604800000000)
SELECT w.sale_id, w.d, w.t AS t_us, u.n IS NOT NULL AS label, CAST(coalesce(n_clicks, 0) AS BIGINT) AS n_clicks, CAST(coalesce(n_purchases, 0) AS BIGINT) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, nullif(z.i, -9223372036854775808) AS last_click_id,
  CAST(coalesce(n_sales, 0) AS BIGINT) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN x ON w.n = x.n AND w.d = x.d LEFT JOIN y ON w.n = y.n AND w.d = y.d LEFT JOIN v ON w.n = v.n AND w.d = v.d LEFT JOIN u ON w.n = u.n
""",
    "op12_importance_resampling": "WITH " + _CRC_SQL
    + r""",
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT r, unnest(w) AS w FROM d),
b AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f UNION SELECT DISTINCT w FROM m)),
e AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT)), lambda c, x: xor(k.k[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS b FROM b, k),
s AS (SELECT b, count(*) AS s FROM f JOIN e ON f.w = e.w GROUP BY b),
t AS (SELECT b, count(*) AS t FROM m JOIN e ON m.w = e.w GROUP BY b),
g AS (SELECT s.b, CAST(floor(1000 * ln(CAST(coalesce(t.t, 0) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE) / (CAST(s.s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t ON s.b = t.b),
q AS (SELECT r, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN e ON f.w = e.w JOIN g ON e.b = g.b GROUP BY r),
n AS (SELECT doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight, sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d LEFT JOIN q ON d.r = q.r),
o AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', h[i]) - 1)::BIGINT)), lambda a, x: a * 16 + x) AS u FROM n),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM p)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND rank <= 10 * total // 100 THEN CAST(rank AS BIGINT) END AS rank FROM z
""",
    "op13_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
o AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_max(list_transform(x, lambda y: abs(y))) > 0),
p AS (SELECT a.r AS a, b.r AS b, a.vec_id AS i, b.vec_id AS j FROM o a JOIN o b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
c AS (SELECT r, vec_id FROM v UNION SELECT p.b, c.vec_id FROM c JOIN p ON c.r = p.a),
m AS (SELECT r, min(vec_id) AS component_id FROM c GROUP BY r),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id IS NOT DISTINCT FROM m.component_id AS kept FROM v LEFT JOIN n ON v.r = n.r LEFT JOIN m ON v.r = m.r
""",
}
