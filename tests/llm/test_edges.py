"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import html_extract, language_id, license_scan, media, near_dedup, packing, quality_rules, source_mix, suffix_dedup, token_counts


def _tokens(df):
    import public_tokenizers

    return token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"))


OPERATORS = {
    "near": near_dedup.near_duplicates,
    "suffix": suffix_dedup.suffix_dedup,
    "mix": source_mix.mix_sources,
    "media": lambda df: media.media_features(media.with_media(df)),
    "license": license_scan.scan_licenses,
    "tokens": _tokens,
    "pack": packing.best_fit_pack,
    "quality": quality_rules.quality_rules,
    "language": language_id.identify_language,
}
CLASHES = ["n_bytes", "size", "key", "bands", "o", "tell", "spans", "a", "u", "h", "_slot", "slot", "within", "hash", "group", "piece", "n_words", "lang_pred", "score", "held_out", "_lang", "_source", "media", "words", "_times", "_id", "row"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_stay(table, odd_rows, name):
    df = table(odd_rows).select("*", *(F.lit(7).alias(c) for c in CLASHES))
    got = OPERATORS[name](df)
    rows = got.collect()
    if name == "pack":
        rows = [r for r in rows if r.piece == 0]
    key = lambda v: (v is None, v or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in odd_rows), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(table, name):
    assert OPERATORS[name](table([])).collect() == []


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract_text(pages).collect() == []


def test_all_null_table(table):
    df = table([(None, None, None, None, None)] * 2)
    for name, op in OPERATORS.items():
        assert op(df).count() == 2, name


STAGES = [stage for _, stage in corpus_pipeline.STAGES]


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns(spark, table, odd_rows, number):
    """Columns of any name stay, with their values, and rows are those of the table without them."""
    df = table(odd_rows)
    more = df.select("*", *(F.concat_ws("|", F.lit(c), F.col("doc_id")).alias(c) for c in [*CLASHES, "_mix_row", "_mix_at", "_tell", "_identified", "left"] if c != "_mix_row"))
    got = STAGES[number](spark, more, "")
    assert got.columns == more.columns
    rows = got.collect()
    assert all(r[c] == (f"{c}|{r.doc_id}" if r.doc_id is not None else c) for r in rows for c in ("lang_pred", "hash", "size", "tell", "row"))
    plain = lambda rows: sorted((repr(r.doc_id), repr(r.text), repr(r.source)) for r in rows)
    if number != 3:  # ties of rows of one doc_id are broken by a hash of all columns there
        assert plain(rows) == plain(STAGES[number](spark, df, "").collect())


@pytest.mark.parametrize("number", range(5))
def test_stages_of_empty_and_null_tables(spark, table, number):
    assert STAGES[number](spark, table([]), "").collect() == []
    got = STAGES[number](spark, table([(None, None, None, None, None)] * 2), "").collect()
    assert len(got) == (0 if number in (0, 3) else 2)


def test_identify_of_odd_rows(spark, table, odd_rows):
    got = sorted(repr(r.text) for r in STAGES[0](spark, table(odd_rows), "").collect())
    model = language_id.fit_language_model(table(odd_rows))
    verdict = dict(zip([r[1] for r in odd_rows], language_id._scores([r[1] for r in odd_rows], model, language_id._letter_codes()), strict=True))
    assert got == sorted(repr(r[1]) for r in odd_rows if verdict[r[1]][0] != "und" and verdict[r[1]][1] >= model.limit)


def test_pack_of_odd_rows(spark, table, odd_rows):
    got = STAGES[4](spark, table(odd_rows), "").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r.size for r in got) == sum(count(r[1]) for r in odd_rows)
    assert sum(r.piece == 0 for r in got) == len(odd_rows)
