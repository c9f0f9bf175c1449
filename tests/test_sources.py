"""Scans, fetches, decoding, sinks and the ingest stream."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from evidentia import schemas as S
from evidentia.sources import decode, fetch, readers, sinks
from evidentia.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('text,title\n"one, ""quoted""\nline",T1\ntwo,T2,extra\nthree\n')
    (tmp_path / "in/b.txt").write_text("whole\nfile")
    return tmp_path


def test_csv(spark, folder):
    got = {r.row_index: (r.text, r.title) for r in readers.csv_rows(spark, str(folder / "in"), "text string, title string").collect()}
    assert got == {1: ('one, "quoted"\nline', "T1"), 2: ("three", "")}


def test_all_kinds(spark, folder):
    spark.createDataFrame([("p", None)], "text string, title string").write.parquet(str(folder / "in/c.parquet"))
    got = readers.rows(spark, str(folder / "in"), ("csv", "parquet", "text")).collect()
    assert any(r.text == "whole\nfile" for r in got) and any(r.text == "p" and r.title == "" for r in got)
    kinds = {r.kind for r in readers.listing(spark, str(folder / "in")).collect()}
    assert {"csv", "parquet", "text"} <= kinds


def test_gold_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"ticker": "A", "claim": "c", "evidence": [{"text": "t", "url": "u"}], "metadata": {"original_group_size": 3}}]')
    (r,) = readers.json_rows(spark, str(tmp_path / "g.json")).collect()
    assert r.evidence[0].text == "t" and r.metadata.original_group_size == 3


def test_upsert_adds_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], ["id", "x"])
    for _ in range(2):
        sinks.upsert(df, path, "id")
    assert spark.read.parquet(path).count() == 2
    assert not sinks.create(spark, path, "id int") and sinks.create(spark, path + "2", "id int")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.com", "w1", "x")], ["domain", "week", "text"])
    sinks.weekly_csv(df, str(tmp_path / "w"))
    assert (tmp_path / "w/domain=a_com/week=w1").is_dir()
    sinks.dual(df, str(tmp_path / "d"))
    sinks.log_run(spark, str(tmp_path / "log"), files=3, seconds=1.5)
    assert spark.read.json(str(tmp_path / "log")).first().files == 3 and spark.read.parquet(str(tmp_path / "d.parquet")).count() == 1


def test_inflate():
    raw = b"hello " * 20
    deflated = zlib.compressobj(wbits=-15)
    body = deflated.compress(raw) + deflated.flush()
    assert decode.inflate(gzip.compress(raw), "gzip") == raw and decode.inflate(gzip.compress(raw), "") == raw
    assert decode.inflate(zlib.compress(raw), "deflate") == raw and decode.inflate(body, "deflate") == raw
    assert decode.inflate(raw, "gzip") == raw and decode.inflate(raw, None) == raw and decode.inflate(None, "br") is None


@pytest.mark.parametrize(
    ("page", "url", "want"),
    [
        ("<div class='x caas-body'><p>a</p><p> b <b>c</b></p></div><p>d</p>", "https://finance.yahoo.com/1", "a b c"),
        ("<body><p>d</p><article><p>a</p></article></body>", "https://x.com", "a"),
        ("<body><p>d</p></body>", "https://x.com", "d"),
        ('<script type="application/ld+json">{"@graph": [{"articleBody": " x &amp; y "}]}</script>', "", "x & y"),
        ("<script>root.App.main = {\"a\": {\"content\": \"<p>in</p>\"}};</script>", "", "in"),
        ("<div>nothing</div>", "", None),
        (None, "", None),
        ("<div data-module='ArticleBody'><p>z</p></div>", "https://www.cnbc.com/a", "z"),
        ("<div class='big-article-body'><p>q</p></div><main><p>m</p></main>", "https://nasdaq.com/a", "q"),
    ],
)
def test_article(page, url, want):
    assert decode.article(page, url) == want


def test_articles(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", None), (2, None, "u")], "id int, html string, url string")
    assert {r.id: r.article_text for r in decode.articles(df).collect()} == {1: "a", 2: None}
    row = spark.createDataFrame([('{"x": [{"description": "d"}]}',), ("bad",)], ["j"]).select(decode.found_in_json(F.col("j")).alias("t"))
    assert [r.t for r in row.collect()] == ["d", None]


def test_retries():
    waits, answers = [], [(429, None), OSError(), (200, "body")]

    def get(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert fetch.get_with_retries(get, "u", jitter=0, sleep=waits.append) == "body" and waits == [0.5, 1.0]
    with pytest.raises(RuntimeError):
        fetch.get_with_retries(lambda u: (404, None), "u", sleep=waits.append)
    with pytest.raises(RuntimeError):
        fetch.get_with_retries(lambda u: (503, None), "u", sleep=lambda s: None)


def test_article_lists_tell_limits():
    none = lambda s: None
    assert fetch.list_articles(lambda u: (429, None), "u", sleep=none) == ("limited", None)
    assert fetch.list_articles(lambda u: (500, None), "u", sleep=none) == ("failed", None)
    assert fetch.list_articles(lambda u: (200, "[]"), "u", sleep=none) == ("done", "[]")


def test_fetch_all(spark):
    df = spark.createDataFrame([(1, "bad", "good"), (2, "bad", None)], "id int, url string, alt string")
    got = fetch.fetch_all(df, lambda u: (200, "b") if u == "good" else (404, None), alternative="alt")
    assert {r.id: r.body for r in got.collect()} == {1: "b", 2: None}
    df = spark.createDataFrame([(1, "http://www.a.com/x"), (2, "http://b.com/x")], "id int, url string")
    got = fetch.fetch_all(df, lambda u: (403, None), reader=lambda u: (200, "read"), reader_hosts=("a.com",))
    assert {r.id: r.body for r in got.collect()} == {1: "read", 2: None}


def test_stream_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    rows = lambda a, b: spark.createDataFrame([(f"text number {i}", f"title {i}") for i in range(a, b)], "evidence_text string, title string")
    for a, b, total in ((0, 5, 5), (5, 8, 8)):
        rows(a, b).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, "evidence_text string, title string", target, state).awaitTermination()
        assert spark.read.parquet(target).count() == total
    ingest.ingest(spark, source, "evidence_text string, title string", target, state + "2").awaitTermination()
    assert spark.read.parquet(target).count() == 8


def test_schemas_parse(spark):
    for schema in (S.COMPANIES, S.FILINGS, S.FACTS, S.EVIDENCE_ROW, S.GOLD):
        assert spark.createDataFrame([], schema).columns


def test_deep_and_unclosed_pages_parse(spark):
    """Unclosed tags of any number, and JSON of any depth, cost no task."""
    pages = ["<article>" + "<p>word " * 10_000, "<div>" * 10_000 + "<p>deep</p>", "<article>" + "</b>" * 10_000 + "<p>x</p>", '<script type="application/ld+json">' + "[" * 100_000 + "</script><p>y</p>"]
    rows = spark.createDataFrame([(i, "http://a/", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    got = {r.page_id: r.article_text for r in decode.articles(rows).collect()}
    assert got[0] == " ".join(["word"] * 10_000) and got[1] == "deep" and got[2] == "x" and got[3] == "y"


def test_paragraphs_close_one_another():
    assert decode.article("<article><p>a<p>b<div>c<p>d</div></article>", None) == "a b d"


def test_rows_of_any_kinds(spark, tmp_path):
    """Kinds may be absent; what is neither CSV nor Parquet is text, whatever its name."""
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "b").write_text("two\nlines")
    assert sorted((r.text, r.row_index) for r in readers.rows(spark, str(tmp_path)).collect()) == [("one", 1), ("two\nlines", 1)]
    spark.createDataFrame([(i, f"t{i}") for i in range(5)], "n int, text string").coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    got = readers.rows(spark, str(tmp_path)).where("s3_key like '%.parquet'").collect()
    assert sorted((r.row_index, r.n) for r in got) == [(i + 1, str(i)) for i in range(5)]
    (tmp_path / "empty").mkdir()


def test_shared_folder_of_a_cluster_must_be_named():
    from evidentia import tables

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert tables.shared_dir(Session()) == "hdfs://x/y"


def test_a_failing_prompt_costs_its_own_reply():
    from evidentia.plans import providers

    class Picky:
        name = "picky"

        def chat(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

    prompts = [f"p{i}" for i in range(40)]
    prompts[7] = "bad"
    old, providers.time.sleep = providers.time.sleep, lambda s: None
    try:
        got = providers.replies(Picky(), prompts)
    finally:
        providers.time.sleep = old
    assert got == [None if p == "bad" else p.upper() for p in prompts]
