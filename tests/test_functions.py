"""Golden values of column functions."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import dates as D
from evidentia.functions import math as M
from evidentia.functions import text as T


@pytest.fixture(scope="session")
def value(spark):
    """The value of a column over one row of literals."""

    def get(make, *literals):
        row = spark.createDataFrame([literals or (0,)], [f"c{i}" for i in range(max(1, len(literals)))]) if literals and all(x is not None for x in literals) else spark.range(1).select(*(F.lit(x).alias(f"c{i}") for i, x in enumerate(literals or (0,))))
        return row.select(make(*(F.col(f"c{i}") for i in range(len(literals)))).alias("v")).first().v

    return get


@pytest.mark.parametrize(("n", "lengths"), [(0, []), (1, [1]), (1000, [1000]), (1001, [1000, 151]), (1850, [1000, 1000]), (2000, [1000, 1000, 300])])
def test_chunks(value, n, lengths):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = value(T.chunks, " " + text + "\n")
    assert [len(x) for x in got] == lengths
    assert all(x == text[i * 850 : i * 850 + 1000] for i, x in enumerate(got))


def test_chunk_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        T.chunks(F.lit("x"), 10, 10)


def test_sentences(value):
    one, two = "A" + "b" * 90 + ".", "C" + "d" * 90 + "?"
    assert value(T.sentences, f"{one}  {two}\nShort. {one} not a new one. {two}") == [one, two, f"{one} not a new one.", two]


@pytest.mark.parametrize(
    ("text", "want"),
    [("demand was soft and weak", "negative"), ("record growth, strong and up", "positive"), ("up and down", "neutral"), ("upper", "neutral"), ("", "neutral"), (None, "neutral"), ("up up down", "positive")],
)
def test_direction(value, text, want):
    assert value(T.direction, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We focused on the cloud and gross margin increased", "STRATEGIC_INVESTMENT_FOCUS"), ("Margin fell primarily on mix", "MARGIN_DRIVER"), ("We saw Discounting", "PRICING_PRESSURE"), ("Orders rose", "DEMAND_TREND"),
        ("Orders rose on foreign exchange", None), ("Nothing here", None), ("higher ASPs", "PRICING_PRESSURE"),
    ],
)
def test_fact_type(value, text, want):
    assert value(T.fact_type, text) == want


@pytest.mark.parametrize(("text", "noise"), [("x" * 99, True), ("x" * 100, False), ("x" * 100 + "|||", True), ("x" * 100 + "Form 10-K", True), ("1" * 81 + "x" * 30, True), ("The Table Shows " + "x" * 100, True)])
def test_noise_sentence(value, text, noise):
    assert value(T.noise_sentence, text) is noise


@pytest.mark.parametrize(("url", "want"), [("https://www.A.com:80/x", "a.com:80"), ("", ""), (None, ""), ("a.com/x", ""), ("http://u@www.b.org?x", "u@www.b.org"), ("//c.net/y", "c.net")])
def test_web_domain(value, url, want):
    assert value(T.web_domain, url) == want


def test_news_domain(value):
    assert value(T.news_domain, "http://www.x.www.com/a") == "x.com" and value(T.news_domain, "") is None


@pytest.mark.parametrize(
    ("url", "text", "want"),
    [
        ("https://www.sec.gov/x", "", "financial_filing"), ("https://reuters.com/paper", "", "news_article"), ("https://x.com/a.pdf", "news", "peer_reviewed"), ("https://finance.yahoo.com/x", "", "unknown"), ("https://openai.com/x", "", "marketing"),
        ("https://openai.com/blog", "", "technical_blog"), (None, "in our annual report", "financial_filing"), (None, "Use Case", "case_study"), (None, None, "unknown"), ("https://medium.com/pdf", "", "technical_blog"),
    ],
)
def test_source_class(value, url, text, want):
    assert value(lambda u, t: T.source_class(u, t), url, text) == want


def test_html(value):
    page = "<html><script>x</script><style>y</style><table><tr><td>t</td></tr></table><p>A &amp; b<br>c</p><div>d</div>\n\n\n<!-- z --></html>"
    assert value(T.html_flat, page) == "A & b c d"
    assert value(T.html_lines, page) == "A & b\nc\n\nd"


def test_section(value):
    body = "word " * 500
    text = f"Item 7. Management's Discussion and Analysis {body} Item 8. Financial Statements and more"
    assert value(T.section, text) == f"Item 7. Management's Discussion and Analysis {body.strip()}"
    assert value(T.section, text.replace("Item 7.", "Item 9.")) is None
    assert value(T.section, "Item 7. Management Discussion and Analysis short Item 8.") is None
    assert len(value(lambda t: T.section(t, cutoff=2500), "Item 7. Management Discussion and Analysis " + "x" * 9000)) == 2500


def test_aliases(value):
    assert value(T.company_aliases, "Acme Holdings, Inc.") == ["acme holdings inc", "acme holdings", "acme"]
    assert value(T.company_aliases, "Co") == []


@pytest.mark.parametrize(("word", "text", "want"), [("c++", "uses C++ now", True), ("ab", "cab", False), ("é", "l'é.", True), ("a.b", "axb", False)])
def test_in_text(value, word, text, want):
    assert value(T.in_text, word, text) is want


@pytest.mark.parametrize(("claim", "want"), [("x" * 20, False), ("x" * 21, True), ("x" * 300, False), ("The evidence shows that it is", False), ("This was not mentioned in any of it", False), (None, False)])
def test_valid_claim(value, claim, want):
    assert value(T.valid_claim, claim) is want


@pytest.mark.parametrize(("q", "want"), [("why is the score low", "why"), ("how to get better", "improve"), ("which source", "evidence"), ("what score", "metrics"), ("hello", "general")])
def test_question_class(value, q, want):
    assert value(T.question_class, q) == want


def test_evidence_parts(value):
    got = value(T.evidence_parts, 'a,"quoted, text ",MD&A,demand,up,x')
    assert (got.section, got.topic, got.sentiment, got.clean_text) == ("MD&A", "demand", "up", "quoted, text")
    assert value(T.evidence_parts, "").section is None


def test_reader_text(value):
    body = "word " * 40
    assert value(T.reader_text, f"Title: x\r\nMarkdown Content:\n\n {body}\n\n end") == f"{body.strip()}\nend"
    assert value(T.reader_text, "short") is None


def test_articles_gate(value):
    assert value(T.like_article, "w" * 120) and not value(T.like_article, "w" * 119) and not value(T.like_article, "Access denied " + "w" * 200) and not value(T.like_article, "w" * 100 + "�" * 30)
    assert value(T.english_enough, "abcé") and not value(T.english_enough, "abéé") and not value(T.english_enough, "12")


@pytest.mark.parametrize(("text", "want"), [("2024-01-02", "2024-01-02 00:00:00"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("20240102", "2024-01-02 00:00:00"), ("2024", None), ("x", None), (None, None), ("2024-13-01", None)])
def test_timestamp(value, text, want):
    got = value(lambda t: D.timestamp(t.cast("string")).cast("string"), text)
    assert got == want


@pytest.mark.parametrize(("text", "want"), [("on Mar. 5, 2021 x", "2021-03-05"), ("by 2020-02-03", "2020-02-03"), ("7 June 2019", "2019-06-07"), ("Feb 31, 2020 and 2020-02-28", "2020-02-28"), ("none", None)])
def test_date_in(value, text, want):
    got = value(D.date_in, text)
    assert (got and str(got.date())) == want


def test_claim_time(value):
    at = F.lit(dt.datetime(2024, 6, 1))
    assert value(lambda c: D.claim_time(c, at), "In 2021 and 2022").year == 2021
    assert value(lambda c: D.claim_time(c, at), "never").month == 6


def test_weeks(value):
    got = value(lambda: D.weeks(F.lit("2024-01-05").cast("date"), F.lit("2024-01-05").cast("date")))
    assert len(got) == 5 and got[0].week == "2024-01-01" and got[0].stop == "20240107235959" and got[-1].stop == "20240131235959"


def test_numbers(value):
    close = lambda a, b: a == pytest.approx(b, abs=1e-9)
    assert close(value(lambda a, b: M.relevance(M.cosine(a, b)), [1.0, 0.0], [1.0, 0.0]), 0.9999995000005)
    assert close(value(lambda n: M.evidence_amount(n), 3), 0.4511883639) and value(lambda n: M.evidence_amount(n), 0) == 0
    assert close(value(lambda n: M.claim_scope(n), 3), 0.4190597842) and value(lambda n: M.claim_scope(n), 0) == 1
    assert close(value(lambda n: M.shrink(n, F.lit(0.6), F.lit(0.8)), 5), 0.7) and close(value(lambda n: M.shrink(n, F.lit(0.6), F.lit(0.8)), 0), 0.8)
    assert value(lambda x: M.clip01(x), float("nan")) == 0 and value(lambda x: M.clip01(x), 2.0) == 1


def test_support_and_contradiction(value):
    args = (["revenue", "increase"], ["revenue", "decrease", "not"], ["revenue"], ["revenue"])
    assert value(M.support, *args) == pytest.approx(0.75)
    assert value(M.contradiction, *args) == pytest.approx(0.5)


def test_claim_shares(value):
    assert value(M.measurable, ["accuracy 90%", "latency", "model"]) == pytest.approx(1 / 3)
    assert value(lambda: M.hedging(F.array().cast("array<string>"))) == 1
    assert value(M.hedging, ["may", "x"]) == 0.5


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('x <json>{"ESS": {"score": 0.7, "confidence": 0.9}}</json> y', (0.7, 0.9)), ('text {"ESS": 0.7} end', (0.7, 0.5)), ('<json>{bad</json> {"ESS": 1}', (0.0, 0.0)), ("none", (0.0, 0.0)), (None, (0.0, 0.0)),
        ('{"ESS": {"score": "x"}}', (0.0, 0.0)), ('{"ESS": 7}', (1.0, 0.5)),
    ],
)
def test_judge_metric(value, reply, want):
    got = value(lambda r: M.judge_metric(M.json_block(r.cast("string")), "ESS"), reply)
    assert (got.score, got.confidence) == want


def test_json_list(value):
    assert value(M.json_list, '["a", "b"]') == ["a", "b"] and value(M.json_list, 'x ["a"] y') == ["a"] and value(M.json_list, "no") == []


@settings(max_examples=25, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.text(alphabet="ab \n\t.?!A|1é", max_size=60))
def test_strip_and_collapse_are_python_s(value, text):
    assert value(T.strip, text) == text.strip()
    assert value(T.collapse, text) == " ".join(text.split())
