"""Listings of articles: a news search by domain and week, RSS feeds, crawl indexes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.corpus import keep_first
from evidentia.sources.fetch import Fetcher, Paced, list_articles

ARTICLES_JSON = "articles array<struct<url:string, title:string, seendate:string, domain:string, language:string, url_mobile:string>>"
RSS_XML = "channel struct<item: array<struct<title:string, link:string, pubDate:string, description:string>>>"
INDEX_JSON = "url string, timestamp string, status string, mime string, filename string, offset string, length string"


def article_lists(work: DataFrame, fetch: Fetcher, address: Callable[[str, str, str], str] | str, tries: int = 5, base: float = 6.0, sleep: Callable[[float], None] = time.sleep, interval: float = 0.0) -> DataFrame:
    """Adds status and articles to rows of domain, week, start and stop, one call each.

    ``address`` makes a call's address, or names the column that holds it.  ``done`` has the reply's articles, none of
    a reply that is no JSON; ``failed`` and ``limited`` have null.  The status goes to a manifest, whose rows that are
    not done come again.  With an ``interval``, calls go one by one, at most one in so many seconds, retries included:
    the search is one site, so that is one task.
    """
    if interval:
        work = work.repartition(1)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema) + ", status string, _body string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = Paced(fetch, interval, sleep) if interval else fetch
        for frame in frames:
            asked = frame[address] if isinstance(address, str) else [address(*row) for row in zip(frame["domain"], frame["start"], frame["stop"], strict=True)]
            got = [list_articles(get, url, tries, base, sleep) for url in asked]
            yield frame.assign(status=[s for s, _ in got], _body=[b for _, b in got])

    found = F.from_json("_body", ARTICLES_JSON).getField("articles")
    empty = F.from_json(F.lit('{"articles": []}'), ARTICLES_JSON).getField("articles")
    return work.mapInPandas(run, shape).withColumn("articles", F.when(F.col("status") == "done", F.coalesce(found, empty))).drop("_body")


def listed_articles(lists: DataFrame) -> DataFrame:
    """domain, week, url, title, seen and language of each listed article; of an address listed twice, the first week's."""
    rows = lists.select("domain", "week", F.explode("articles").alias("a")).select("domain", "week", "a.url", "a.title", F.col("a.seendate").alias("seen"), "a.language")
    return keep_first(rows.where(F.length("url") > 0), ["url"], ["week", "domain", "title"])


def feed_items(feeds: DataFrame, until: F.Column, days: int = 365) -> DataFrame:
    """source, title, url, published and text of (source, body): entries with a date in the last ``days`` days to ``until``.

    A body that is no feed has no items; entries without a date that can be read, or without a link, go.  A date may have
    a fraction of its second.
    """
    items = F.from_xml(F.col("body"), RSS_XML, {"mode": "PERMISSIVE"}).getField("channel").getField("item")
    rows = feeds.select("source", F.explode(items).alias("i"))
    bare = F.regexp_replace(F.col("i.pubDate"), r"^\s*[A-Za-z]+,\s*", "")
    at = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss[.SSSSSS] Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss[.SSSSSS] z")))
    named = rows.select("source", F.col("i.title").alias("title"), F.trim("i.link").alias("url"), at.alias("published"), F.col("i.description").alias("text"))
    return named.where(F.col("published").between(until - F.make_interval(days=F.lit(days)), until) & (F.length("url") > 0))


def index_records(lines: DataFrame, domains: tuple[str, ...] = (), column: str = "line") -> DataFrame:
    """url, timestamp, filename, offset and length of pages that a crawl index names as fetched: status 200, HTML.

    ``domains`` keeps addresses of these hosts and of hosts below them.
    """
    r = lines.select(F.from_json(F.col(column), INDEX_JSON).alias("r")).select("r.*")
    kept = r.where((F.col("status") == "200") & F.contains("mime", F.lit("html")))
    if domains:
        host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]*)", 1))
        kept = kept.where(F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))))
    return kept.select("url", F.to_timestamp("timestamp", "yyyyMMddHHmmss").alias("timestamp"), "filename", F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"))


def crawled_articles(pages: DataFrame, least: int = 200) -> DataFrame:
    """Of pages with url, timestamp and text: those of more than ``least`` characters, the first of each address, with
    the address's host as source."""
    kept = pages.where(F.length("text") > least).withColumn("source", F.split_part("url", F.lit("/"), F.lit(3)))
    return keep_first(kept, ["url"], ["timestamp"])


def holding(rows: DataFrame, word: str, column: str = "text") -> DataFrame:
    """Rows whose text holds the word, in any case and as part of others."""
    return rows.where(F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(word.lower())))
