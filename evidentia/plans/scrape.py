"""The weekly collection of news: lists by domain and week, pages, article texts, files and a manifest."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import dates as D
from evidentia.functions import text as T
from evidentia.operators import curate
from evidentia.plans.service import only_english
from evidentia.sources import decode, feeds, sinks
from evidentia.sources.fetch import Fetcher, fetch_all
from evidentia.tables import stored

KEYS = ["domain", "week"]


def work(spark: SparkSession, domains: Sequence[str], first: str, last: str) -> DataFrame:
    """domain, week, start and stop for each domain and week of the months ``first`` to ``last`` (yyyy-MM)."""
    month = lambda m: F.to_date(F.lit(m), "yyyy-MM")
    rows = spark.createDataFrame([(d,) for d in domains], "domain string").select("domain", F.explode(D.weeks(month(first), month(last))).alias("w"))
    return rows.select("domain", "w.week", "w.start", "w.stop")


def scrape(
    spark: SparkSession, fetch: Fetcher, address: Callable[[str, str, str], str], target: str, domains: Sequence[str], first: str, last: str, resume: bool = False,
    reader: Fetcher | None = None, reader_hosts: tuple[str, ...] = (), english: str = "reuters.com", mobile: tuple[str, ...] = ("cnn.com",), tries: int = 5, base: float = 6.0, threads: int = 20, sleep: Callable[[float], None] = time.sleep, list_interval: float = 0.0, page_interval: float = 0.0,
) -> DataFrame:
    """Collect articles and return domain, week, status, and the numbers of articles listed and of those with a text.

    Files go to ``target/articles``, a folder per domain and week; statuses to ``target/progress``.  With ``resume``,
    weeks that the manifest names as done are left out; others come again.  Of the ``english`` domain, only articles
    listed as English stay, and texts that do not look English are null; those of ``mobile`` domains are asked for at
    their mobile address first.  Each address is asked once: lists and pages are stored before they are counted.  The
    intervals are the seconds between two calls of the search, and of one site's pages.
    """
    progress = f"{target}/progress"
    todo = work(spark, domains, first, last)
    if resume and sinks.exists(spark, progress):
        todo = curate.pending(todo, spark.read.parquet(progress), KEYS)
    lists = stored(feeds.article_lists(todo.repartition(*KEYS), fetch, address, tries, base, sleep, list_interval), "lists")
    rows = only_english(lists.select(*KEYS, F.explode("articles").alias("a")).select(*KEYS, "a.url", "a.title", F.col("a.seendate").alias("seen"), "a.language", F.nullif("a.url_mobile", F.lit("")).alias("_mobile")), english)
    first_address = F.when(F.col("domain").isin(*mobile), F.coalesce("_mobile", "url")).otherwise(F.col("url"))
    rows = rows.withColumn("_first", first_address).withColumn("_second", F.when(F.col("_first") != F.col("url"), F.col("url"))).repartition("url")
    found = decode.articles(fetch_all(rows, fetch, "_first", "_second", threads, reader, reader_hosts, page_interval), "body", "url")
    body = F.col("article_text")
    good = T.like_article(body) & ((F.col("domain") != english) | T.english_enough(body))
    texts = stored(found.withColumn("article_text", F.when(good, body)).drop("body", "_first", "_second", "_mobile"), "articles")
    sinks.weekly_csv(texts, f"{target}/articles")
    sinks.mark(spark, progress, lists.select(*KEYS, "status"))
    with_text = texts.groupBy(*KEYS).agg(F.count("article_text").alias("with_text"))
    counts = lists.select(*KEYS, "status", F.coalesce(F.size("articles"), F.lit(0)).alias("listed")).withColumn("listed", F.greatest(F.lit(0), "listed").cast("bigint"))
    return counts.join(with_text, KEYS, "left").fillna(0, ["with_text"])
