"""The weekly collection, datasets by split, settings and strict replies."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia import __main__ as jobs
from evidentia.functions import math as M
from evidentia.plans import scrape, service
from evidentia.sources import datasets, sinks

LONG = "An English sentence that says what the press has to say. " * 5


def _made():  # functions made in a function travel to workers whole
    import json

    text = LONG

    def site(url):
        """Lists under list:, pages elsewhere; mobile pages of number 2 are refused."""
        if url.startswith("list:"):
            domain, week = url[5:].split("/")
            one = {"url": f"http://{domain}/{week[:8]}/1", "url_mobile": f"http://m.{domain}/{week[:8]}/1", "language": "English"}
            return 200, json.dumps({"articles": [one, {"url": f"http://{domain}/{week[:8]}/2", "url_mobile": f"http://m.{domain}/{week[:8]}/2", "language": "French"}]})
        if "//m." in url and url.endswith("/2"):
            return 403, None
        return 200, f"<html><body><article><p>{text}{url}</p></article></body></html>"

    def address(domain, start, stop):
        return f"list:{domain}/{start}"

    return site, address


site, address = _made()


def test_scrape(spark, tmp_path):
    run = lambda resume: scrape.scrape(spark, site, address, str(tmp_path), ["cnn.com", "reuters.com", "cnbc.com"], "2024-02", "2024-02", resume, tries=1, base=0.0).collect()
    first = {(r.domain, r.week): (r.status, r.listed, r.with_text) for r in run(False)}
    weeks = [f"2024-02-{d:02}" for d in (1, 8, 15, 22, 29)]
    assert first == {(d, w): ("done", 2, 1 if d == "reuters.com" else 2) for d in ("cnn.com", "reuters.com", "cnbc.com") for w in weeks}
    read = lambda: spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(f"{tmp_path}/articles")
    got = read()
    cnn = {r.url[-1]: r.article_text.split()[-1].split("//")[1][:2] for r in got.where("domain = 'cnn_com'").collect()}
    assert cnn == {"1": "m.", "2": "cn"}  # the mobile page, and the other one where it is refused
    assert got.where("domain = 'cnbc_com' and article_text like '%//m.%'").isEmpty()
    assert {r.language for r in got.where("domain = 'reuters_com'").collect()} == {"English"}
    before = got.count()
    assert run(True) == [] and read().count() == before
    assert len(run(False)) == len(first) and read().count() == before  # a week that comes again takes the place of the old


def test_scrape_comes_again(spark, tmp_path):
    down = lambda url: (429, None) if "cnn" in url else (200, '{"articles": []}')
    run = lambda fetch, resume: {(r.domain, r.status, r.listed) for r in scrape.scrape(spark, fetch, address, str(tmp_path), ["cnn.com", "cnbc.com"], "2024-02", "2024-02", resume, tries=1).collect()}
    assert run(down, True) == {("cnn.com", "limited", 0), ("cnbc.com", "done", 0)}
    assert run(site, True) == {("cnn.com", "done", 2)}


def test_job_by_command(spark, tmp_path, capsys):
    jobs.main(["scrape", "--start", "2024-02", "--end", "2024-02", "--target", str(tmp_path), "--domains", "cnbc.com", "--fetch", f"{__name__}:site", "--address", f"{__name__}:address"])
    assert capsys.readouterr().out.count("|done") == 5
    with pytest.raises(SystemExit):
        jobs.main(["scrape"])


def test_weekly_files_replace_a_week(spark, tmp_path):
    for text in ("old", "new"):
        sinks.weekly_csv(spark.createDataFrame([("a.com", "w1", text)], ["domain", "week", "text"]), str(tmp_path))
    sinks.weekly_csv(spark.createDataFrame([("a.com", "w2", 'a "quoted"\nline')], ["domain", "week", "text"]), str(tmp_path))
    got = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path)).collect()
    assert sorted((r.week, r.text) for r in got) == [("w1", "new"), ("w2", 'a "quoted"\nline')]


def test_dataset_by_split(spark, tmp_path):
    for split, rows in (("train", 3), ("test", 2)):
        for i in range(2):
            (tmp_path / f"{split}-{i:05}.json").write_text("\n".join(json.dumps({"text": f"{split}{i}{n}"}) for n in range(rows)))
    assert datasets.dataset(spark, str(tmp_path), "train", "json").count() == 6 and datasets.dataset(spark, str(tmp_path), fmt="json").count() == 10
    stream = datasets.dataset(spark, str(tmp_path), "test", "json", "text string", streaming=True, most_files=1)
    assert stream.isStreaming
    found, state = str(tmp_path / "found"), str(tmp_path / "state")
    for _ in range(2):  # a second run of the query reads nothing again
        stream.writeStream.format("parquet").option("path", found).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(found).collect()) == ["test00", "test01", "test10", "test11"]


def test_settings():
    given = service.Settings.of({"AWS_REGION": "r", "LLM_MODEL": "", "AUTH_TOKEN": "t"})
    assert (given.region, given.model, given.token, given.log_level) == ("r", "", "t", "INFO")
    assert service.health(given, ["m"]) == {"service": "ok", "region": "r", "model": ["m"]}


def test_authorised(spark):
    rows = spark.createDataFrame([("Bearer t",), ("Bearer x",), ("t",), (None,)], "h string")
    assert [r[0] for r in rows.select(service.authorised(F.col("h"), "t")).collect()] == [True, False, False, False]
    assert all(r[0] for r in rows.select(service.authorised(F.col("h"), "")).collect())


@pytest.mark.parametrize("text", ["{}", '{"a": [1, {"b": null}]}', " 12 ", '"x"', "[]", "null", "", " ", "{} x", "1, 2", '1, "w": 2', "1], [2", '1} {"a": 2', '{"a": 1}</json>', "{", "x", None])
def test_is_json(spark, text):
    def plain():
        try:
            json.loads(text)
            return True
        except (TypeError, ValueError):
            return False

    assert spark.createDataFrame([(text,)], "t string").select(M.is_json(F.col("t"))).first()[0] is plain()


def test_no_site_is_called_above_its_rate(spark, tmp_path):
    """Real clocks in as many tasks as there are partitions: calls of one site are apart, those of others go on meanwhile."""
    from evidentia.sources import fetch

    log, interval = str(tmp_path / "calls"), 0.03

    def logged(url):
        import time

        with open(log, "a") as f:
            f.write(f"{time.time()} {fetch.site(url)}\n")
        return (503, None) if url.endswith("/0") else (200, url)

    urls = [(f"http://{h}.{s}.com/{i}", f"http://www.{s}.com/again/{i}") for s in ("a", "b", "c") for h in ("m", "www") for i in range(8)]
    rows = spark.createDataFrame(urls, "url string, again string").repartition(16)
    got = fetch.fetch_all(rows, logged, "url", "again", threads=6, interval=interval).collect()
    assert sum(r.body is not None for r in got) == 42
    calls = {}
    for line in open(log):
        at, name = line.split()
        calls.setdefault(name, []).append(float(at))
    assert set(calls) == {"a.com", "b.com", "c.com"} and all(len(x) == 18 for x in calls.values())
    for times in calls.values():
        times.sort()
        assert all(later - earlier > interval * 0.7 for earlier, later in zip(times, times[1:]))
    sites = spark.createDataFrame([("http://u@M.x.CO.uk:80/p",), ("data:,x",), (None,), ("http://host/p",)], "u string")
    assert [r[0] for r in sites.select(fetch.site_of(F.col("u"))).collect()] == [fetch.site(r.u) for r in sites.collect()] == ["co.uk", "", "", "host"]


def test_searches_wait_for_one_another(spark):
    from evidentia.sources import feeds, fetch

    waits, now = [], [0.0]

    def sleep(seconds):
        waits.append(round(seconds, 6))
        now[0] += seconds

    paced = fetch.Paced(lambda u: (200, u), 6.0, sleep, lambda: now[0])
    assert [paced(f"http://s/{i}")[0] for i in range(3)] == [200] * 3 and waits == [6.0, 6.0]
    paced("http://other/1")
    assert waits == [6.0, 6.0]
    work = spark.createDataFrame([("d", str(i), "", "", f"data:,{i}") for i in range(3)], "domain string, week string, start string, stop string, at string")
    assert {r.status for r in feeds.article_lists(work, fetch.data_url, "at", tries=1, interval=0.01).collect()} == {"done"}
    assert fetch.data_url("data:text/plain,a%20b") == (200, "a b") and fetch.data_url("http://x,y") == (400, None)
