"""Fetches behind an interface: retries, status rows, and a bounded number of calls in flight."""

from __future__ import annotations

import base64
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fetcher takes a url and gives (status, body); it may raise.
Fetcher = Callable[[str], tuple[int, str | None]]


def site(url: str | None) -> str:
    """The last two labels of a url's host: what shares a rate, with its mobile and www addresses."""
    parts = (url or "").split("/")
    host = parts[2].rsplit("@", 1)[-1].split(":")[0].lower() if len(parts) > 2 and parts[0].endswith(":") else ""
    return ".".join(host.split(".")[-2:])


def site_of(url: Column) -> Column:
    """The same as a column."""
    host = F.split_part(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/]*:/[^/]*/([^/]*)", 1)), r"^.*@", ""), F.lit(":"), F.lit(1))
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


class Paced:
    """A fetcher that calls each site at most once in ``interval`` seconds, failures and retries included.

    One task's worth of state: rows of a site must be in one task, as ``lanes`` deals them.  Threads may share it.
    """

    def __init__(self, fetch: Fetcher, interval: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.fetch, self.interval, self.sleep, self.clock = fetch, interval, sleep, clock
        self.free: dict[str, float] = {}
        self.lock = threading.Lock()

    def __call__(self, url: str) -> tuple[int, str | None]:
        with self.lock:
            now, name = self.clock(), site(url)
            at = max(now, self.free.get(name, now))
            self.free[name] = at + self.interval
        if at > now:
            self.sleep(at - now)
        return self.fetch(url)


def lanes(rows: DataFrame, column: str) -> DataFrame:
    """All rows of a site in one task: its rate bounds what that task does, however many rows there are."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, site_of(F.col(column)))


def data_url(url: str) -> tuple[int, str | None]:
    """A fetcher for data: addresses, which hold their body; 400 for what is none."""
    head, comma, body = url.partition(",")
    if not comma or not head.lower().startswith("data:"):
        return 400, None
    raw = base64.b64decode(body) if head.lower().endswith(";base64") else unquote_to_bytes(body)
    return 200, raw.decode("utf-8", "replace")


def get_with_retries(fetch: Fetcher, url: str, tries: int = 4, base: float = 0.5, jitter: float = 0.05, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of a 200.  Waits base * 2 ** attempt after 429, 503 and exceptions; raises when tries run out."""
    last: Exception | None = None
    for attempt in range(tries):
        try:
            status, body = fetch(url)
            if status == 200 and body is not None:
                return body
            last = RuntimeError(f"status {status}")
            if status not in (429, 503):
                raise last
        except RuntimeError:
            if attempt == tries - 1 or (last and "429" not in str(last) and "503" not in str(last)):
                raise
        except Exception as e:
            last = e
        sleep(base * 2**attempt + random.random() * jitter)
    raise last or RuntimeError("no try")


def list_articles(fetch: Fetcher, url: str, tries: int = 5, base: float = 6.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """(status, body): done with a body, failed without, or limited if all tries failed and one met a 429."""
    limited = False
    for attempt in range(tries):
        try:
            status, body = fetch(url)
        except Exception:
            status, body = 0, None
        if status == 200:
            return "done", body
        limited |= status == 429
        if attempt == tries - 1:
            break
        sleep(max(base * 2**attempt, 30) if status == 429 else base * 2**attempt)
    return ("limited" if limited else "failed"), None


def fetch_all(urls: DataFrame, fetch: Fetcher, column: str = "url", alternative: str | None = None, threads: int = 20, reader: Fetcher | None = None, reader_hosts: tuple[str, ...] = (), interval: float = 0.0) -> DataFrame:
    """Adds ``body``: of the url, else of the alternative one, else, for ``reader_hosts``, what a reader makes of them;
    null if none answers.  ``threads`` calls per task.

    With an ``interval`` in seconds, a site is called at most once in it, by whatever number of tasks; an alternative
    address must be of the same site then.
    """
    urls = lanes(urls, column) if interval else urls
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", body string"

    def one(candidates: tuple, fetch: Fetcher) -> str | None:
        urls = [u for u in candidates if u]
        tries = [(fetch, u) for u in urls] + [(reader, u) for u in urls if reader and any(h in u.split("/")[2:3] or u.split("/")[2:3] == [f"www.{h}"] for h in reader_hosts)]
        for get, url in tries:
            try:
                status, body = get(url)
            except Exception:
                continue
            if status == 200 and body:
                return body
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = Paced(fetch, interval) if interval else fetch
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                columns = [frame[c] for c in (column, alternative) if c]
                yield frame.assign(body=list(pool.map(lambda c: one(c, get), zip(*columns, strict=True))))

    return urls.mapInPandas(run, shape)
