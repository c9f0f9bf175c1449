"""Jobs by command: ``python -m evidentia scrape --start 2020-01 --end 2020-03 --resume ...``."""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from evidentia.plans.scrape import scrape
from evidentia.session import session


def _named(name: str) -> Any:
    """What ``module:name`` stands for."""
    module, _, item = name.partition(":")
    return getattr(importlib.import_module(module), item)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evidentia", description="Jobs of the evidence engine")
    jobs = parser.add_subparsers(dest="job", required=True)
    news = jobs.add_parser("scrape", help="collect news by domain and week")
    news.add_argument("--start", default="2020-01", help="first month, yyyy-MM")
    news.add_argument("--end", default="2026-03", help="last month, yyyy-MM")
    news.add_argument("--resume", action="store_true", help="leave out weeks that are done")
    news.add_argument("--target", required=True, help="folder of the files and the manifest")
    news.add_argument("--domains", nargs="+", required=True)
    news.add_argument("--fetch", required=True, help="module:name of a call from an address to (status, body)")
    news.add_argument("--address", required=True, help="module:name of a call from domain, start and stop to an address")
    given = parser.parse_args(arguments)
    scrape(session(), _named(given.fetch), _named(given.address), given.target, given.domains, given.start, given.end, given.resume).orderBy("domain", "week").show(1000, truncate=False)


if __name__ == "__main__":
    main()
