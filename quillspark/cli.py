"""Command line: crawl and serve."""

from __future__ import annotations

import argparse
import logging
import os
import re
import signal
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import server
from .engine import Engine
from .operators import crawl, tables
from .sources.base import Fetcher, fetched
from .sources.wordpress import BASE, CLASSES, WordPress

SOURCES = {"wordpress": WordPress}
#: Seconds between two lines on a crawl's progress.
PROGRESS_S = 30


def seconds(text: str) -> float:
    """A duration: a number of seconds, or numbers with units, as in "1m30s", "500ms" or "2h"."""
    units = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
    found = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)", text)
    if found and "".join(map("".join, found)) == text:
        return sum(float(n) * units[u] for n, u in found)
    return float(text)


def setting(name: str, default, kind=str):
    """An environment variable's value; a malformed one is warned about and left out."""
    value = os.environ.get(name)
    if value is None:
        return default
    try:
        return kind(value)
    except ValueError:
        logging.warning("%s: %r is malformed; using %r", name, value, default)
        return default


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="fetch, parse, store and index a source")
    c.add_argument("--source", default="wordpress", choices=SOURCES)
    c.add_argument("--store", default="./data/store")
    c.add_argument("--workers", type=int, default=10)
    c.add_argument("--rps", type=float, default=10.0)
    c.add_argument("--resume", action="store_true", help="only what an interrupted session has left")
    c.add_argument("--retry-failed", action="store_true", help="only what failed for a reason that may pass")
    s = sub.add_parser("serve", help="answer queries over HTTP")
    s.add_argument("--store", default="./data/store")
    s.add_argument("--port", type=int, default=8080)
    return p


def listed(spark: SparkSession, source, args) -> DataFrame:
    """(url, slug, tier) of a source's entities, from its listing pages; one that can't be fetched is warned about."""
    _, pages = source.listing(Fetcher(args.rps)(BASE + CLASSES))
    urls = spark.createDataFrame([(BASE + CLASSES if k == 1 else f"{BASE}{CLASSES}page/{k}/",) for k in range(1, pages + 1)], "url string")
    listing = fetched(urls, Fetcher, args.workers, args.rps).cache()
    for r in listing.where("error is not null").toLocalIterator():
        logging.warning("listing page %s: %s", r.url, r.error)
    return crawl.discovered(listing.where("error is null"), source)


class Ticker:
    """Calls say() every so many seconds, in a thread of its own, while its block runs."""

    def __init__(self, say: Callable[[], None], every: float = PROGRESS_S):
        self.say, self.every, self.stop = say, every, threading.Event()

    def _run(self) -> None:
        while not self.stop.wait(self.every):
            try:
                self.say()
            except Exception:  # a report that fails must not end a crawl
                logging.exception("progress")

    def __enter__(self) -> Ticker:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()


def progress_line(engine: Engine, library_id: str) -> str:
    """How far a library's last session is."""
    last = engine.store.read("sessions").where(F.col("library_id") == library_id).orderBy(F.col("id").desc()).first()
    if last is None:
        return "no session"
    stats = tables.crawl_stats(engine.store.read("progress").where(F.col("session_id") == last.id)).first()
    return f"session {last.id}: {stats.success if stats else 0} done, {stats.failed if stats else 0} failed, {last.total_urls} entities listed"


def run_crawl(engine: Engine, args) -> int:
    source, session, again = SOURCES[args.source](), None, None
    last = engine.store.read("sessions").where(F.col("library_id") == source.id).orderBy(F.col("id").desc()).first()
    progress = engine.store.read("progress").where(F.col("session_id") == last.id) if last else None
    methods = lambda failed: failed.where("item_type = 'method'").select("url", F.col("parent_entity").alias("entity_slug"))
    if last and args.retry_failed:
        session, failed = last.id, tables.retryable(progress)
        found, again = failed.where("item_type = 'entity'"), methods(failed)
    elif last and args.resume and last.status != "completed":  # a killed crawl stays in_progress
        session = last.id
        found, again = tables.remaining(listed(engine.spark, source, args), progress), methods(tables.failures(progress))
    else:
        found = listed(engine.spark, source, args)
    with Ticker(lambda: logging.info("%s", progress_line(engine, source.id)), setting("PROGRESS_INTERVAL", PROGRESS_S, seconds)):
        session = engine.crawl(source, found, lambda urls: fetched(urls, Fetcher, args.workers, args.rps).cache(), session, again)
    print(crawl.summary(engine.store.read("progress"), session))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.store)
    if args.command == "crawl":
        return run_crawl(engine, args)
    signal.signal(signal.SIGTERM, signal.default_int_handler)
    web = server.serve(engine, port=setting("PORT", args.port, int), origin=setting("CORS_ORIGIN", "*"))
    try:
        web.serve_forever()
    except KeyboardInterrupt:
        web.drain()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
