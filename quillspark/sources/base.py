"""What a documentation source has to offer, and fetching."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetch = Callable[[str], str]
BODY_BYTES, TIMEOUT_S, DEFAULT_RATE = 10 << 20, 30, 5.0


class Source(ABC):
    """An adapter for one site: everything here is plain Python on one page, so that it runs in Arrow batches on executors."""

    id: str

    @abstractmethod
    def meta(self) -> dict:
        """The library's row: id, name, description, source_url, version, trust_score."""

    @abstractmethod
    def listing(self, html: str) -> tuple[list[str], int]:
        """(entity urls of a listing page, how many listing pages there are)."""

    @abstractmethod
    def entity(self, url: str, html: str) -> tuple[dict, list[str]]:
        """(an entity's row with properties, its methods' urls)."""

    @abstractmethod
    def method(self, url: str, html: str) -> dict:
        """A method's row with parameters and relations."""

    @abstractmethod
    def source_code(self, html: str) -> str:
        """A page's source code; ValueError if it has none."""

    @abstractmethod
    def wrapper(self, source_code: str) -> tuple[bool, str, str]:
        """(whether the code only delegates, the target's name, its kind)."""

    @abstractmethod
    def wrapper_url(self, target: str, kind: str, entity_slug: str) -> str:
        """The target's page, or ''."""


class HttpError(Exception):
    pass


class Fetcher:
    """Fetches over HTTP at a rate; 429, 5xx and broken connections are tried again after 1, 2, 4, ... seconds, other answers are not.

    The rate holds for first tries. sleep and open are there to be replaced in tests.
    """

    def __init__(self, rate: float = DEFAULT_RATE, retries: int = 3, agent: str = "quillspark", sleep=time.sleep, open=urllib.request.urlopen):
        self.every = 1 / (rate if rate > 0 else DEFAULT_RATE)
        self.retries, self.agent, self.sleep, self.open, self.free_at = retries, agent, sleep, open, 0.0

    def __call__(self, url: str) -> str:
        now = time.monotonic()
        if self.free_at > now:
            self.sleep(self.free_at - now)
        self.free_at = max(now, self.free_at) + self.every
        error: Exception | None = None
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(2 ** (attempt - 1))
            try:
                with self.open(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=TIMEOUT_S) as answer:
                    return answer.read(BODY_BYTES).decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise HttpError(f"HTTP {e.code}: {url}") from e
                error = HttpError(f"HTTP 429: {url}" if e.code == 429 else f"server error {e.code}: {url}")
            except OSError as e:
                error = HttpError(f"{'timeout' if isinstance(e, TimeoutError) else 'connection failed'}: {url}: {e}")
        raise error


def fetched(urls: DataFrame, make_fetch: Callable[[float], Fetch], workers: int = 10, rate: float = 10.0) -> DataFrame:
    """(url, html, error) for each url: partitions are the workers, each with its share of the rate; errors are values."""
    import pandas as pd

    n = workers if workers > 0 else 10

    def run(batches):
        fetch = make_fetch(rate / n)
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as e:
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").repartition(n).mapInPandas(run, "url string, html string, error string")


def pages_fetch(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """fetched() from a table of pages (url, html and, if there is one, error) instead of a network: a left join. A page not in it is a 404."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    own = pages.select("url", "html", error.alias("error")).dropDuplicates(["url"])
    missing = F.when(F.col("html").isNull(), F.concat(F.lit("HTTP 404: "), "url"))
    return urls.select("url").join(own, "url", "left").withColumn("error", F.coalesce("error", missing))
