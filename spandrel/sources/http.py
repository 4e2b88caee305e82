"""The web as a source: pages, robots.txt and probes, fetched from within partitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed, wait
from dataclasses import dataclass
from math import ceil
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.urls import CRAWL_SCHEMES, Url, host_of, normalize, robots_url, try_parse
from spandrel.operators.linkcheck import FAILED, REACHABLE, SKIPPED
from spandrel.schemas import FETCH, PROBE

# Timeouts in seconds and the most redirects followed.
PAGE_TIMEOUT, PROBE_TIMEOUT, MAX_REDIRECTS = 30, 10, 10
#: Probes that are handed on together.
HANDED_ON = 100
HEADERS = {
    "User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
}


def session(accept: str | None = None):  # noqa: ANN201
    """A session that keeps connections, decompresses, and follows redirects."""
    import requests

    s = requests.Session()
    s.headers.update(HEADERS | ({"Accept": accept} if accept else {}))
    s.max_redirects = MAX_REDIRECTS
    return s


def error_text(e: Exception) -> str:
    """What went wrong with a request; a timeout while connecting is a timeout."""
    import requests

    if isinstance(e, requests.Timeout):
        return "request timed out"
    if isinstance(e, requests.ConnectionError):
        return "connection failed"
    if isinstance(e, requests.TooManyRedirects) or not isinstance(e, requests.RequestException):
        return "unexpected request error"
    return "request failed"


class Pace:
    """At most so many requests a second, the quota of a second at once."""

    def __init__(self, per_second: float | None) -> None:
        if per_second is not None and per_second <= 0:
            raise ValueError("the rate limit must be above 0")
        self.quota = None if per_second is None else ceil(per_second)
        self.free, self.at, self.lock = float(self.quota or 0), time.monotonic(), Lock()

    def wait(self) -> None:
        while self.quota:
            with self.lock:
                now = time.monotonic()
                self.free = min(self.quota, self.free + (now - self.at) * self.quota)
                self.at = now
                if self.free >= 1:
                    self.free -= 1
                    return
                pause = (1 - self.free) / self.quota
            time.sleep(pause)


def _is_html(content_type: str | None) -> bool:
    return content_type is None or any(x in content_type.lower() for x in ("text/html", "application/xhtml"))


def _page(s, url: str, timeout: float) -> dict:  # noqa: ANN001
    try:
        with s.get(url, timeout=timeout, stream=True) as r:
            kind = r.headers.get("content-type")
            body = r.content.decode("utf-8", "replace") if _is_html(kind) else None
            return {"status_code": r.status_code, "content_type": kind, "body": body, "final_url": r.url, "error": None}
    except Exception as e:  # noqa: BLE001
        return {"status_code": None, "content_type": None, "body": None, "final_url": None, "error": error_text(e)}


def _probe(s, url: str, timeout: float) -> dict:  # noqa: ANN001
    parsed = try_parse(url)
    if parsed is not None and parsed.scheme not in CRAWL_SCHEMES:
        return {"outcome": SKIPPED, "status_code": None, "redirected_url": None, "error": None}
    try:
        with s.get(url, timeout=timeout, stream=True) as r:
            moved = normalize(r.url) != normalize(url)
            return {"outcome": REACHABLE, "status_code": r.status_code, "redirected_url": r.url if moved else None, "error": None}
    except Exception as e:  # noqa: BLE001
        return {"outcome": FAILED, "status_code": None, "redirected_url": None, "error": error_text(e)}


@dataclass(frozen=True)
class HttpFetcher:
    """Fetches what it is given: ``tasks`` partitions with ``threads`` requests each at once, at ``rate`` in all.

    Without ``tasks`` there are as many as the cluster runs at once, or with a rate one, which alone can keep it exactly.
    The addresses of a host are in one of them, so that
    what a host gets stays bounded; a rate is shared out among given tasks, and pages are handed on as they come.

    A request is a side effect that a retried task repeats; callers write the result down before they use it.
    """

    tasks: int | None = None
    threads: int = 5
    rate: float | None = None
    timeout: float = PAGE_TIMEOUT

    def __post_init__(self) -> None:
        if self.threads < 1 or self.tasks is not None and self.tasks < 1:
            raise ValueError("the concurrency must be at least 1")
        Pace(self.rate)

    def fetch(self, todo: DataFrame) -> DataFrame:
        """(url, page_key, depth, seq) as rows of FETCH."""
        tasks, threads, timeout = _tasks(todo, self.tasks or (None if self.rate is None else 1)), self.threads, self.timeout
        rate = None if self.rate is None else ceil(self.rate) / tasks

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, pace = session(), Pace(rate)

            def one(url: str) -> dict:
                pace.wait()
                return _page(s, url, timeout)

            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    for at, got in _as_they_come(pool, one, batch["url"].tolist(), threads):
                        out = batch[["url", "page_key", "depth", "seq"]].iloc[at : at + 1].reset_index(drop=True)
                        yield pd.concat([out, pd.DataFrame([got], columns=["status_code", "content_type", "body", "final_url", "error"], dtype=object)], axis=1)

        return _by_host(todo.select("url", "page_key", "depth", "seq"), tasks).mapInPandas(work, FETCH)

    def robots(self, base: Url) -> str | None:
        """The robots.txt of an origin; None if it can't be had."""
        try:
            with session().get(robots_url(base), timeout=self.timeout) as r:
                return r.content.decode("utf-8", "replace") if 200 <= r.status_code < 300 else None
        except Exception:  # noqa: BLE001
            return None


@dataclass(frozen=True)
class HttpProber:
    """Probes addresses, each once; redirects are followed, bodies not read. ``tasks`` as of HttpFetcher."""

    tasks: int | None = None
    threads: int = 20
    timeout: float = PROBE_TIMEOUT

    def probe(self, urls: DataFrame, done: Callable[[int], None] | None = None) -> DataFrame:
        """(url) as rows of PROBE; the urls should be distinct. ``done`` is told, in the tasks, of each batch's number."""
        threads, timeout = max(1, self.threads), self.timeout

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = session()
            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    for part in range(0, len(batch), HANDED_ON):
                        own = batch[["url"]].iloc[part : part + HANDED_ON].reset_index(drop=True)
                        got = pd.DataFrame(list(pool.map(lambda u: _probe(s, u, timeout), own["url"])), columns=["outcome", "status_code", "redirected_url", "error"], dtype=object)
                        if done:
                            done(len(own))
                        yield pd.concat([own, got], axis=1)

        return _by_host(urls.select("url"), _tasks(urls, self.tasks)).mapInPandas(work, PROBE)


def _tasks(todo: DataFrame, wanted: int | None) -> int:
    return wanted or todo.sparkSession.sparkContext.defaultParallelism


def _by_host(todo: DataFrame, tasks: int) -> DataFrame:
    """``todo`` in ``tasks`` partitions, the addresses of a host together."""
    return todo.repartition(tasks, F.coalesce(host_of(F.col("url")), F.lit("")))


def _as_they_come(pool: ThreadPoolExecutor, work: Callable[[str], dict], urls: list[str], threads: int) -> Iterator[tuple[int, dict]]:
    """(place, result) of ``work`` on each of ``urls``, as soon as each is done; few are in flight or wait at once."""
    waiting: dict = {}
    for at, url in enumerate(urls):
        waiting[pool.submit(work, url)] = at
        if len(waiting) >= 2 * threads:
            done, _ = wait(waiting, return_when=FIRST_COMPLETED)
            yield from ((waiting.pop(x), x.result()) for x in done)
    for x in as_completed(list(waiting)):
        yield waiting[x], x.result()
