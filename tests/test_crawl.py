import threading
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spandrel.operators.crawl import CrawlOptions, crawl, reach
from spandrel.plans.audit import audit_site
from spandrel.sources.config import RuntimeOptions
from spandrel.sources.http import HttpFetcher, HttpProber, Pace
from spandrel.sources.snapshots import RecordedFetcher, SnapshotFetcher


def body(*links):
    return "<title>t</title>" + "".join(f'<a href="{x}">{x}</a>' for x in links)


def keys(done):
    return [r.page_key for r in done.pages.orderBy("seq").collect()]


SITE = RecordedFetcher({"http://h": body("/", "/a#x", "/a#y", "/pic.png", "http://o/", "mailto:z", "/b"), "http://h/": body("/c"), "http://h/a#x": body("/d"), "http://h/b": {"error": "connection failed"}, "http://h/c": body(), "http://h/d": {"body": None, "content_type": "application/pdf"}, "http://o/": body()})


def test_breadth_first_in_order_of_links(spark):
    done = crawl(spark, "http://h", SITE)
    assert keys(done) == ["http://h", "http://h/", "http://h/a", "http://h/b", "http://h/c", "http://h/d"]
    by = {r.page_key: r for r in done.pages.collect()}
    assert by["http://h/a"].url == "http://h/a#x"  # the first spelling is fetched, without fragment it is the key
    assert by["http://h/b"].error == "connection failed" and by["http://h/b"].links == [] and by["http://h/b"].status_code is None
    assert by["http://h/d"].title is None and by["http://h/d"].crawl_depth == 2


def test_depth_budget_scope_and_fragments(spark):
    assert keys(crawl(spark, "http://h", SITE, CrawlOptions(max_depth=0))) == ["http://h"]
    assert keys(crawl(spark, "http://h", SITE, CrawlOptions(max_pages=3))) == ["http://h", "http://h/", "http://h/a"]
    assert "http://o/" in keys(crawl(spark, "http://h", SITE, CrawlOptions(max_depth=1, follow_external=True)))
    assert "http://h/a#y" in keys(crawl(spark, "http://h", SITE, CrawlOptions(max_depth=1, keep_fragments=True)))
    assert keys(crawl(spark, "http://h", SITE, CrawlOptions(max_pages=0))) == []


def test_blocked_pages_use_up_the_budget(spark):
    site = RecordedFetcher(SITE.responses, "User-agent: *\nDisallow: /a")
    done = crawl(spark, "http://h", site, CrawlOptions(max_pages=4))
    assert keys(done) == ["http://h", "http://h/", "http://h/b"]
    assert done.visited.count() == 4
    assert len(keys(crawl(spark, "http://h", site, CrawlOptions(max_pages=4, respect_robots=False)))) == 4


def test_bad_seeds(spark):
    for seed in ("ftp://h", "nothing"):
        with pytest.raises(ValueError, match="Invalid URL"):
            crawl(spark, seed, SITE)


def by_queue(graph, blocked, depth, budget):
    queue, seen, out = deque([("http://h/0", 0)]), [], []
    while queue and len(seen) < budget:
        url, at = queue.popleft()
        if url in seen or at > depth:
            continue
        seen.append(url)
        if url in blocked:
            continue
        out.append(url)
        if at < depth:
            queue += [(x, at + 1) for x in graph.get(url, []) if x not in seen]
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 9), max_size=4), min_size=10, max_size=10), st.sets(st.integers(1, 9), max_size=3), st.integers(0, 3), st.integers(1, 10))
def test_levels_equal_a_queue(spark, edges, blocked, depth, budget):
    graph = {f"http://h/{i}": [f"http://h/{j}" for j in js] for i, js in enumerate(edges)}
    site = RecordedFetcher({u: body(*to) for u, to in graph.items()}, "User-agent: *\n" + "\n".join(f"Disallow: /{i}$" for i in blocked))
    done = crawl(spark, "http://h/0", site, CrawlOptions(max_depth=depth, max_pages=budget))
    assert keys(done) == by_queue(graph, {f"http://h/{i}" for i in blocked}, depth, budget)


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", None)], "source string, target string")
    seeds = spark.createDataFrame([("a",), (None,), ("a",), ("z",)], "node string")
    assert {(r.node, r.depth) for r in reach(seeds, edges, 2).collect()} == {("a", 0), ("z", 0), ("b", 1), ("c", 2)}
    assert reach(seeds, edges.limit(0), 5).count() == 2
    assert reach(seeds.limit(0), edges, 5).count() == 0


def test_snapshot_defaults(spark):
    todo = spark.createDataFrame([("u", "u", 0, 0), ("v", "v", 0, 1)], "url string, page_key string, depth int, seq bigint")
    got = {r.url: r for r in SnapshotFetcher(spark.createDataFrame([("u", "b")], "url string, body string")).fetch(todo).collect()}
    assert (got["u"].status_code, got["u"].content_type, got["u"].error) == (200, "text/html", None)
    assert (got["v"].status_code, got["v"].error) == (None, "connection failed")


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        pages = {"/": (200, "text/html", body("/ok", "/gone", "/moved", "/file.json?x", "/secret")), "/ok": (200, "text/html", "<title>für</title>"), "/gone": (404, "text/html", "<title>gone</title>"), "/data": (200, "application/json", "{}"), "/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret")}
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/ok")
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        status, kind, text = pages.get(self.path, (500, "text/html", "<title>error</title>"))
        data = text.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_over_http(spark, server):
    events = []
    options = RuntimeOptions(url=f"{server}/", depth=1)
    done = audit_site(spark, options, HttpFetcher(), HttpProber(), lambda kind, value: events.append(kind))
    by = {r.page_key.removeprefix(server): r for r in done.pages.collect()}
    assert set(by) == {"/", "/ok", "/gone", "/moved"}  # /secret is blocked, the JSON file no page
    assert by["/ok"].title == "für" and by["/gone"].status_code == 404 and by["/moved"].status_code == 200
    messages = [i.message for i in by["/"].issues]
    assert f"Broken link: {server}/gone (HTTP 404)" in messages
    assert f"Link redirected: {server}/moved -> {server}/ok" in messages
    assert f"Broken link: {server}/secret (HTTP 500)" in messages
    assert [x.status_code for x in by["/"].links] == [200, 404, 200, 500, 500]
    assert events[0] == "started" and "progress" in events


def test_unreachable_and_skipped(spark):
    got = {r.url: r for r in HttpProber(timeout=2).probe(spark.createDataFrame([("http://127.0.0.1:9/",), ("mailto:a@b",)], "url string")).collect()}
    assert (got["http://127.0.0.1:9/"].outcome, got["http://127.0.0.1:9/"].error) == ("TransportFailure", "connection failed")
    assert got["mailto:a@b"].outcome == "SkippedUnsupportedScheme"
    assert HttpFetcher(timeout=2).robots(__import__("spandrel.functions.urls", fromlist=["parse"]).parse("http://127.0.0.1:9/")) is None


def test_limits_are_checked():
    for bad in (0, -1):
        with pytest.raises(ValueError, match="above 0"):
            HttpFetcher(rate=bad)
    with pytest.raises(ValueError, match="at least 1"):
        HttpFetcher(threads=0)
    assert Pace(0.5).quota == 1
    Pace(None).wait()
