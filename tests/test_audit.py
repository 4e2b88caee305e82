import pytest
from pyspark.sql import functions as F

from spandrel.operators import linkcheck, rules, summary, views
from spandrel.schemas import ISSUE_TYPES, PAGE, SEVERITIES

OG = {"og_title": "t", "og_description": "d", "og_image": "i", "og_url": "u", "og_type": "w", "og_site_name": None, "og_locale": None}


def page(key="http://h/", **over):
    link = {"url": "http://h/x", "text": "x", "is_external": False, "status_code": None, "redirected_url": None, "check_error": None}
    base = {"page_key": key, "url": key, "status_code": 200, "content_type": "text/html", "title": "t" * 55, "meta_description": "d" * 155, "h1_tags": ["h"], "links": [dict(link, url=f"http://h/{i}") for i in range(4)], "images": [], "issues": [], "open_graph": dict(OG), "crawl_depth": 0}
    return base | over


def frame(spark, *pages):
    return spark.createDataFrame(list(pages), f"page_key string, {PAGE}")


def found(spark, **over):
    return [(i.severity, i.issue_type, i.message) for i in rules.audit(frame(spark, page(**over))).first().issues]


def test_clean_page(spark):
    assert found(spark) == []


@pytest.mark.parametrize(
    ("over", "expected"),
    [
        ({"title": None}, ("Error", "MissingTitle", "Page is missing a title tag")),
        ({"title": " 　"}, ("Error", "MissingTitle", "Page is missing a title tag")),
        ({"title": "a" * 49}, ("Warning", "TitleTooShort", "Title is too short (49 chars, recommended: 50-60)")),
        ({"title": "a" * 61}, ("Warning", "TitleTooLong", "Title is too long (61 chars, recommended: 50-60)")),
        ({"title": "é" * 31}, ("Warning", "TitleTooLong", "Title is too long (62 chars, recommended: 50-60)")),
        ({"meta_description": ""}, ("Error", "MissingMetaDescription", "Page is missing a meta description")),
        ({"meta_description": "a" * 149}, ("Warning", "MetaDescriptionTooShort", "Meta description is too short (149 chars, recommended: 150-160)")),
        ({"meta_description": "a" * 161}, ("Warning", "MetaDescriptionTooLong", "Meta description is too long (161 chars, recommended: 150-160)")),
        ({"h1_tags": [], "images": [{"src": "i", "alt": ""}]}, ("Warning", "MissingH1", "Page is missing an H1 tag")),
        ({"h1_tags": ["a", ""]}, ("Warning", "MultipleH1", "Page has multiple H1 tags (2)")),
        ({"images": [{"src": "i", "alt": None}, {"src": "j", "alt": ""}, {"src": "k", "alt": None}]}, ("Warning", "MissingImageAlt", "2 image(s) missing alt text")),
        ({"links": []}, ("Warning", "ThinContent", "Page may have thin content (few elements found)")),
        ({"open_graph": OG | {"og_image": " "}}, ("Info", "MissingOgImage", "Page is missing og:image tag")),
        ({"open_graph": OG | {"og_type": None}}, ("Info", "MissingOgType", "Page is missing og:type tag")),
    ],
)
def test_each_rule(spark, over, expected):
    assert found(spark, **over) == [expected]
    assert expected[1] in ISSUE_TYPES and expected[0] in SEVERITIES


@pytest.mark.parametrize("size", [50, 60])
def test_title_bounds_are_inclusive(spark, size):
    assert found(spark, title="a" * size) == []


@pytest.mark.parametrize("size", [150, 160])
def test_description_bounds_are_inclusive(spark, size):
    assert found(spark, meta_description="a" * size) == []


def test_gate_is_narrower_than_extraction(spark):
    for kind, n in ((None, 0), ("application/xhtml+xml", 0), ("TEXT/HTML; charset=x", 1)):
        assert len(found(spark, content_type=kind, title=None)) == n
    assert len(found(spark, title=None, status_code=404)) == 1


def test_order_of_rules_and_null_lists(spark):
    bare = frame(spark, page(title=None, meta_description=None, h1_tags=None, links=None, images=None, issues=None, open_graph=None))
    got = [i.issue_type for i in rules.audit(bare).first().issues]
    assert got == ["MissingTitle", "MissingMetaDescription", "MissingH1", "ThinContent", "MissingOgTitle", "MissingOgDescription", "MissingOgImage", "MissingOgUrl", "MissingOgType"]


def test_tables_give_the_same_as_nested_pages(spark):
    pages = frame(spark, page("a", title=None), page("b", links=[], images=[{"src": "s", "alt": None}]), page("c", content_type=None, title=None))
    links = pages.select("page_key", F.explode("links").alias("l")).select("page_key", "l.*")
    images = pages.select("page_key", F.explode("images").alias("i")).select("page_key", "i.*")
    flat = {(r.page_key, r.rule_idx, r.issue_type) for r in rules.audit_tables(pages, links, images, "page_key").collect()}
    nested = {(r.page_key, r.issue_idx, r.issue_type) for r in rules.issues_of(rules.audit(pages)).collect()}
    assert flat == nested and flat


def test_link_issues(spark):
    links = spark.createDataFrame([("p", 0, "http://h/a", 404, "http://h/z", None), ("p", 1, "http://h/b", 399, None, None), ("p", 2, "http://h/c", None, None, "connection failed"), ("p", 3, "mailto:x", None, None, None)], "page_key string, link_idx int, url string, status_code int, redirected_url string, check_error string")
    got = [(r.link_idx, r.severity, r.issue_type, r.message) for r in linkcheck.issues_of_links(links).orderBy("link_idx", "part").collect()]
    assert got == [(0, "Info", "Redirect", "Link redirected: http://h/a -> http://h/z"), (0, "Error", "BrokenLink", "Broken link: http://h/a (HTTP 404)"), (2, "Error", "BrokenLink", "Link check failed: http://h/c (connection failed)")]
    assert linkcheck.issues_of_links(links, ignore_redirects=True).count() == 2


def test_check_pages_fills_every_occurrence_and_keeps_order(spark):
    link = lambda u: {"url": u, "text": u, "is_external": False, "status_code": None, "redirected_url": None, "check_error": None}
    pages = frame(spark, page("a", links=[link("u1"), link("http://h/2"), link("u1")], issues=[{"severity": "Info", "issue_type": "x", "message": "old"}]), page("b", links=[]))
    probes = spark.createDataFrame([("u1", "Reachable", 500, None, None), ("http://h/2", "Reachable", 200, "http://h/3", None)], "url string, outcome string, status_code int, redirected_url string, error string")
    by = {r.page_key: r for r in linkcheck.check_pages(pages, probes).collect()}
    assert [x.status_code for x in by["a"].links] == [500, 200, 500]
    assert [i.message for i in by["a"].issues] == ["Broken link: u1 (HTTP 500)", "Link redirected: http://h/2 -> http://h/3", "Broken link: u1 (HTTP 500)", "old"]
    assert by["b"].links == [] and by["b"].issues == []
    ignored = linkcheck.check_pages(pages, probes, ignore_redirects=True).where("page_key = 'a'").first()
    assert ignored.links[1].redirected_url == "http://h/3" and len(ignored.issues) == 3


def test_outcomes(spark):
    rows = [("http://h/a#x", "http://h/a", 200, None), ("http://h/b", "http://h/c", 404, None), ("tel:1", None, None, "x"), ("http://h/d", None, None, "request timed out"), ("no scheme", None, None, "request failed")]
    got = {r.url: tuple(r)[1:] for r in linkcheck.outcomes(spark.createDataFrame(rows, "url string, final_url string, status_code int, error string")).collect()}
    assert got["http://h/a#x"] == ("Reachable", 200, None, None)
    assert got["http://h/b"] == ("Reachable", 404, "http://h/c", None)
    assert got["tel:1"] == ("SkippedUnsupportedScheme", None, None, None)
    assert got["http://h/d"] == ("TransportFailure", None, None, "request timed out")
    assert got["no scheme"][0] == "TransportFailure"


def test_summary(spark):
    link = lambda s, e=None: {"url": "u", "text": "", "is_external": False, "status_code": s, "redirected_url": None, "check_error": e}
    issue = lambda s: {"severity": s, "issue_type": "x", "message": "m"}
    pages = frame(spark, page("a", links=[link(s) for s in (200, 301, 399, 400, 404, 500)], issues=[issue("Error"), issue("Warning")]), page("b", links=[link(None), link(None, "failed")], issues=[issue("Info")]))
    expected = (2, 8, 4, 1, 1, 1)
    assert tuple(summary.summarize_nested(pages).first()) == expected
    links = pages.select("page_key", F.explode("links").alias("l")).select("page_key", "l.*")
    assert tuple(summary.summarize(pages, links, rules.issues_of(pages)).first()) == expected
    none = frame(spark)
    assert tuple(summary.summarize_nested(none).first()) == (0,) * 6
    assert tuple(summary.summarize(none, links.limit(0), rules.issues_of(none)).first()) == (0,) * 6


@pytest.fixture
def site(spark):
    issue = lambda s, m="m": {"severity": s, "issue_type": "x", "message": m}
    pages = frame(spark, page("http://h/c", issues=[issue("Info"), issue("Info"), issue("Info")], status_code=None, crawl_depth=1), page("http://h/b", issues=[issue("Error", "Broken THING")], status_code=404), page("http://h/a", issues=[issue("Warning"), issue("Warning", "100% wrong")], crawl_depth=2), page("http://h/d", status_code=500, title="Thing_x"))
    return pages, rules.issues_of(pages)


def keys(df):
    return [r.page_key[-1] for r in df.collect()]


def test_sorts(site):
    assert keys(views.view(*site)) == ["b", "a", "c", "d"]
    assert keys(views.view(*site, sort="Issues")) == ["c", "a", "b", "d"]
    assert keys(views.view(*site, sort="Status")) == ["d", "b", "a", "c"]
    assert keys(views.view(*site, sort="Depth")) == ["b", "d", "c", "a"]
    assert keys(views.view(*site, sort="Url")) == ["a", "b", "c", "d"]


def test_filters_and_search(site):
    assert keys(views.view(*site, severity="Error")) == ["b"]
    assert keys(views.view(*site, query=" thing ")) == ["b", "d"]
    assert keys(views.view(*site, query="0% w")) == ["a"]
    assert keys(views.view(*site, query="g_x")) == ["d"]
    assert keys(views.view(*site, query="  ")) == ["b", "a", "c", "d"]
    assert keys(views.report_order(*site)) == ["b", "c", "a"]


def test_paging_positions_and_cycles(site):
    rows = views.view(*site, sort="Url")
    assert keys(views.paged(rows, 1, 2)) == ["b", "c"]
    assert {r.page_key[-1]: r.position for r in views.positioned(site[0], [F.asc("page_key")]).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert views.positioned(site[0].limit(0), [F.asc("page_key")]).count() == 0
    assert [views.cursor(0, -1, 3), views.cursor(0, 10, 3), views.cursor(0, 1, 0)] == [0, 2, 0]
    assert [views.next_filter(x) for x in views.FILTERS] == ["Error", "Warning", "Info", "All"]
    assert views.next_sort("Url") == "Severity"


def test_counts_and_badges(site):
    got = {r.page_key[-1]: (r.severity_rank, r.issue_count, r.b) for r in summary.per_page(*site).withColumn("b", summary.badge(F.col("errors"), F.col("warnings"), F.col("infos"))).collect()}
    assert got == {"a": (2, 2, "E:0 W:2 I:0"), "b": (3, 1, "E:1 W:0 I:0"), "c": (1, 3, "E:0 W:0 I:3"), "d": (0, 0, "E:0 W:0 I:0")}


def test_issue_order_is_stable(spark):
    issues = spark.createDataFrame([("p", i, s, "t", str(i)) for i, s in enumerate(["Info", "Warning", "Error", "Info", "Error"])], "page_key string, issue_idx int, severity string, issue_type string, message string")
    assert [r.message for r in views.issue_order(issues).orderBy("position").collect()] == ["2", "4", "1", "0", "3"]
