"""The queries of the core operators over the crawl's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import text, urls
from spandrel.operators import crawl, extract, linkcheck, nested, robots, rules, summary, views
from spandrel.plans.oracles import BLOCKED, oracle_sql  # noqa: F401
from spandrel.sinks import report
from spandrel.sources.snapshots import SnapshotFetcher
from spandrel.tables import load, settle, written

Query = Callable[[SparkSession, str], DataFrame]
AGENT = "auditbot"
SEEK = "for "


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, root, "pages"), load(spark, root, "links"), load(spark, root, "images")


# Rules.


def page_rule_issues(spark: SparkSession, root: str) -> DataFrame:
    return rules.audit_tables(*_tables(spark, root), "page_id")


def _of_types(*names: str) -> Query:
    return lambda spark, root: rules.audit_tables(*_tables(spark, root), "page_id", names).select("page_id", "severity", "issue_type", "message")


def link_issues(spark: SparkSession, root: str) -> DataFrame:
    return linkcheck.issues_of_links(load(spark, root, "links")).select("link_id", "page_id", "link_idx", "severity", "issue_type", "message")


def link_issues_without_redirects(spark: SparkSession, root: str) -> DataFrame:
    return linkcheck.issues_of_links(load(spark, root, "links"), ignore_redirects=True).select("link_id", "page_id", "link_idx", "severity", "issue_type", "message")


def all_issues(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, of, place, severity, issue_type, message): issues of links, then of the page."""
    of_links = link_issues(spark, root).select("page_id", F.lit("link").alias("of"), F.col("link_idx").alias("place"), "severity", "issue_type", "message")
    return of_links.unionByName(page_rule_issues(spark, root).select("page_id", F.lit("page").alias("of"), F.col("rule_idx").alias("place"), "severity", "issue_type", "message"))


def issues_by_type(spark: SparkSession, root: str) -> DataFrame:
    return all_issues(spark, root).groupBy("severity", "issue_type").agg(F.count(F.lit(1)).alias("n"))


def issues_by_severity(spark: SparkSession, root: str) -> DataFrame:
    return all_issues(spark, root).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def title_length_histogram(spark: SparkSession, root: str) -> DataFrame:
    size = text.byte_length(text.trimmed(F.col("title")))
    bucket = F.when(text.is_blank(F.col("title")), "missing").when(size < 50, "short").when(size > 60, "long").otherwise("ok")
    return load(spark, root, "pages").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def content_indicators(spark: SparkSession, root: str) -> DataFrame:
    pages, links, images = _tables(spark, root)
    n_links = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    n_images = images.groupBy("page_id").agg(F.count(F.lit(1)).alias("images"))
    out = pages.select("page_id", F.coalesce(F.size("h1_tags"), F.lit(0)).cast("bigint").alias("h1")).join(n_links, "page_id", "left").join(n_images, "page_id", "left").na.fill(0)
    return out.withColumn("indicators", F.col("h1") + F.col("links") + F.col("images"))


# Links.


def broken_links(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "links").where(linkcheck.is_broken(F.col("status_code"), F.col("check_error"))).select("link_id", "page_id", "url", "status_code", "check_error")


def checked_links(spark: SparkSession, root: str) -> DataFrame:
    return linkcheck.checked(load(spark, root, "links"), load(spark, root, "probes")).select("link_id", "url", "status_code", "redirected_url", "check_error")


def probe_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Responses made of the links' own fields, classified as probes are."""
    links = load(spark, root, "links")
    responses = links.select("link_id", "url", F.coalesce("redirected_url", "url").alias("final_url"), "status_code", F.col("check_error").alias("error"))
    known = responses.where("url is not null and (status_code is not null or error is not null)").select("url", "final_url", "status_code", "error").distinct()
    return linkcheck.outcomes(known)


def unique_links(spark: SparkSession, root: str) -> DataFrame:
    return linkcheck.unique_links(load(spark, root, "links"))


def link_fan_in(spark: SparkSession, root: str) -> DataFrame:
    return summary.fan_in(load(spark, root, "links"))


def repeated_links_per_page(spark: SparkSession, root: str) -> DataFrame:
    per = load(spark, root, "links").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("page_id").agg(F.sum("n").alias("links"), F.count("url").alias("different")).where("links > different")


def skipped_schemes(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "links").where(~linkcheck.probeable(F.col("url"))).groupBy(urls.scheme_of(F.col("url")).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


# Addresses.


def normalized_urls(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "links").select("link_id", urls.normalized(F.col("url")).alias("key"))


def url_parts(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    return load(spark, root, "links").select("link_id", urls.scheme_of(u).alias("scheme"), urls.host_of(u).alias("host"), urls.port_of(u).alias("port"), urls.path_of(u).alias("path"), urls.ending_of(u).alias("ending"))


def pages_per_origin(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "pages").groupBy(urls.origin_of(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def external_links(spark: SparkSession, root: str) -> DataFrame:
    links, sites = load(spark, root, "links"), load(spark, root, "sites").select("site", "base_url")
    return links.join(sites, "site").select("link_id", urls.external(F.col("url"), F.col("base_url")).alias("external"))


def crawlable_links(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "links").where(urls.crawlable(F.col("url"))).select("link_id", "url")


def image_endings(spark: SparkSession, root: str) -> DataFrame:
    ending = urls.ending_of(F.col("src"))
    return load(spark, root, "images").groupBy(ending.alias("ending"), F.coalesce(ending.isin(*urls.NON_PAGE_ENDINGS), F.lit(False)).alias("non_page")).agg(F.count(F.lit(1)).alias("n"))


def redirects(spark: SparkSession, root: str) -> DataFrame:
    found = urls.redirected(F.col("url"), F.col("redirected_url"))
    return load(spark, root, "links").where("redirected_url is not null").where(found.isNotNull()).select("link_id", found.alias("final_url"))


def robots_decisions(spark: SparkSession, root: str) -> DataFrame:
    return robots.decide(load(spark, root, "pages").select("page_id", "url"), load(spark, root, "robots_rules"), AGENT).select("page_id", "allowed")


# Counts, ranks and views.


def robots_parsed(spark: SparkSession, root: str) -> DataFrame:
    """The rules of robots.txt texts, which are made of the rules of each origin: a group of lines for each agent."""
    groups = load(spark, root, "robots_rules").groupBy("domain", "agent").agg(F.sort_array(F.collect_list(F.struct("rule_idx", "pattern", "is_allow"))).alias("rules"))
    lines = F.transform("rules", lambda r: F.concat(F.when(r["is_allow"], F.lit("Allow: ")).otherwise(F.lit("disallow :")), r["pattern"]))
    text = F.concat(F.lit("# rules\r\n User-Agent: "), F.upper("agent"), F.lit("\n\nCrawl-delay: 1\nnonsense\n"), F.array_join(lines, "\r\n"))
    texts = groups.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list(text)), "\nSitemap: /s.xml\n").alias("text"))
    return robots.parsed(texts)


def crawl_summary(spark: SparkSession, root: str) -> DataFrame:
    return summary.summarize_tables(*_tables(spark, root), "page_id")


def page_counts(spark: SparkSession, root: str) -> DataFrame:
    out = summary.per_page_of_tables(*_tables(spark, root), "page_id")
    return out.select("page_id", "errors", "warnings", "infos", "issue_count", "severity_rank", summary.badge(F.col("errors"), F.col("warnings"), F.col("infos")).alias("badge"))


def _sorted_by(sort: str) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        counted = summary.per_page_of_tables(*_tables(spark, root), "page_id").select("page_id", "url", "status_code", "crawl_depth", "severity_rank", "issue_count")
        return views.positioned(counted, [*views.order(sort), F.asc("page_id")]).select("position", "page_id")

    return query


def view_errors(spark: SparkSession, root: str) -> DataFrame:
    return views.matching(load(spark, root, "pages"), all_issues(spark, root), "Error", key="page_id").select("page_id")


def view_search(spark: SparkSession, root: str) -> DataFrame:
    return views.matching(load(spark, root, "pages"), all_issues(spark, root), query=f" {SEEK.upper()} ", key="page_id").select("page_id")


def view_first_page(spark: SparkSession, root: str) -> DataFrame:
    """The second screen of ten rows of the view of errors by number of issues: a limit is what paging is."""
    rows = views.view(load(spark, root, "pages"), all_issues(spark, root), "Error", sort="Issues", key="page_id")
    return views.paged(rows, 10, 10).select("page_id", "issue_count")


def view_table(spark: SparkSession, root: str) -> DataFrame:
    return report.table_rows(load(spark, root, "pages"), all_issues(spark, root), "page_id")


def report_order(spark: SparkSession, root: str) -> DataFrame:
    pages = load(spark, root, "pages").select("page_id", "url", "crawl_depth")
    wanted = pages.join(all_issues(spark, root).select("page_id").distinct(), "page_id", "left_semi")
    return views.positioned(wanted, [F.asc("crawl_depth"), F.asc("url"), F.asc("page_id")]).select("position", "page_id")


def issue_order(spark: SparkSession, root: str) -> DataFrame:
    return views.issue_order(page_rule_issues(spark, root).withColumnRenamed("rule_idx", "issue_idx"), "page_id").select("page_id", "position", "issue_type")


def display_titles(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, F.lit("video/mp4")).otherwise(F.col("content_type"))
    return load(spark, root, "pages").select("page_id", text.display_title(F.col("title"), F.col("url"), kind).alias("shown"))


def shortened_titles(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "pages").select("page_id", text.shortened(F.col("title"), 24).alias("title"), text.shortened_left(F.col("url"), 48).alias("url"))


def load_delays(spark: SparkSession, root: str) -> DataFrame:
    delay = F.unix_timestamp("loaded_at") - F.unix_timestamp("fetched_at")
    return load(spark, root, "pages").where("fetched_at is not null").select("page_id", text.duration(delay).alias("delay"))


# Walks.


def _walk(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, site, node) of the pages, and (page_id, target) of what their links lead to."""
    pages, links, _ = _tables(spark, root)
    nodes = pages.select("page_id", "site", urls.normalized(F.col("url")).alias("node"))
    return nodes, links.where(urls.crawlable(F.col("url"))).select("page_id", urls.normalized(F.col("url")).alias("target"))


def bfs_depths(spark: SparkSession, root: str) -> DataFrame:
    """What can be reached in five steps, the usual depth of a crawl, from the first page of each site."""
    nodes, targets = _walk(spark, root)
    edges = targets.join(nodes, "page_id").select(F.col("node").alias("source"), "target").distinct()
    return crawl.reach(nodes.groupBy("site").agg(F.min_by("node", "page_id").alias("node")), edges, 5)


def unreached_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages that no walk from the first page of each site meets, however many steps it takes.

    The walk is over numbers of addresses, and over links to pages alone: other addresses lead nowhere.
    """
    nodes, targets = _walk(spark, root)
    numbers = nodes.where("node is not null").groupBy("node").agg(F.min("page_id").alias("number"))
    numbered = settle(nodes.join(numbers, "node", "left").select("page_id", "site", "node", "number"))
    known = numbered.where("number = page_id").select(F.col("node").alias("target"), F.col("number").alias("to"))
    edges = targets.join(numbered.select("page_id", F.col("number").alias("source")), "page_id").join(known, "target").select("source", F.col("to").alias("target")).distinct()
    met = crawl.reach(numbered.groupBy("site").agg(F.min_by("number", "page_id").alias("node")), settle(edges))
    return numbered.join(met.select(F.col("node").alias("number")), "number", "left_anti").select("page_id")


# Extraction and reports.


def _escaped(value: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


_rendered: dict[tuple[str, str], DataFrame] = {}


def rendered_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages as HTML: responses (page_id, url, status_code, content_type, body, crawl_depth), made once a session."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _rendered:
        _rendered[key] = written(_render(spark, root))
    return _rendered[key]


def _render(spark: SparkSession, root: str) -> DataFrame:
    pages, links, images = _tables(spark, root)
    anchors = links.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("link_idx", "link_id", F.concat(F.lit('<a href="'), _escaped(F.coalesce("url", F.lit(""))), F.lit('">'), _escaped(F.coalesce("text", F.lit(""))), F.lit("</a>")).alias("a")))).alias("anchors"))
    pictures = images.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("img_idx", F.concat(F.lit('<img src="'), _escaped(F.col("src")), F.lit('"'), F.coalesce(F.concat(F.lit(' alt="'), _escaped(F.col("alt")), F.lit('"')), F.lit("")), F.lit(">")).alias("i")))).alias("pictures"))
    meta = lambda name, of, c: F.concat(F.lit(f'<meta {name}="{of}" content="'), _escaped(F.col(c)), F.lit('">'))
    body = F.concat_ws(
        "\n",
        F.lit("<!doctype html><html><head>"),
        F.concat(F.lit("<title>"), _escaped(F.col("title")), F.lit("</title>")),
        meta("name", "description", "meta_description"),
        *(meta("property", t.replace("_", ":", 1), f"open_graph.{t}") for t in nested.TAGS),
        F.lit("</head><body>"),
        F.transform("h1_tags", lambda x: F.concat(F.lit("<h1>"), _escaped(F.coalesce(x, F.lit(""))), F.lit("</h1>"))),
        F.transform("anchors", lambda x: x["a"]),
        F.transform("pictures", lambda x: x["i"]),
        F.lit("</body></html>"),
    )
    return pages.join(anchors, "page_id", "left").join(pictures, "page_id", "left").select("page_id", "url", "status_code", "content_type", body.alias("body"), "crawl_depth")


def extracted_pages(spark: SparkSession, root: str) -> DataFrame:
    got = extract.extracted(rendered_pages(spark, root))
    return got.select("page_id", "title", "meta_description", "h1_tags", *(F.col(f"open_graph.{t}").alias(t) for t in nested.TAGS), F.size("images").cast("bigint").alias("images"), F.size(F.filter("images", lambda x: x["alt"].isNull())).cast("bigint").alias("without_alt"))


def extracted_links(spark: SparkSession, root: str) -> DataFrame:
    """The links of the rendered pages as they are extracted: in their order, resolved, with their texts."""
    got = extract.extracted(rendered_pages(spark, root)).select("page_id", F.posexplode("links").alias("link_idx", "link"))
    return got.select("page_id", "link_idx", "link.url", "link.text", "link.is_external")


def extracted_images(spark: SparkSession, root: str) -> DataFrame:
    """The images of the rendered pages as they are extracted: in their order, resolved, with their alternative texts."""
    got = extract.extracted(rendered_pages(spark, root)).select("page_id", F.posexplode("images").alias("img_idx", "image"))
    return got.select("page_id", "img_idx", "image.src", "image.alt")


def audited_html(spark: SparkSession, root: str) -> DataFrame:
    """Extraction and rules in one go, from HTML to issues by type."""
    pages = rules.audit(extract.extracted(rendered_pages(spark, root)))
    return pages.select("page_id", F.explode("issues").alias("issue")).groupBy("issue.severity", "issue.issue_type").agg(F.count(F.lit(1)).alias("n"))


def _crawled(spark: SparkSession, root: str, options: crawl.CrawlOptions, robots_txt: str | None = None) -> DataFrame:
    """A crawl over the rendered pages, by the addresses they stand under, from the first page of all."""
    responses = rendered_pages(spark, root).withColumn("address", urls.normalized(F.col("url"))).groupBy("address").agg(F.min_by(F.struct("status_code", "content_type", "body"), "page_id").alias("r")).select(F.col("address").alias("url"), "r.*")
    seed = load(spark, root, "pages").where(F.col("url").startswith("http")).agg(F.min_by(urls.normalized(F.col("url")), "page_id").alias("seed")).first().seed
    return crawl.crawl(spark, seed, SnapshotFetcher(responses, robots_txt), options).pages.select("seq", "page_key", "crawl_depth", "status_code", "title", "error")


def crawled_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """A crawl of whatever links lead to, five levels deep, each as wide as it is."""
    return _crawled(spark, root, crawl.CrawlOptions(max_depth=5, max_pages=None, follow_external=True))


def crawled_site(spark: SparkSession, root: str) -> DataFrame:
    """A crawl with the usual settings: one site, five levels, 200 pages, and a robots.txt that blocks a part of it."""
    return _crawled(spark, root, crawl.CrawlOptions(), f"User-agent: *\nDisallow: {BLOCKED}\n")


def report_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The summary of each saved report, made anew from its tables; each is counted by itself before the joins."""
    t = nested.report_tables(load(spark, root, "reports"))
    of = F.substring_index("parent_id", "/", 1).alias("id")
    pages = t["pages"].groupBy(of).agg(F.count(F.lit(1)).alias("total_pages"))
    links = t["links"].groupBy(of).agg(F.count(F.lit(1)).alias("total_links"), F.count_if(linkcheck.is_broken(F.col("status_code"), F.col("check_error"))).alias("broken_links"))
    issues = t["issues"].groupBy(of).agg(*(F.count_if(F.col("severity") == s).alias(f"{s.lower()}s") for s in summary.RANKS))
    out = t["report"].select("id", "start_url").join(pages, "id", "left").join(links, "id", "left").join(issues, "id", "left").na.fill(0)
    return out.withColumn("report_id", F.col("id").cast("bigint")).drop("id")


def report_documents(spark: SparkSession, root: str) -> DataFrame:
    """Saved reports read again and written as page rows."""
    tables = nested.report_tables(load(spark, root, "reports"))
    return tables["pages"].select("id", "parent_id", "idx", "url", "status_code", "title", "crawl_depth")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return nested.report_children(load(spark, root, "reports"))


def p5_shredded(spark: SparkSession, root: str) -> DataFrame:
    """The same rows from the flat tables, joined by their keys."""
    return nested.children_of_tables(nested.report_tables(load(spark, root, "reports")))


def p5_links(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of links with the keys of their page and report."""
    tables = nested.report_tables(load(spark, root, "reports"))
    return tables["links"].select("id", "parent_id", F.substring_index("parent_id", "/", 1).cast("bigint").alias("report_id"), "idx", "url", "text", "is_external", "status_code", "redirected_url", "check_error")


def p5_pages(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of pages, open_graph inlined."""
    return nested.report_tables(load(spark, root, "reports"))["pages"]


def queries() -> dict[str, Query]:
    own = (page_rule_issues, link_issues, link_issues_without_redirects, issues_by_type, issues_by_severity, title_length_histogram, content_indicators, broken_links, checked_links, probe_outcomes, unique_links, link_fan_in, repeated_links_per_page, skipped_schemes, normalized_urls, url_parts, pages_per_origin, external_links, crawlable_links, image_endings, redirects, robots_decisions, robots_parsed, crawl_summary, page_counts, view_errors, view_search, view_first_page, view_table, report_order, issue_order, display_titles, shortened_titles, load_delays, bfs_depths, unreached_pages, extracted_pages, extracted_links, extracted_images, audited_html, crawled_snapshot, crawled_site, report_documents, report_summaries, p5_found, p5_shredded, p5_links, p5_pages)
    out: dict[str, Query] = {f.__name__: f for f in own}
    out |= {
        "title_issues": _of_types("MissingTitle", "TitleTooShort", "TitleTooLong"),
        "description_issues": _of_types("MissingMetaDescription", "MetaDescriptionTooShort", "MetaDescriptionTooLong"),
        "h1_issues": _of_types("MissingH1", "MultipleH1"),
        "image_alt_issues": _of_types("MissingImageAlt"),
        "thin_content_issues": _of_types("ThinContent"),
        "open_graph_issues": _of_types(*(x for _, x in rules.REQUIRED_TAGS)),
    }
    return out | {f"view_by_{s.lower()}": _sorted_by(s) for s in views.SORTS}
