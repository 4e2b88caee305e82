"""Links and the outcome of their probes: each address is probed once, its outcome joined to every occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.urls import CRAWL_SCHEMES, redirected, scheme_of
from spandrel.operators.rules import issue
from spandrel.schemas import ISSUE

REACHABLE, SKIPPED, FAILED = "Reachable", "SkippedUnsupportedScheme", "TransportFailure"


def unique_links(links: DataFrame) -> DataFrame:
    """The distinct addresses of links; fragments count."""
    return links.select("url").where("url is not null").distinct()


def probeable(url: Column) -> Column:
    """Whether an address is probed: of the web, or of no scheme at all (it is tried, and fails)."""
    scheme = scheme_of(url)
    return scheme.isNull() | scheme.isin(*CRAWL_SCHEMES)


def outcomes(responses: DataFrame) -> DataFrame:
    """Probes (url, outcome, status_code, redirected_url, error) of responses (url, final_url, status_code, error)."""
    url, failed = F.col("url"), F.col("error").isNotNull()
    asked = probeable(url)
    return responses.select(
        "url",
        F.when(~asked, SKIPPED).when(failed, FAILED).otherwise(REACHABLE).alias("outcome"),
        F.when(asked & ~failed, F.col("status_code")).alias("status_code"),
        F.when(asked & ~failed, redirected(url, F.col("final_url"))).alias("redirected_url"),
        F.when(asked & failed, F.col("error")).alias("error"),
    )


def checked(links: DataFrame, probes: DataFrame) -> DataFrame:
    """``links`` with status_code, redirected_url and check_error from ``probes`` (url unique); null where unprobed.

    A left join on the address: the probes' side is unique, so hot targets only make a left partition large, which
    adaptive execution splits.
    """
    own = [c for c in links.columns if c not in ("status_code", "redirected_url", "check_error")]
    found = probes.select("url", "status_code", "redirected_url", F.col("error").alias("check_error"))
    return links.select(*own).join(found, "url", "left").select(*own, "status_code", "redirected_url", "check_error")


def link_issues(url: Column, status: Column, final: Column, error: Column, ignore_redirects: bool = False) -> Column:
    """The issues of one link: a redirect, then a broken or failed target."""
    moved = F.when(final.isNotNull() & F.lit(not ignore_redirects), issue("Info", "Redirect", F.concat(F.lit("Link redirected: "), url, F.lit(" -> "), final)))
    broken = F.when(status >= 400, issue("Error", "BrokenLink", F.concat(F.lit("Broken link: "), url, F.lit(" (HTTP "), status.cast("string"), F.lit(")"))))
    failed = F.when(error.isNotNull(), issue("Error", "BrokenLink", F.concat(F.lit("Link check failed: "), url, F.lit(" ("), error, F.lit(")"))))
    return F.filter(F.array(moved, broken, failed), lambda x: x.isNotNull())


def issues_of_links(links: DataFrame, ignore_redirects: bool = False) -> DataFrame:
    """``links`` (checked ones) as one row an issue, with severity, issue_type and message; every occurrence counts."""
    found = link_issues(F.col("url"), F.col("status_code"), F.col("redirected_url"), F.col("check_error"), ignore_redirects)
    return links.select(*links.columns, F.posexplode(found).alias("part", "issue")).select(*links.columns, "part", "issue.*")


def is_broken(status: Column, error: Column) -> Column:
    return F.coalesce(status >= 400, F.lit(False)) | error.isNotNull()


def check_pages(pages: DataFrame, probes: DataFrame, ignore_redirects: bool = False) -> DataFrame:
    """Nested pages with their links' outcomes filled in and the links' issues put before their own.

    Links leave their page for the join and come back in their order; a page's links are bounded by its size.
    """
    flat = pages.select("page_key", F.posexplode("links").alias("link_idx", "link")).select("page_key", "link_idx", "link.*")
    done = checked(flat, probes)
    found = link_issues(F.col("url"), F.col("status_code"), F.col("redirected_url"), F.col("check_error"), ignore_redirects)
    link = F.struct("url", "text", "is_external", "status_code", "redirected_url", "check_error")
    rows = done.groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct("link_idx", link.alias("link"), found.alias("found")))).alias("_rows"))
    joined = pages.join(rows, "page_key", "left")
    none = F.array().cast(f"array<{ISSUE}>")
    kept = F.coalesce(F.col("issues"), none) if "issues" in pages.columns else none
    new = F.coalesce(F.flatten(F.transform("_rows", lambda r: r["found"])), none)
    return joined.withColumn("links", F.coalesce(F.transform("_rows", lambda r: r["link"]), F.col("links"))).withColumn("issues", F.concat(new, kept)).drop("_rows")
