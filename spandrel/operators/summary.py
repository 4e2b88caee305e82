"""Counts of a crawl: one row of totals, counts per page, ranks and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.linkcheck import is_broken, link_issues
from spandrel.operators.rules import counted_tables

RANKS = {"Error": 3, "Warning": 2, "Info": 1}


def summarize(pages: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: total_pages, total_links (repeats included), broken_links, errors, warnings, infos.

    Each table is aggregated by itself to one row, so that nothing fans out; the three rows, which aggregates without keys
    give on empty tables too, are stacked and folded into one.
    """
    a = pages.agg(F.count(F.lit(1)).alias("total_pages"))
    b = links.agg(F.count(F.lit(1)).alias("total_links"), F.count_if(is_broken(F.col("status_code"), F.col("check_error"))).alias("broken_links"))
    c = issues.agg(*(F.count_if(F.col("severity") == s).alias(f"{s.lower()}s") for s in RANKS))
    stacked = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return stacked.agg(*(F.max(x).alias(x) for x in stacked.columns))


def summarize_nested(pages: DataFrame) -> DataFrame:
    """The same over nested pages, in one pass without a join."""
    broken = F.size(F.filter("links", lambda x: is_broken(x["status_code"], x["check_error"])))
    of = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return pages.agg(F.count(F.lit(1)).alias("total_pages"), total(F.size("links")).alias("total_links"), total(broken).alias("broken_links"), *(total(of(s)).alias(f"{s.lower()}s") for s in RANKS))


def rank_of(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def per_page(pages: DataFrame, issues: DataFrame, key: str = "page_key") -> DataFrame:
    """``pages`` with errors, warnings, infos, issue_count and severity_rank; pages without issues have zeros."""
    counts = issues.groupBy(key).agg(*(F.count_if(F.col("severity") == s).alias(f"{s.lower()}s") for s in RANKS), F.count(F.lit(1)).alias("issue_count"), F.max(rank_of(F.col("severity"))).alias("severity_rank"))
    return pages.join(counts, key, "left").na.fill(0, ["errors", "warnings", "infos", "issue_count", "severity_rank"])


def _number(issues: Column | str, severity: str) -> Column:
    """How many of an array of issues are of ``severity``."""
    return F.size(F.filter(issues, lambda x: x["severity"] == severity))


def per_page_of_tables(pages: DataFrame, links: DataFrame, images: DataFrame, key: str, ignore_redirects: bool = False) -> DataFrame:
    """``pages`` with what ``per_page`` adds, from normalised tables: each is read once, links are grouped once.

    A link's issues are counted with the links; a page's are counted in its row.
    """
    of_link = link_issues(F.col("url"), F.col("status_code"), F.col("redirected_url"), F.col("check_error"), ignore_redirects)
    names = {s: f"{s.lower()}s" for s in RANKS}
    counted, found = counted_tables(pages, links, images, key, None, [F.coalesce(F.sum(_number(of_link, s)), F.lit(0)).alias(f"_of_links_{n}") for s, n in names.items()])
    counted = counted.withColumn("_found", found)
    totals = {n: F.coalesce(F.col(f"_of_links_{n}"), F.lit(0)) + _number("_found", s) for s, n in names.items()}
    out = counted.select(*pages.columns, *(c.cast("bigint").alias(n) for n, c in totals.items()))
    rank = F.lit(0)
    for s, n in sorted(names.items(), key=lambda x: RANKS[x[0]]):
        rank = F.when(F.col(n) > 0, RANKS[s]).otherwise(rank)
    return out.withColumns({"issue_count": sum((F.col(n) for n in names.values()), F.lit(0).cast("bigint")), "severity_rank": rank})


def summarize_tables(pages: DataFrame, links: DataFrame, images: DataFrame, key: str, ignore_redirects: bool = False) -> DataFrame:
    """What ``summarize`` gives, from normalised tables: the issues of pages in one fold, those of links beside the links."""
    counted, found = counted_tables(pages, links, images, key)
    of_link = link_issues(F.col("url"), F.col("status_code"), F.col("redirected_url"), F.col("check_error"), ignore_redirects)
    number = lambda issues, s: F.coalesce(F.sum(_number(issues, s)), F.lit(0)).alias(f"{s.lower()}s")
    a = counted.withColumn("_found", found).agg(F.count(F.lit(1)).alias("total_pages"), *(number("_found", s) for s in RANKS))
    b = links.agg(F.count(F.lit(1)).alias("total_links"), F.count_if(is_broken(F.col("status_code"), F.col("check_error"))).alias("broken_links"), *(number(of_link, s) for s in RANKS))
    stacked = a.unionByName(b, allowMissingColumns=True)
    return stacked.agg(*(F.sum(x).cast("bigint").alias(x) for x in ("total_pages", "total_links", "broken_links", "errors", "warnings", "infos")))


def badge(errors: Column, warnings: Column, infos: Column) -> Column:
    return F.concat(F.lit("E:"), errors.cast("string"), F.lit(" W:"), warnings.cast("string"), F.lit(" I:"), infos.cast("string"))


def fan_in(links: DataFrame) -> DataFrame:
    """(url, occurrences, pages) of each linked address, combined before the shuffle."""
    return links.groupBy("url").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("page_id").alias("pages"))
