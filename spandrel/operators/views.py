"""Views of a report: filter by severity, search, sort orders, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.functions.text import contains_folded, display_title
from spandrel.operators.summary import per_page

FILTERS = ("All", "Error", "Warning", "Info")
SORTS = ("Severity", "Issues", "Status", "Depth", "Url")


def next_filter(now: str) -> str:
    return FILTERS[(FILTERS.index(now) + 1) % len(FILTERS)]


def next_sort(now: str) -> str:
    return SORTS[(SORTS.index(now) + 1) % len(SORTS)]


def order(sort: str) -> list[Column]:
    """The keys of a sort order over what ``per_page`` gives; the address, in byte order, breaks ties."""
    rank, count, url = F.desc("severity_rank"), F.desc("issue_count"), F.asc("url")
    return {
        "Severity": [rank, count, url],
        "Issues": [count, rank, url],
        "Status": [F.desc(F.coalesce("status_code", F.lit(0))), rank, url],
        "Depth": [F.asc("crawl_depth"), rank, url],
        "Url": [url],
    }[sort]


def matching(pages: DataFrame, issues: DataFrame, severity: str = "All", query: str = "", key: str = "page_key") -> DataFrame:
    """The pages with any issue of ``severity``, whose address, display title or any issue's message has ``query`` in it.

    The query is trimmed and letter case doesn't count; an empty one finds all.
    """
    out = pages
    if severity != "All":
        out = out.join(issues.where(F.col("severity") == severity).select(key).distinct(), key, "left_semi")
    if query.strip():
        wanted = F.lit(query.strip().lower())
        said = issues.where(contains_folded(F.col("message"), wanted)).select(key).distinct().withColumn("_said", F.lit(True))
        title = display_title(F.col("title"), F.col("url"), F.col("content_type"))
        out = out.join(said, key, "left").where(F.coalesce(F.col("_said"), F.lit(False)) | F.coalesce(contains_folded(F.col("url"), wanted), F.lit(False)) | contains_folded(title, wanted)).drop("_said")
    return out


def view(pages: DataFrame, issues: DataFrame, severity: str = "All", query: str = "", sort: str = "Severity", key: str = "page_key") -> DataFrame:
    """The matching pages with their counts, sorted: a range-partitioned sort, not one task."""
    return per_page(matching(pages, issues, severity, query, key), issues, key).orderBy(*order(sort), key)


def paged(rows: DataFrame, offset: int, size: int) -> DataFrame:
    """A window of a sorted view."""
    return rows.offset(max(0, offset)).limit(size)


def cursor(at: int, delta: int, size: int) -> int:
    """The selection after a move, kept within the rows."""
    return max(0, min(size - 1, at + delta)) if size else 0


def positioned(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with ``position`` in the order of ``keys``, from 1, without gathering all rows in one task.

    The rows are sorted across partitions; each partition's size, a number, goes to the driver, and positions are counted
    on from there.
    """
    from spandrel.tables import settle

    parts = settle(rows.orderBy(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    start = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return parts.withColumn("position", (start + within + 1).cast("bigint")).drop("_part", "_at")


def report_order(pages: DataFrame, issues: DataFrame, key: str = "page_key") -> DataFrame:
    """The pages that have issues, by depth and address, as the text report lists them."""
    return pages.join(issues.select(key).distinct(), key, "left_semi").orderBy("crawl_depth", "url", key)


def issue_order(issues: DataFrame, key: str = "page_key") -> DataFrame:
    """Issues with their ``position`` on their page: errors, warnings, infos, each in their order of finding."""
    severity = F.array_position(F.array(F.lit("Error"), F.lit("Warning"), F.lit("Info")), F.col("severity"))
    return issues.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(severity, "issue_idx")).cast("bigint"))
