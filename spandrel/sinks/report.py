"""Reports: the JSON document, the text report, and tables of views."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.text import display_title, shortened
from spandrel.operators.summary import badge, per_page, summarize_nested
from spandrel.operators.views import issue_order
from spandrel.schemas import PAGE

FIELDS = [x.split(" ", 1)[0] for x in PAGE.split(", ")]
# How the text report writes severities and tags.
MARKS = {"Error": "ERROR", "Warning": "WARN ", "Info": "INFO "}
TAG_LINES = (("og_title", "      og:title:       "), ("og_description", "      og:description: "), ("og_image", "      og:image:       "), ("og_url", "      og:url:         "), ("og_type", "      og:type:        "), ("og_site_name", "      og:site_name:   "), ("og_locale", "      og:locale:      "))
SHOWN_BY = 5
RULE = "=" * 80
COLOURS = {"red": "\x1b[91m", "green": "\x1b[92m", "yellow": "\x1b[33m"}


def page_struct() -> Column:
    return F.struct(*FIELDS)


def document(pages: DataFrame, start_url: str, timestamp: str | None = None) -> DataFrame:
    """One row, one column ``json``: the whole report, nulls written out.

    The pages of a crawl are bounded by its budget; a corpus is written by ``write_pages`` instead.
    """
    when = timestamp or datetime.now(UTC).isoformat()
    summary = summarize_nested(pages).select(F.struct("*").alias("summary"))
    mapped = pages.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page_key", page_struct().alias("page"))))).alias("pages"))
    stacked = mapped.unionByName(summary, allowMissingColumns=True)
    whole = F.struct(F.lit(start_url).alias("start_url"), F.col("pages"), F.col("summary"), F.lit(when).alias("timestamp"))
    one = stacked.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("pages", "summary")))
    return one.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def pretty(pages: DataFrame, start_url: str, timestamp: str | None = None) -> str:
    return json.dumps(json.loads(document(pages, start_url, timestamp).first().json), indent=2, ensure_ascii=False)


def save(pages: DataFrame, path: str, start_url: str, timestamp: str | None = None) -> None:
    """The JSON document as one file, whatever the output format is."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(pretty(pages, start_url, timestamp))


def write_pages(pages: DataFrame, path: str) -> None:
    """One JSON object a page, in parallel, for results of any size."""
    pages.select("page_key", F.to_json(page_struct(), {"ignoreNullFields": "false"}).alias("page")).write.mode("errorifexists").parquet(path)


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label), value))


def page_text(colour: bool = False) -> Column:
    """A page's block of the text report."""
    status = F.col("status_code")
    shown = F.coalesce(status.cast("string"), F.lit("N/A"))
    if colour:
        tone = F.when(status < 300, COLOURS["green"]).when(status < 400, COLOURS["yellow"]).otherwise(COLOURS["red"])
        shown = F.when(status.isNull(), shown).otherwise(F.concat(tone, shown, F.lit("\x1b[0m")))
    any_tag = F.coalesce(*(F.col(f"open_graph.{t}") for t, _ in TAG_LINES[:SHOWN_BY])).isNotNull()
    mark = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    issues = F.transform("issues", lambda i: F.concat(F.lit("      ["), mark[i["severity"]], F.lit("] "), i["message"]))
    return F.concat_ws(
        "\n",
        F.lit(""),
        F.concat(F.lit("  URL: "), F.col("url")),
        F.concat(F.lit("    Status: "), shown),
        F.concat(F.lit("    Depth:  "), F.col("crawl_depth").cast("string")),
        _line("    Title:  ", F.col("title")),
        F.when(any_tag, F.lit("    Open Graph:")),
        *(F.when(any_tag, _line(label, F.col(f"open_graph.{tag}"))) for tag, label in TAG_LINES),
        F.lit("    Issues:"),
        issues,
    )


def text_lines(pages: DataFrame, start_url: str, timestamp: str | None = None, colour: bool = False) -> Iterator[str]:
    """The text report: summary, then the pages with issues by depth and address. Pages stream to the driver in parts."""
    s = summarize_nested(pages).first()
    yield from ("", RULE, "Crawl Report", RULE, "", f"Start URL: {start_url}", f"Timestamp: {timestamp or datetime.now(UTC).isoformat()}", "", "Summary")
    for label, value in (("Total Pages Crawled: ", s.total_pages), ("Total Links Found:   ", s.total_links), ("Broken Links:        ", s.broken_links), ("Errors:              ", s.errors), ("Warnings:            ", s.warnings), ("Info:                ", s.infos)):
        yield f"  {label}{value}"
    yield ""
    blocks = pages.where(F.size("issues") > 0).orderBy("crawl_depth", "url").select(page_text(colour).alias("block"))
    first = True
    for row in blocks.toLocalIterator():
        if first:
            yield "Pages with Issues"
            first = False
        yield row.block
    yield from ("", RULE)


def print_text(pages: DataFrame, start_url: str, timestamp: str | None = None, out: TextIO | None = None) -> None:
    out = out or sys.stdout
    for line in text_lines(pages, start_url, timestamp, out.isatty()):
        print(line, file=out)


def table_rows(pages: DataFrame, issues: DataFrame, key: str = "page_key") -> DataFrame:
    """The columns of a view's table: depth, status (``-`` for none), issues, title and address, shortened."""
    counted = per_page(pages, issues, key)
    title = display_title(F.col("title"), F.col("url"), F.col("content_type"))
    return counted.select(key, F.col("crawl_depth").alias("depth"), F.coalesce(F.col("status_code").cast("string"), F.lit("-")).alias("status"), badge(F.col("errors"), F.col("warnings"), F.col("infos")).alias("issues"), shortened(title, 24).alias("title"), shortened(F.col("url"), 48).alias("address"))


def detail(issues: DataFrame, page_key: str, key: str = "page_key") -> DataFrame:
    """One page's issues as its detail pane orders them."""
    return issue_order(issues.where(F.col(key) == page_key), key).orderBy("position")
