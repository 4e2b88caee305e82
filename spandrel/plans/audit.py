"""The whole run: crawl, probe, audit and report."""

from __future__ import annotations

import inspect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spandrel.operators.crawl import CrawlOptions, Fetcher, crawl
from spandrel.operators.extract import links_of
from spandrel.operators.linkcheck import check_pages, unique_links
from spandrel.operators.rules import audit
from spandrel.operators.summary import summarize_nested
from spandrel.plans.runtime import Listener, Progress, Stage, watched
from spandrel.sources.config import RuntimeOptions
from spandrel.tables import settle


@dataclass
class Audited:
    start_url: str
    pages: DataFrame
    probes: DataFrame | None


def audit_site(spark: SparkSession, options: RuntimeOptions, fetcher: Fetcher, prober=None, listen: Listener | None = None) -> Audited:  # noqa: ANN001
    """Crawl ``options.url``, probe each distinct link once with ``prober`` (none are probed without it), and audit.

    Each stage's result is written to the shared folder: requests happen once whatever reads the result.
    """
    tell = listen or (lambda *_: None)
    tell("started", options.url)
    settings = CrawlOptions(options.depth, options.max_pages, options.external, options.keep_fragments, options.respect_robots_txt)
    crawled = crawl(spark, options.url, fetcher, settings, lambda level: tell("progress", Progress(Stage.CRAWLING, f"Depth {level['depth']}", pages_crawled=level["visited"])))
    pages, probes = crawled.pages, None
    if prober is not None:
        urls = unique_links(links_of(pages))
        urls = settle(urls)
        total = urls.count()
        say = lambda n: tell("progress", Progress(Stage.CHECKING, f"Checked {n} of {total} links", links_checked=n, total_links=total))
        say(0)
        if "done" in inspect.signature(prober.probe).parameters:
            counter = spark.sparkContext.accumulator(0)
            with watched(lambda: counter.value, say):
                probes = settle(prober.probe(urls, counter.add))
        else:
            probes = settle(prober.probe(urls))
        say(total)
        pages = check_pages(pages, probes, options.ignore_redirects)
    tell("progress", Progress(Stage.ANALYZING, "Applying rules"))
    pages = settle(audit(pages))
    s = summarize_nested(pages).first()
    tell("progress", Progress(Stage.REPORTING, "Done", s.total_pages, s.total_links, s.total_links, s.total_links, s.errors, s.warnings, s.infos))
    return Audited(options.url, pages, probes)
