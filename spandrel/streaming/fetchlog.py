"""An extension: the audit over a growing log of fetches, by Structured Streaming.

Extraction and rules hold no state, so a stream of fetches is audited by the same functions as a table. Counts of issues
are kept by windows of event time, late fetches being taken up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.extract import extracted
from spandrel.operators.rules import audit

LOG = "url string, page_key string, crawl_depth int, status_code int, content_type string, body string, fetched_at timestamp"


def read_log(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The stream of the parquet files that are put into ``path``."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_at_once).parquet(path)


def audited_stream(fetches: DataFrame, base_url: str | None = None) -> DataFrame:
    """One row an issue (fetched_at, page_key, severity, issue_type, message), as fetches come in."""
    pages = audit(extracted(fetches, base_url))
    return pages.select("fetched_at", "page_key", F.explode("issues").alias("issue")).select("fetched_at", "page_key", "issue.*")


def issue_counts(issues: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """(start, end, severity, issue_type, n) by window of event time; issues later than ``lateness`` are left out."""
    counted = issues.withWatermark("fetched_at", lateness).groupBy(F.window("fetched_at", window), "severity", "issue_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("window.start", "window.end", "severity", "issue_type", "n")
