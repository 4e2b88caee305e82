"""Recorded responses as sources, for offline crawls and tests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.urls import Url
from spandrel.schemas import PAGE_STRUCT

ABSENT = "connection failed"


@dataclass
class SnapshotFetcher:
    """A table of responses (url unique, body, and if there are any status_code, content_type, final_url, error)."""

    responses: DataFrame
    robots_txt: str | None = None

    def fetch(self, todo: DataFrame) -> DataFrame:
        have = self.responses.columns
        given = lambda c, kind, default=None: (F.col(c) if c in have else F.lit(default)).cast(kind).alias(c)
        known = self.responses.select("url", given("status_code", "int", 200), given("content_type", "string", "text/html"), given("body", "string"), given("final_url", "string"), given("error", "string"), F.lit(True).alias("_known"))
        joined = todo.select("url", "page_key", "depth", "seq").join(known, "url", "left")
        error = F.when(F.col("_known").isNull(), F.lit(ABSENT)).otherwise(F.col("error"))
        return joined.select("url", "page_key", "depth", "seq", "status_code", "content_type", "body", F.coalesce("final_url", F.when(error.isNull(), F.col("url"))).alias("final_url"), error.alias("error"))

    def robots(self, base: Url) -> str | None:
        return self.robots_txt


@dataclass
class RecordedFetcher:
    """Responses given in a dict: address to body, or to a dict of a response's fields."""

    responses: dict[str, str | dict] = field(default_factory=dict)
    robots_txt: str | None = None

    def fetch(self, todo: DataFrame) -> DataFrame:
        spark = todo.sparkSession
        rows = []
        for url, r in self.responses.items():
            r = {"body": r} if isinstance(r, str) else r
            rows.append((url, r.get("status_code", None if r.get("error") else 200), r.get("content_type", "text/html; charset=utf-8"), r.get("body"), r.get("final_url"), r.get("error")))
        table = spark.createDataFrame(rows, "url string, status_code int, content_type string, body string, final_url string, error string")
        return SnapshotFetcher(table).fetch(todo)

    def robots(self, base: Url) -> str | None:
        return self.robots_txt


REPORT = f"start_url string, pages map<string,{PAGE_STRUCT}>, summary struct<total_pages:bigint,total_links:bigint,broken_links:bigint,errors:bigint,warnings:bigint,infos:bigint>, timestamp string"


def read_report(spark, path: str) -> DataFrame:  # noqa: ANN001
    """A saved report as one row of REPORT, its pages a map by key."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def report_pages(report: DataFrame) -> DataFrame:
    """The nested pages of a report, with their page_key."""
    return report.select(F.explode("pages").alias("page_key", "page")).select("page_key", "page.*")
