"""Fetched bodies into page rows: one parse per page in Arrow batches, materialised once by the caller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spandrel.functions.html import empty_extract, extract
from spandrel.functions.urls import BadUrl, parse
from spandrel.schemas import IMAGE, LINK, OPEN_GRAPH

EXTRACTED = f"title string, meta_description string, h1_tags array<string>, open_graph {OPEN_GRAPH}, links array<{LINK}>, images array<{IMAGE}>"


def extracted(fetches: DataFrame, base_url: str | None = None) -> DataFrame:
    """``fetches`` (url, content_type, body and others) without body, with title, meta_description, h1_tags, open_graph,
    links and images.

    What isn't HTML, a null body and an address that can't be parsed give empty extracts; a null content type counts as
    HTML. Links are external as seen from ``base_url``, or without it from the row's own address.
    """
    made = StructType.fromDDL(EXTRACTED)
    names = made.names
    kept = [c for c in fetches.columns if c not in names and c != "body"]
    schema = StructType([*(fetches.schema[c] for c in kept), *made])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = parse(base_url) if base_url else None
        for batch in batches:
            out = []
            for url, kind, body in zip(*(batch.column(c).to_pylist() for c in ("url", "content_type", "body")), strict=True):
                page = empty_extract()
                if body is not None and url is not None and (kind is None or "text/html" in kind.lower() or "application/xhtml" in kind.lower()):
                    try:
                        page = extract(body, url, base or parse(url))
                    except BadUrl:
                        pass
                out.append(page)
            columns = [batch.column(c) for c in kept] + [pa.array([p[n] for p in out], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(columns)], schema=arrow)

    return fetches.select(*kept, "body").mapInArrow(work, schema)


def links_of(pages: DataFrame) -> DataFrame:
    """(page_key, link_idx, url, text, is_external, status_code, redirected_url, check_error): one row a link."""
    return pages.select("page_key", F.posexplode("links").alias("link_idx", "link")).select("page_key", "link_idx", "link.*")


def images_of(pages: DataFrame) -> DataFrame:
    """(page_key, img_idx, src, alt): one row an image."""
    return pages.select("page_key", F.posexplode("images").alias("img_idx", "image")).select("page_key", "img_idx", "image.*")
