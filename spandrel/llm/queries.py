"""The queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import addresses, glyphs, mojibake, packing, reading, residue, tokens
from spandrel.llm.oracles import oracle_sql  # noqa: F401
from spandrel.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def address_rows(spark: SparkSession, root: str) -> DataFrame:
    pages = load(spark, root, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), "url")
    links = load(spark, root, "links").select(F.lit("links").alias("kind"), F.col("link_id").alias("id"), "url")
    return pages.unionByName(links)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return addresses.repeated_addresses(address_rows(spark, root))


def p1_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return addresses.collapse_addresses(address_rows(spark, root))


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """(field, id, value) of the titles, descriptions and og_titles of pages."""
    pages = load(spark, root, "pages")
    texts = F.array(*(F.struct(F.lit(x.rpartition(".")[2]).alias("field"), F.col(x).alias("value")) for x in ("title", "meta_description", "open_graph.og_title")))
    return pages.select(F.col("page_id").alias("id"), F.inline(texts)).select("field", "id", "value")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return glyphs.same_looking(page_texts(spark, root)).withColumnRenamed("id", "page_id")


def p2_forms(spark: SparkSession, root: str) -> DataFrame:
    return glyphs.consistent(page_texts(spark, root)).withColumnRenamed("id", "page_id")


def content_values(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, site, url, field, place, value, others): titles, descriptions and single h1 of pages beside their other texts."""
    one = lambda field, value, *rest: F.struct(F.lit(field).alias("field"), F.lit(0).alias("place"), F.col(value).alias("value"), F.concat_ws(" ", *rest).alias("others"))
    pages = load(spark, root, "pages").select("page_id", "site", "url", "title", "meta_description", "h1_tags")
    single = pages.select("page_id", "site", "url", F.inline(F.array(one("title", "title", "meta_description", "h1_tags"), one("meta_description", "meta_description", "title", "h1_tags"))))
    heads = pages.select("page_id", "site", "url", "title", "meta_description", F.posexplode("h1_tags").alias("place", "h1"))
    return single.unionByName(heads.select("page_id", "site", "url", F.lit("h1_tags").alias("field"), "place", F.col("h1").alias("value"), F.concat_ws(" ", "title", "meta_description").alias("others")))


def page_bodies(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").where("doc_type = 'page_text' and page_id is not null").select("page_id", "text")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.stand_ins(content_values(spark, root), bodies=page_bodies(spark, root)).select("page_id", "field").distinct()


def p3_evidence(spark: SparkSession, root: str) -> DataFrame:
    """(source, n): how many of the values are found by what kind of evidence."""
    return residue.stand_ins(content_values(spark, root), bodies=page_bodies(spark, root)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def p3_contents(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, field, value) without the values that stand in for content; other h1 of their page stay."""
    values = content_values(spark, root)
    return values.join(residue.stand_ins(values, "place", bodies=page_bodies(spark, root)), ["page_id", "field", "place"], "left_anti").select("page_id", "field", "value")


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(tbl, row_id, field, value) of the titles and descriptions of pages and the texts of links."""
    texts = F.array(*(F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in ("title", "meta_description")))
    pages = load(spark, root, "pages").select(F.lit("pages").alias("tbl"), F.col("page_id").alias("row_id"), F.inline(texts))
    links = load(spark, root, "links").select(F.lit("links").alias("tbl"), F.col("link_id").alias("row_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    return pages.unionByName(links)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.garbled(read_texts(spark, root)).select("tbl", "row_id", "field")


def p4_restored(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.garbled(read_texts(spark, root))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encoded(load(spark, root, "documents"))


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    specs = load(spark, root, "pack_specs").select("pack_name", "tokenizer", "capacity").orderBy("pack_name").collect()  # one row per kind of container
    return packing.packed(load(spark, root, "documents"), [tuple(x) for x in specs])


def p8_levels(spark: SparkSession, root: str) -> DataFrame:
    documents = load(spark, root, "documents").where("doc_type is null or doc_type <> 'crawl_log'")
    return reading.graded_levels(documents, load(spark, root, "graded_samples"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_levels(spark, root).select("doc_id", "band")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p3_contents": p3_contents, "p3_evidence": p3_evidence, "p4_found": p4_found, "p4_restored": p4_restored, "p6_ids": p6_ids, "p7_packed": p7_packed, "p8_found": p8_found, "p8_levels": p8_levels}
