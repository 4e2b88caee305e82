"""The rules of the audit as one projection: an array of the issues that hold, null ones filtered out.

No join and no shuffle: all that a rule looks at is in the page's row. Lengths are bytes of the trimmed text, inclusive
of both bounds; an empty alt text is one; links count with their repeats.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.text import byte_length, is_blank, trimmed
from spandrel.schemas import ISSUE

# Bounds of the length rules, and the least number of elements of a page.
TITLE_BYTES = (50, 60)
DESCRIPTION_BYTES = (150, 160)
LEAST_ELEMENTS = 5
REQUIRED_TAGS = (("og_title", "MissingOgTitle"), ("og_description", "MissingOgDescription"), ("og_image", "MissingOgImage"), ("og_url", "MissingOgUrl"), ("og_type", "MissingOgType"))


def issue(severity: str, issue_type: str, message: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(issue_type).alias("issue_type"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def audited(content_type: Column) -> Column:
    """Whether a page is audited: it says that it is HTML. Narrower than what is extracted from."""
    return F.coalesce(F.contains(F.lower(content_type), F.lit("text/html")), F.lit(False))


def _length(text: Column, noun: str, name: str, missing: str, bounds: tuple[int, int], article: str) -> list[Column]:
    size = byte_length(trimmed(text))
    said = lambda how: F.concat(F.lit(f"{noun} is too {how} ("), size.cast("string"), F.lit(f" chars, recommended: {bounds[0]}-{bounds[1]})"))
    return [
        F.when(is_blank(text), issue("Error", missing, article)),
        F.when(~is_blank(text) & (size < bounds[0]), issue("Warning", f"{name}TooShort", said("short"))),
        F.when(~is_blank(text) & (size > bounds[1]), issue("Warning", f"{name}TooLong", said("long"))),
    ]


#: The types of each rule that looks at links or images.
OF_LINKS, OF_IMAGES = frozenset({"ThinContent"}), frozenset({"ThinContent", "MissingImageAlt"})


def page_rules(n_h1: Column, n_links: Column, n_images: Column, n_without_alt: Column) -> list[tuple[str, Column]]:
    """The rules over a page row with title, meta_description and open_graph, in their order: (issue type, issue)."""
    title, description = F.col("title"), F.col("meta_description")
    lengths = lambda name, missing: (missing, f"{name}TooShort", f"{name}TooLong")
    return [
        *zip(lengths("Title", "MissingTitle"), _length(title, "Title", "Title", "MissingTitle", TITLE_BYTES, "Page is missing a title tag"), strict=True),
        *zip(lengths("MetaDescription", "MissingMetaDescription"), _length(description, "Meta description", "MetaDescription", "MissingMetaDescription", DESCRIPTION_BYTES, "Page is missing a meta description"), strict=True),
        ("MissingH1", F.when(n_h1 == 0, issue("Warning", "MissingH1", "Page is missing an H1 tag"))),
        ("MultipleH1", F.when(n_h1 > 1, issue("Warning", "MultipleH1", F.concat(F.lit("Page has multiple H1 tags ("), n_h1.cast("string"), F.lit(")"))))),
        ("MissingImageAlt", F.when(n_without_alt > 0, issue("Warning", "MissingImageAlt", F.concat(n_without_alt.cast("string"), F.lit(" image(s) missing alt text"))))),
        ("ThinContent", F.when(n_h1 + n_links + n_images < LEAST_ELEMENTS, issue("Warning", "ThinContent", "Page may have thin content (few elements found)"))),
        *((name, F.when(is_blank(F.col(f"open_graph.{tag}")), issue("Info", name, f"Page is missing {tag.replace('_', ':', 1)} tag"))) for tag, name in REQUIRED_TAGS),
    ]


def page_issues(n_h1: Column, n_links: Column, n_images: Column, n_without_alt: Column, types: Collection[str] | None = None) -> Column:
    """The array of a page's issues, of ``types`` alone if they are given; empty for a page that isn't audited."""
    chosen = [x for name, x in page_rules(n_h1, n_links, n_images, n_without_alt) if types is None or name in types]
    found = F.filter(F.array(*chosen), lambda x: x.isNotNull())
    return F.when(audited(F.col("content_type")), found).otherwise(F.array().cast(f"array<{ISSUE}>"))


def audit(pages: DataFrame) -> DataFrame:
    """Nested pages with the issues of the rules appended to those they have.

    Null lists count as empty. Pages whose content type is null or isn't text/html keep their issues as they are.
    """
    empty = lambda c, n: F.coalesce(F.col(c), F.array().cast(pages.schema[c].dataType)) if n else c
    images = empty("images", 1)
    own = page_issues(F.size(empty("h1_tags", 1)), F.size(empty("links", 1)), F.size(images), F.size(F.filter(images, lambda x: x["alt"].isNull())))
    before = F.coalesce(F.col("issues"), F.array().cast(f"array<{ISSUE}>")) if "issues" in pages.columns else F.array().cast(f"array<{ISSUE}>")
    return pages.withColumn("issues", F.concat(before, own))


def counted_tables(pages: DataFrame, links: DataFrame, images: DataFrame, key: str, types: Collection[str] | None = None, of_links: Collection[Column] = ()) -> tuple[DataFrame, Column]:
    """``pages`` with counts of their links and images, and the array of their issues by the rules of ``types``.

    Links and images are counted per page before the join, so that neither fans out the other; a page without any counts
    none. The rows of one page are never gathered. What no chosen rule looks at isn't read. ``of_links`` are further
    aggregates of a page's links, from the same grouping.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_links = n_images = n_bare = F.lit(0)
    out = pages
    if of_links or types is None or OF_LINKS & set(types):
        out, n_links = out.join(links.groupBy(key).agg(F.count(F.lit(1)).alias("_links"), *of_links), key, "left"), zero("_links")
    if types is None or OF_IMAGES & set(types):
        out, n_images, n_bare = out.join(images.groupBy(key).agg(F.count(F.lit(1)).alias("_images"), F.count_if(F.col("alt").isNull()).alias("_no_alt")), key, "left"), zero("_images"), zero("_no_alt")
    return out, page_issues(F.coalesce(F.size("h1_tags"), F.lit(0)), n_links, n_images, n_bare, types)


def audit_tables(pages: DataFrame, links: DataFrame, images: DataFrame, key: str, types: Collection[str] | None = None) -> DataFrame:
    """(key, rule_idx, severity, issue_type, message) of normalised tables, by the rules of ``types`` if they are given."""
    counted, found = counted_tables(pages.where(audited(F.col("content_type"))), links, images, key, types)
    return counted.select(key, F.posexplode(found).alias("rule_idx", "issue")).select(key, "rule_idx", "issue.*")


def issues_of(pages: DataFrame) -> DataFrame:
    """(page_key, issue_idx, severity, issue_type, message) of nested pages."""
    return pages.select("page_key", F.posexplode("issues").alias("issue_idx", "issue")).select("page_key", "issue_idx", "issue.*")
