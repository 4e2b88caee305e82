"""Breadth-first crawl, one level of depth at a time.

A level's candidates are the links of the level before, each page key once (at its first occurrence, by the position of
the page it is on and its place there), without those visited, in that order as far as the page budget, if any, goes. This is
what a first-in first-out queue with one request at a time does. Blocked pages count against the budget. What a level
fetched is written to the shared folder before anything reads it, so that no request is repeated by a later action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count as counted
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.urls import Url, checked_seed, crawlable, normalize, normalized, origin_of, path_of
from spandrel.operators import robots
from spandrel.operators.extract import extracted
from spandrel.operators.views import positioned
from spandrel.schemas import ISSUE
from spandrel.tables import settle


class Fetcher(Protocol):
    def fetch(self, todo: DataFrame) -> DataFrame: ...

    def robots(self, base: Url) -> str | None: ...


@dataclass(frozen=True)
class CrawlOptions:
    max_depth: int = 5
    max_pages: int | None = 200
    follow_external: bool = False
    keep_fragments: bool = False
    respect_robots: bool = True
    agent: str = robots.AGENT


@dataclass
class Crawled:
    """Nested pages with page_key, seq and error; visited has every key that used up budget."""

    pages: DataFrame
    visited: DataFrame
    levels: list[dict] = field(default_factory=list)


def crawl(spark: SparkSession, seed: str, fetcher: Fetcher, options: CrawlOptions = CrawlOptions(), on_level: Callable[[dict], None] | None = None) -> Crawled:  # noqa: B008
    """The pages reachable from ``seed`` under ``options``.

    A page that couldn't be fetched is a row with null status and content type, empty lists and its error; blocked ones
    are in ``visited`` only. The seed is fetched whatever its ending is; the key of a page is its address without
    fragment, but what is fetched is the address as first met. Lists of links are kept in the pages' rows.
    """
    base = checked_seed(seed)
    text = fetcher.robots(base) if options.respect_robots else None
    groups = robots.group_for(robots.parse(text), options.agent) if text else []
    frontier = spark.createDataFrame([(seed, normalize(seed, options.keep_fragments), -1, 0)], "url string, page_key string, parent bigint, link_idx int")
    visited: DataFrame | None = None
    pages: DataFrame | None = None
    used, levels = 0, []
    for depth in range(options.max_depth + 1):
        left = None if options.max_pages is None else options.max_pages - used
        if left is not None and left <= 0:
            break
        first = frontier.groupBy("page_key").agg(F.min(F.struct("parent", "link_idx", "url")).alias("met")).select("page_key", "met.*")
        fresh = first if visited is None else first.join(visited, "page_key", "left_anti")
        placed = positioned(fresh, [F.asc("parent"), F.asc("link_idx")])
        # By place, which every task can tell by itself: a limit would gather the budget in one.
        taken = placed if left is None else placed.where(F.col("position") <= left)
        chosen = settle(taken.select("url", "page_key", F.lit(depth).alias("depth"), (F.col("position") - 1 + used).alias("seq")))
        count = chosen.count()
        if not count:
            break
        used += count
        keys = chosen.select("page_key")
        visited = keys if visited is None else visited.unionByName(keys)
        todo = chosen
        if groups:
            own = origin_of(F.col("url")).eqNullSafe(F.lit(base.origin))
            todo = chosen.where(~own | robots.verdict(robots.literal(groups), path_of(F.col("url"))))
        fetched = settle(fetcher.fetch(todo))
        got = settle(extracted(fetched.withColumnRenamed("depth", "crawl_depth"), str(base)).withColumn("issues", F.array().cast(f"array<{ISSUE}>")))
        pages = got if pages is None else pages.unionByName(got)
        levels.append({"depth": depth, "visited": used, "pages": got.count()})
        if on_level:
            on_level(levels[-1])
        if depth == options.max_depth:
            break
        links = got.where("error is null").select(F.col("seq").alias("parent"), F.posexplode("links").alias("link_idx", "link")).select("parent", "link_idx", "link.url", "link.is_external")
        if not options.follow_external:
            links = links.where(~F.col("is_external"))
        frontier = links.where(crawlable(F.col("url"))).select("url", normalized(F.col("url"), options.keep_fragments).alias("page_key"), "parent", "link_idx")
    if pages is None:
        none = spark.createDataFrame([], "url string, page_key string, depth int, seq bigint")
        pages = extracted(fetcher.fetch(none).withColumnRenamed("depth", "crawl_depth"), str(base)).withColumn("issues", F.array().cast(f"array<{ISSUE}>"))
        visited = none.select("page_key")
    return Crawled(pages, visited, levels)


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of every node within ``max_depth`` steps, or any number, of ``seeds`` (node) along ``edges`` (source, target).

    The edges are written down once, those of a source together. Level by level: a level joins its nodes with the edges and drops what was met; each is written before the next, and
    the walk ends when one is empty. Null nodes are never met; nodes needn't have edges. What was met is written anew
    every 16 levels, so that the plan doesn't grow with the depth.
    """
    edges = settle(edges.select("source", "target").where("source is not null and target is not null").repartition("source"))
    level = settle(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    met = level
    for depth in counted(1) if max_depth is None else range(1, max_depth + 1):
        following = level.select(F.col("node").alias("source")).join(edges, "source").select(F.col("target").alias("node")).where("node is not null").distinct()
        level = settle(following.join(met.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        met = met.unionByName(level)
        if depth % 16 == 0:
            met = settle(met)
    return met
