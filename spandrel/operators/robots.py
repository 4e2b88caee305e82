"""robots.txt: parsing into rules, and deciding on addresses.

Quirks that decide results are kept by default: a later group for an agent replaces an earlier one, an agent's own group
replaces that of ``*``, queries aren't looked at, and a pattern with ``*`` that ends in ``$`` hardly matches anything.
``strict=True`` matches such patterns as the robots standard does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.urls import Url, origin_of, path_of

#: The agent whose group is obeyed; it isn't what requests call themselves.
AGENT = "spandrel"
SCHEMA = "domain string, agent string, rule_idx int, pattern string, is_allow boolean"


@dataclass(frozen=True)
class Rule:
    pattern: str
    is_allow: bool


def parse(text: str) -> dict[str, list[Rule]]:
    """Rules by agent, in small letters. Agents that follow each other share a group; comments after values stay."""
    found: dict[str, list[Rule]] = {}
    agents: list[str] = []
    rules: list[Rule] = []

    def save() -> None:
        if agents and rules:
            for agent in agents:
                found[agent] = list(rules)

    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("#") or ":" not in line:
            continue
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if rules:
                save()
                agents, rules = [], []
            if value:
                agents.append(value.lower())
        elif name in ("allow", "disallow") and value:
            rules.append(Rule(value, name == "allow"))
    save()
    return found


def rows(domain: str, text: str) -> list[tuple[str, str, int, str, bool]]:
    """The rules of a robots.txt as rows of SCHEMA."""
    return [(domain, agent, i, r.pattern, r.is_allow) for agent, rules in parse(text).items() for i, r in enumerate(rules)]


def parsed(texts: DataFrame) -> DataFrame:
    """The rules (SCHEMA) of robots.txt texts (domain, text), each parsed where it is; null texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            found = [r for domain, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for r in rows(domain, text)]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts.select("domain", "text").mapInArrow(work, SCHEMA)


def matches(pattern: str, path: str, strict: bool = False) -> bool:
    """Whether a pattern applies to a path."""
    if pattern == path:
        return True
    anchored = pattern.endswith("$")
    body = pattern[:-1] if anchored else pattern
    if "*" not in body:
        return path == body if anchored else path.startswith(body)
    head, *rest = body.split("*")
    if anchored and not strict:
        # What follows a star is matched without the anchor, but nothing may be left before it is tried:
        # only a path that ends where the star stands is matched.
        return path == head and not any(rest)
    end = r"\Z" if anchored else ""
    return re.match(".*".join(map(re.escape, [head, *rest])) + end, path, re.S) is not None


def allowed(rules: Iterable[Rule], path: str, strict: bool = False) -> bool:
    """The verdict of the longest matching pattern, in bytes; of equally long ones the last; without any, allowed."""
    best, verdict = -1, True
    for r in rules:
        size = len(r.pattern.encode("utf-8"))
        if size >= best and matches(r.pattern, path, strict):
            best, verdict = size, r.is_allow
    return verdict


def group_for(groups: dict[str, list[Rule]], agent: str = AGENT) -> list[Rule]:
    return groups.get(agent.lower(), groups.get("*", []))


def is_allowed(groups: dict[str, list[Rule]], url: Url, agent: str = AGENT, strict: bool = False) -> bool:
    return allowed(group_for(groups, agent), url.path, strict)


def matched(pattern: Column, path: Column) -> Column:
    """``matches`` for columns, by plain expressions."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$\z", "")).otherwise(pattern)
    starred = F.contains(body, F.lit("*"))
    # The pattern as a regular expression: all but letters, figures and slashes taken literally, stars as anything.
    as_regex = F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(body, r"([^\p{L}\p{N}/*])", r"\\$1"), F.lit("*"), F.lit(".*")))
    plain = F.when(anchored, path == body).otherwise(F.startswith(path, body))
    ended = F.regexp_replace(body, r"\*+\z", "")
    with_star = F.when(anchored, (path == ended) & ~F.contains(ended, F.lit("*"))).otherwise(F.regexp_like(path, as_regex))
    return (pattern == path) | F.when(starred, with_star).otherwise(plain)


def effective(rules: DataFrame, agent: str = AGENT) -> DataFrame:
    """(domain, rules) where rules is the list of the one group that holds for ``agent``: its own, else that of ``*``."""
    own = rules.where(F.lower("agent").isin(agent.lower(), "*"))
    grouped = own.groupBy("domain", F.lower("agent").alias("agent")).agg(F.sort_array(F.collect_list(F.struct("rule_idx", "pattern", "is_allow"))).alias("rules"))
    return grouped.groupBy("domain").agg(F.max_by("rules", F.col("agent") != "*").alias("rules"))


def verdict(rules: Column, path: Column) -> Column:
    """The verdict on a path of an array of rules (rule_idx, pattern, is_allow); allowed where it is null or empty."""
    hits = F.filter(rules, lambda r: matched(r["pattern"], path))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.octet_length(r["pattern"]).alias("size"), r["rule_idx"].alias("rule_idx"), r["is_allow"].alias("is_allow"))))
    return F.coalesce(best["is_allow"], F.lit(True))


def literal(rules: list[Rule]) -> Column:
    """A group of rules that the driver knows, for ``verdict``."""
    if not rules:
        return F.array().cast("array<struct<rule_idx:int,pattern:string,is_allow:boolean>>")
    return F.array(*(F.struct(F.lit(i).alias("rule_idx"), F.lit(r.pattern).alias("pattern"), F.lit(r.is_allow).alias("is_allow")) for i, r in enumerate(rules)))


def decide(urls: DataFrame, rules: DataFrame, agent: str = AGENT, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed``: the verdict of the rules of the address's origin; without rules, allowed.

    ``rules`` has SCHEMA and few rows a domain (a robots.txt); Spark broadcasts it only if it finds it small. Nothing but
    the path is matched. A null address or one without an origin is allowed.
    """
    grouped = effective(rules, agent).select(F.col("domain").alias("_origin"), F.col("rules").alias("_rules"))
    joined = urls.withColumn("_origin", origin_of(F.col(url))).join(grouped, "_origin", "left")
    return joined.withColumn("allowed", verdict(F.col("_rules"), path_of(F.col(url)))).drop("_origin", "_rules")
