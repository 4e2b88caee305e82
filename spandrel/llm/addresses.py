"""Addresses written differently: one canonical text per address, and the rows that repeat it.

Byte-identical raw addresses are collapsed first, with their counts; only the distinct survivors are canonicalised, once,
by built-in expressions; those that these can't decide (escapes that are no UTF-8, user names, odd hosts) go to
Python. The canonical texts are grouped again, summing the counts. Both groupings combine before the shuffle, so a single
address holding a third of all rows costs a task no more than any other; the joins back have a unique right side, and
adaptive execution splits a hot left partition.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spandrel.tables import written

BREAKS = str.maketrans("", "", "\t\r\n")
SHAPE = re.compile(r"(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.I | re.S)
#: Nothing in such an address can be spelled otherwise but for the order of its parameters.
PLAIN = re.compile(r"https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?:/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)+")
DEFAULT_PORT = {"http": "80", "https": "443"}


def canonical_address(raw: str | None) -> str | None:
    """One text for all spellings of a http or https address; None for null and for any other scheme.

    Ignored: line breaks, tabs, spaces at the ends, case of scheme, host and hex digits, needless or missing escapes,
    the scheme's own port, final dots of the host, empty, dotted and closing path parts, empty query parts, the order
    of parameters, and the fragment. A space in a parameter may be ``+``, ``%20`` or plain.
    """
    if raw is None:
        return None
    text = raw.translate(BREAKS).strip()
    if PLAIN.fullmatch(text):
        return text
    m = SHAPE.match(text)
    if not m:
        return None
    scheme = m[1].lower()
    user, at, host = m[2].rpartition("@")
    host, colon, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    port = port.strip(".")
    host = unquote_to_bytes(host).decode("utf-8", "replace").lower().rstrip(".")
    if not host:
        return None
    if port and port != DEFAULT_PORT[scheme]:
        host = f"{host}:{port}"
    parts: list[str] = []
    for part in m[3].split("/"):
        part = quote(unquote_to_bytes(part), safe="") if "%" in part or not part.isascii() or not part.isalnum() else part
        if part == "..":
            if parts:
                parts.pop()
        elif part and part != ".":
            parts.append(part)
    params = []
    for part in (m[4] or "").split("&"):
        if part:
            name, eq, value = part.partition("=")
            params.append(_query_text(name) + eq + _query_text(value))
    params.sort()
    return f"{scheme}://{user}{at}{host}/{'/'.join(parts)}" + (f"?{'&'.join(params)}" if params else "")


def _query_text(text: str) -> str:
    if text.isascii() and text.isalnum():
        return text
    return quote(unquote_to_bytes(text.replace("+", " ")), safe="")


@F.pandas_udf(StringType())
def _canonical(urls: pd.Series) -> pd.Series:
    return pd.Series([canonical_address(x) for x in urls], dtype=object)


#: Not deterministic by name only: the optimiser then neither moves it below the collapse nor repeats it in filters.
_once = _canonical.asNondeterministic()

#: What built-in expressions decide: a plain host, and a port of figures.
EASY = r"(?is)^https?://(?=[.-]*[a-z0-9])[a-z0-9.-]+(?::[0-9]*\.?)?(?:[/?#].*)?$"
#: What a replacement character is when encoded: escapes that were no UTF-8.
LOST = "%EF%BF%BD"


def _encoded(text: Column, plus: bool) -> Column:
    """One way to write ``text``; null where its escapes are cut off. With ``plus``, a plus sign is a space."""
    right = F.url_encode(F.try_url_decode(text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))))
    right = F.replace(F.replace(F.replace(right, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(text.rlike("^[A-Za-z0-9_.-]*$"), text).otherwise(right)


def with_built_in(rows: DataFrame) -> DataFrame:
    """``rows`` with ``easy``: the canonical address of ``url`` by built-in expressions, null where these can't decide or the
    scheme is another. Each step is a projection of its own, so that nothing is computed twice."""
    u, parts, params = F.col("_u"), F.col("_parts"), F.col("_params")
    cut = F.substring_index(F.regexp_replace(F.translate("url", "\t\r\n", ""), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), "#", 1)
    own = ["_u", "_parts", "_params"]
    out = rows.withColumn("_u", cut).withColumn("_u", F.when(u.rlike(EASY), u))
    of_path = F.filter(F.transform(F.split(F.regexp_extract(u, "(?s)^[^:]*://[^/?]*([^?]*)", 1), "/"), lambda p: _encoded(p, False)), lambda p: p.isNull() | ~p.isin("", "."))
    given = F.filter(F.split(F.substring(u, F.locate("?", u) + 1, F.length(u)), "&"), lambda p: p != "")
    of_query = F.array_sort(F.transform(given, lambda p: F.when(F.contains(p, F.lit("=")), F.concat(_encoded(F.substring_index(p, "=", 1), True), F.lit("="), _encoded(F.regexp_replace(p, "(?s)^[^=]*=", ""), True))).otherwise(_encoded(p, True))))
    out = out.withColumns({"_parts": of_path, "_params": F.when(F.contains(u, F.lit("?")), of_query).otherwise(F.array().cast("array<string>"))})
    climbed = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    out = out.withColumn("_parts", F.when(F.array_contains(parts, ".."), climbed).otherwise(parts))
    scheme = F.lower(F.substring_index(u, ":", 1))
    authority = F.lower(F.regexp_extract(u, "^[^:]*://([^/?]*)", 1))
    port = F.regexp_extract(authority, ":([0-9]+)", 1)
    usual = F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))
    host = F.concat(F.rtrim(F.substring_index(authority, ":", 1), F.lit(".")), F.when((port == "") | (port == usual), F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    address = F.concat(scheme, F.lit("://"), host, F.lit("/"), F.array_join(parts, "/"), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))
    # A null part makes all of it null: array_join would leave it out.
    whole = ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(params, lambda p: p.isNull())
    return out.withColumn("easy", F.when(whole, address)).withColumn("easy", F.when(~F.contains("easy", F.lit(LOST)), F.col("easy"))).drop(*own)


def _survivors(rows: DataFrame) -> DataFrame:
    """(kind, url, low, n) of each distinct raw address, with its canonical ``address``."""
    raw = rows.where(F.col("url").isNotNull()).groupBy("kind", "url").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    easy = raw.where(F.col("url").rlike(r"(?i)^\s*h[\t\r\n]*t[\t\r\n]*t[\t\r\n]*p") | ~F.substring("url", 1, 1).rlike("[!-~]"))
    easy = with_built_in(easy)
    hard = easy.withColumn("hard", _once(F.when(F.col("easy").isNull(), F.col("url"))))
    return hard.withColumn("address", F.coalesce("easy", "hard")).where(F.col("address").isNotNull()).select("kind", "url", "low", "n", "address")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def collapse_addresses(rows: DataFrame) -> DataFrame:
    """(kind, address, first_id, n) of each address in ``rows`` (kind, id, url): its smallest id and number of rows.

    Null, empty and non-web addresses give no row, an empty input none at all. Further columns of ``rows`` are ignored.
    """
    return _survivors(rows.select("kind", "id", "url")).groupBy("kind", "address").agg(F.min("low").alias("first_id"), F.sum("n").alias("n"))


def repeated_addresses(rows: DataFrame) -> DataFrame:
    """(kind, first_id, copy_id) of every row whose address an earlier row (smaller id) of its kind has too.

    ``rows`` has kind, id (unique within a kind) and url. Nulls, empty and non-web addresses are no cases.
    """
    rows = rows.select("kind", "id", "url")
    survivors = written(_survivors(rows).select("kind", _digest(F.col("url")).alias("raw"), "low", "n", "address", _digest(F.col("address")).alias("key")))
    # Grouped on the full canonical text; digests of 128 bits carry the result back to the spellings and to their rows.
    groups = survivors.groupBy("kind", "address").agg(F.min("low").alias("first_id"), F.sum("n").alias("n")).where("n > 1").select("kind", _digest(F.col("address")).alias("key"), "first_id")
    firsts = survivors.select("kind", "raw", "key").join(groups, ["kind", "key"]).select("kind", "raw", "first_id")
    spelled = rows.where("url is not null").select("kind", "id", _digest(F.col("url")).alias("raw"))
    return spelled.join(firsts, ["kind", "raw"]).where("id <> first_id").select("kind", "first_id", F.col("id").alias("copy_id"))
