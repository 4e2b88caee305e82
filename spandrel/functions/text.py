"""Text functions: white space, lengths in bytes, shortening, durations and display titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.urls import last_segment_of

# Fixed value: white space as Unicode has it.
WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ELLIPSIS = "…"
UNTITLED = "(untitled)"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return text.isNull() | (trimmed(text) == "")


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def contains_folded(text: Column, query: Column) -> Column:
    """Whether the text contains the query, letter case aside; ``%`` and ``_`` are letters like others."""
    return F.contains(F.lower(text), F.lower(query))


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last of a longer text being an ellipsis."""
    if size <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit(ELLIPSIS))).otherwise(text)


def shortened_left(text: Column, size: int) -> Column:
    """At most ``size`` characters from the end, the first of a longer text being an ellipsis."""
    if size <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.char_length(text) > size, F.concat(F.lit(ELLIPSIS), F.right(text, F.lit(size - 1)) if size > 1 else F.lit(""))).otherwise(text)


def duration(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from an hour on."""
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours.cast("long"), minutes.cast("long"), rest.cast("long"))).otherwise(F.format_string("%02d:%02d", minutes.cast("long"), rest.cast("long")))


def is_html(content_type: Column) -> Column:
    """Whether a response is taken for a page: no content type, or one of HTML or XHTML."""
    return content_type.isNull() | F.lower(content_type).rlike("text/html|application/xhtml")


def display_title(title: Column, url: Column, content_type: Column) -> Column:
    """The trimmed title; without one, the last path segment of what isn't HTML, or a stand-in."""
    return F.coalesce(F.nullif(trimmed(title), F.lit("")), F.when(~is_html(content_type), last_segment_of(url)), F.lit(UNTITLED))
