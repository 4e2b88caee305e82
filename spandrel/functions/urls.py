"""Addresses as browsers understand them: parsing, joining, serialising, and the crawler's questions about them."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ports of the special schemes.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
# File endings that never hold a page.
NON_PAGE_ENDINGS = "7z aac avi avif bin bmp css csv doc docx eot flac gif gz ico jpeg jpg js json m4a m4v mid midi mjs mov mp3 mp4 mpeg mpg ogg ogv otf pdf png ppt pptx rar svg swf tar tgz ttf txt wav webm webp woff woff2 xls xlsx xml zip".split()
CRAWL_SCHEMES = ("http", "https")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
#: Addresses that are serialised as they stand.
_PLAIN = re.compile(r"(https?)://((?:[a-z0-9_-]+\.)*[a-z_-][a-z0-9_-]*)(/[A-Za-z0-9_~!$&'()*+,;=:@/-]*(?:\.[A-Za-z0-9_~-][A-Za-z0-9_~!$&()*+,;=:@/-]*)*)(?:\?([A-Za-z0-9_.~!$&()*+,;=:@/?%-]*))?(?:#([A-Za-z0-9_.~!$&'()*+,;=:@/?%-]*))?")
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_CONTROLS = "".join(map(chr, range(33)))
# What is escaped besides controls and non-ASCII characters.
ESCAPED_IN = {"fragment": ' "<>`', "query": ' "#<>', "special-query": " \"#<>'", "path": ' "#<>?`{}', "user": ' "#<>?`{}/:;=@[\\]^|', "opaque": "", "host": ""}


class BadUrl(ValueError):
    """The text is no address, or a relative one without a base."""


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    user: str = ""
    password: str = ""
    opaque: bool = False

    def __str__(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            login = self.user + (f":{self.password}" if self.password else "")
            out += "//" + (f"{login}@" if login else "") + self.host + ("" if self.port is None else f":{self.port}")
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        return out + self.path + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")

    @property
    def special(self) -> bool:
        return self.scheme in DEFAULT_PORTS

    @property
    def origin(self) -> str:
        """Scheme, host and a port that isn't the scheme's own: the key of robots rules."""
        return f"{self.scheme}://{self.host or ''}" + ("" if self.port is None else f":{self.port}")

    @property
    def last_segment(self) -> str | None:
        """The last path segment that isn't empty, escaped as it is; of an opaque path none."""
        if self.opaque:
            return None
        return next((x for x in reversed(self.path.split("/")) if x), None)


def _escape(text: str, where: str) -> str:
    out = []
    more = ESCAPED_IN[where]
    for ch in text:
        if ch < "!" and (ch != " " or " " in more) or ch > "~" or ch in more:
            out.append("".join(f"%{b:02X}" for b in ch.encode("utf-8", "replace")))
        else:
            out.append(ch)
    return "".join(out)


def _host(text: str, special: bool) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise BadUrl("unclosed IPv6 address")
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]"
        except ValueError as e:
            raise BadUrl(str(e)) from e
    if not special:
        if re.search(r"[\x00\t\n\r #/:<>?@\[\\\]^|]", text):
            raise BadUrl("forbidden character in the host")
        return _escape(text, "host")
    from urllib.parse import unquote

    text = unquote(text, errors="replace").translate({0xAD: None, 0x200B: None, 0x2060: None, 0xFEFF: None})
    if not text.isascii():
        for dot in "。．｡":
            text = text.replace(dot, ".")
        try:
            text = text.encode("idna").decode("ascii")
        except UnicodeError as e:
            raise BadUrl("host can't be written in ASCII") from e
    text = text.lower()
    if not text or _FORBIDDEN_HOST.search(text):
        raise BadUrl("bad host")
    return _ipv4(text) or text


def _ipv4(text: str) -> str | None:
    """A host whose last label is a number is an IPv4 address, in any of its notations."""
    labels = text.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    if not re.fullmatch(r"\d+|0x[0-9a-f]*", labels[-1]):
        return None
    try:
        numbers = [int(x[2:] or "0", 16) if x.startswith("0x") else int(x, 8) if x.startswith("0") and len(x) > 1 else int(x) for x in labels]
    except ValueError as e:
        raise BadUrl("bad IPv4 address") from e
    if len(numbers) > 4 or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise BadUrl("bad IPv4 address")
    value = numbers[-1] + sum(x << (8 * (3 - i)) for i, x in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _authority(text: str, scheme: str) -> Url:
    special = scheme in DEFAULT_PORTS
    login, at, hostport = text.rpartition("@")
    user, _, password = login.partition(":")
    m = re.fullmatch(r"(\[.*\]|[^:]*)(?::([0-9]*))?", hostport, re.S)
    if not m:
        raise BadUrl("bad port")
    if special and scheme != "file" and not m[1]:
        raise BadUrl("empty host")
    host = _host(m[1], special) if m[1] else ""
    port = int(m[2]) if m[2] else None
    if port is not None and port > 65535:
        raise BadUrl("port out of range")
    if port == DEFAULT_PORTS.get(scheme):
        port = None
    return Url(scheme, "" if scheme == "file" and host == "localhost" else host, port, user=_escape(user, "user"), password=_escape(password, "user"))


def _path(text: str, special: bool, before: list[str] | None = None) -> str:
    """An absolute path with dot segments resolved; ``before`` are the segments a relative one goes on from."""
    segments = re.split(r"[/\\]" if special else "/", text)
    out = list(before or [])
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        plain = segment.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_escape(segment, "path"))
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url:
    """The address that ``text`` is, by itself or relative to ``base``; BadUrl if it is none."""
    if (m := _PLAIN.fullmatch(text)) and "/." not in m[3]:
        return Url(m[1], m[2], None, m[3], m[4], m[5])
    text = text.strip(_CONTROLS).translate({9: None, 10: None, 13: None})
    text, mark, fragment = text.partition("#")
    end = {"fragment": _escape(fragment, "fragment") if mark else None}
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme in DEFAULT_PORTS:
            if base is not None and base.scheme == scheme and not rest.startswith(("/", "\\")):
                return replace(_relative(rest, base), **end)
            if scheme == "file":
                rest = rest.replace("\\", "/")
                body, q, query = rest.partition("?")
                host = ""
                if body.startswith("//"):
                    host, slash, tail = body[2:].partition("/")
                    body = slash + tail
                found = replace(_authority(host, scheme), path=_path(body.removeprefix("/"), True))
                return replace(found, query=_escape(query, "special-query") if q else None, **end)
            return replace(_after_authority(rest.lstrip("/\\"), scheme), **end)
        if rest.startswith("//"):
            return replace(_after_authority(rest[2:], scheme), **end)
        body, q, query = rest.partition("?")
        query = _escape(query, "query") if q else None
        if rest.startswith("/"):
            return Url(scheme, path=_path(body[1:], False), query=query, **end)
        return Url(scheme, path=_escape(body, "opaque"), query=query, opaque=True, **end)
    if base is None:
        raise BadUrl("relative address without a base")
    if base.opaque:
        if text:
            raise BadUrl("relative to an opaque address")
        return replace(base, **end)
    return replace(_relative(text, base), **end)


def _after_authority(rest: str, scheme: str) -> Url:
    special = scheme in DEFAULT_PORTS
    cut = re.search(r"[/?\\]" if special else "[/?]", rest)
    at = cut.start() if cut else len(rest)
    url = _authority(rest[:at], scheme)
    body, q, query = rest[at:].partition("?")
    path = _path(body[1:], special) if body or special else ""
    return replace(url, path=path, query=_escape(query, "special-query" if special else "query") if q else None)


def _relative(text: str, base: Url) -> Url:
    slashes = ("/", "\\") if base.special else ("/",)
    if text[:1] in slashes and text[:1] and text[1:2] in slashes and text[1:2]:
        return _after_authority(text[2:].lstrip("/\\") if base.special else text[2:], base.scheme)
    body, q, query = text.partition("?")
    query = _escape(query, "special-query" if base.special else "query") if q else None
    if body[:1] in slashes and body:
        return replace(base, path=_path(body[1:], base.special), query=query)
    if not body:
        return replace(base, query=query if q else base.query)
    return replace(base, path=_path(body, base.special, base.path.split("/")[1:-1]), query=query)


def join(base: str, reference: str) -> str | None:
    """The serialised address of ``reference`` on the page ``base``; None if there is none."""
    try:
        return str(parse(reference, parse(base)))
    except BadUrl:
        return None


def try_parse(text: str | None) -> Url | None:
    try:
        return None if text is None else parse(text)
    except BadUrl:
        return None


def normalize(url: str, keep_fragments: bool = False) -> str:
    """The key of a page: the address up to the first ``#``, otherwise unchanged."""
    return url if keep_fragments else url.partition("#")[0]


def is_external(url: Url, base: Url) -> bool:
    """Another host or port than the crawl's base; the scheme doesn't count, a subdomain is another host."""
    return (url.host or None, url.port) != (base.host or None, base.port)


def ending(url: Url) -> str | None:
    segment = url.last_segment
    return segment.rpartition(".")[2].lower() if segment and "." in segment else None


def is_crawlable(text: str) -> bool:
    """Whether a discovered link may be a page: a web address without the ending of another kind of file."""
    url = try_parse(text)
    return url is not None and url.scheme in CRAWL_SCHEMES and ending(url) not in NON_PAGE_ENDINGS


def checked_seed(text: str) -> Url:
    """The seed's address; ValueError if it is none or not of the web."""
    try:
        url = parse(text)
    except BadUrl as e:
        raise ValueError(f"Invalid URL: {e}") from e
    if url.scheme not in CRAWL_SCHEMES:
        raise ValueError(f"Invalid URL scheme '{url.scheme}': only http and https are supported")
    return url


def is_scan_url(text: str) -> bool:
    """Whether the text literally begins as a web address; case counts."""
    return text.startswith(("http://", "https://"))


def robots_url(base: Url) -> str:
    return str(replace(base, path="/robots.txt", query=None, fragment=None))


# The same for columns of serialised addresses, without leaving the JVM.


def normalized(url: Column, keep_fragments: bool = False) -> Column:
    return url if keep_fragments else F.substring_index(url, "#", 1)


def scheme_of(url: Column) -> Column:
    """The scheme in small letters; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    """The host in small letters; null for addresses without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def port_of(url: Column) -> Column:
    """The port, null where it is absent or the scheme's own."""
    port = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|\z)", 1), F.lit("")).try_cast("int")
    own = F.when(scheme_of(url) == "http", 80).when(scheme_of(url) == "https", 443)
    return F.when(~port.eqNullSafe(own), port)


def external(url: Column, base: Column) -> Column:
    return ~(host_of(url).eqNullSafe(host_of(base)) & port_of(url).eqNullSafe(port_of(base)))


def path_of(url: Column) -> Column:
    """The path of a hierarchical address, ``/`` for an empty one."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def last_segment_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(path_of(url), r"([^/]+)/*\z", 1), F.lit(""))


def ending_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(last_segment_of(url), r"\.([^.]*)\z", 1)), F.lit(""))


def crawlable(url: Column) -> Column:
    return F.coalesce(scheme_of(url).isin(*CRAWL_SCHEMES), F.lit(False)) & ~F.coalesce(ending_of(url).isin(*NON_PAGE_ENDINGS), F.lit(False))


def origin_of(url: Column) -> Column:
    port = port_of(url)
    return F.concat(scheme_of(url), F.lit("://"), host_of(url), F.when(port.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))))


def redirected(requested: Column, final: Column) -> Column:
    """Where a request ended up, if that differs in more than the fragment; else null."""
    return F.when(~normalized(requested).eqNullSafe(normalized(final)) & final.isNotNull(), final)
