"""One pass over a page's HTML for everything the audit needs.

A tokeniser, not a tree builder: text belongs to the open title, headings and anchors it stands in, scripts and styles in
them included, comments not; an unclosed element ends with the page. Repairs of misnested markup that need a tree
(foster parenting, the adoption agency) aren't made, and a template's contents count as content.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

from spandrel.functions.urls import BadUrl, Url, is_external, parse

# Elements whose content is text, with entities or without.
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset(("title", "textarea"))
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Elements that link, and the attribute that says where to.
LINKING = {"a": "href", "iframe": "src", "video": "src", "source": "src", "audio": "src", "embed": "src", "object": "data"}
TAGS = ("og_title", "og_description", "og_image", "og_url", "og_type", "og_site_name", "og_locale")
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)(=|[A-Za-z0-9])?")
_WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def trim(text: str) -> str:
    return text.strip(_WHITE)


def _attribute_text(text: str) -> str:
    """Entities of an attribute; one without semicolon that runs on is none, as in ``?a=1&copy=2``."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        name = m[1]
        if name.endswith(";") or name.startswith("#"):
            return html.unescape(f"&{name}") + (m[2] or "")
        return html5[name] if name in html5 and not m[2] else m[0]

    return _ENTITY.sub(one, text)


def attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag, names in small letters; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = next((x for x in m.groups()[1:] if x is not None), "")
        found.setdefault(m[1].lower(), _attribute_text(value))
    return found


def tokens(source: str):  # noqa: ANN201
    """(kind, tag, value): starts with their attributes, ends, and texts with entities decoded."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    at, size = 0, len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        if not m:
            yield "text", None, html.unescape(source[at:])
            return
        if m.start() > at:
            yield "text", None, html.unescape(source[at : m.start()])
        at = m.end()
        if m["end"]:
            yield "end", m["end"].lower(), None
        elif m["tag"]:
            tag = m["tag"].lower()
            yield "start", tag, attributes(m["attrs"])
            if tag in RAW or tag in ESCAPABLE_RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                stop = close.start() if close else size
                text = source[at:stop]
                if text:
                    yield "text", None, html.unescape(text) if tag in ESCAPABLE_RAW else text
                at = stop
                if not close:
                    yield "end", tag, None


def empty_extract() -> dict:
    return {"title": None, "meta_description": None, "h1_tags": [], "open_graph": dict.fromkeys(TAGS), "links": [], "images": []}


def extract(source: str, page_url: str, base: Url) -> dict:
    """Title, description, h1, Open Graph tags, links and images of a page.

    Links and images resolve against ``page_url`` as requested, and are external as seen from the crawl's ``base``. What
    doesn't resolve is left out, repeated links stay. Title, h1 and anchor texts are trimmed, attributes are not.
    """
    page = parse(page_url)
    out = empty_extract()
    seen_description, seen_tags = False, set()
    title: list[str] | None = None
    heading: tuple[str, list[str]] | None = None
    anchor: tuple[dict, list[str]] | None = None
    og = out["open_graph"]

    def resolve(reference: str) -> Url | None:
        try:
            return parse(reference, page)
        except BadUrl:
            return None

    def close_heading() -> None:
        nonlocal heading
        if heading and heading[0] == "h1":
            out["h1_tags"].append(trim("".join(heading[1])))
        heading = None

    def close_anchor() -> None:
        nonlocal anchor
        if anchor:
            anchor[0]["text"] = trim("".join(anchor[1]))
        anchor = None

    for kind, tag, value in tokens(source):
        if kind == "text":
            for open_text in (title, heading and heading[1], anchor and anchor[1]):
                if open_text is not None:
                    open_text.append(value)
        elif kind == "end":
            if tag == "title" and title is not None:
                if out["title"] is None:
                    out["title"] = trim("".join(title))
                title = None
            elif tag in HEADINGS:
                close_heading()
            elif tag == "a":
                close_anchor()
        else:
            if tag == "title":
                title = []
            elif tag in HEADINGS:
                close_heading()
                heading = (tag, [])
            elif tag == "meta":
                if value.get("name") == "description" and not seen_description:
                    seen_description = True
                    out["meta_description"] = value.get("content")
                name = value.get("property", "").replace(":", "_", 1)
                if value.get("property", "").startswith("og:") and name in og and name not in seen_tags:
                    seen_tags.add(name)
                    og[name] = value.get("content")
            elif tag == "img" and "src" in value:
                src = resolve(value["src"])
                if src is not None:
                    out["images"].append({"src": str(src), "alt": value.get("alt")})
            if tag == "a":
                close_anchor()
            if (attribute := LINKING.get(tag)) and attribute in value and (target := resolve(value[attribute])) is not None:
                label = {"iframe": f"[iframe] {value.get('title', '')}", "source": f"[source type={value.get('type', '')}]"}.get(tag, f"[{tag}]")
                link = {"url": str(target), "text": label, "is_external": is_external(target, base), "status_code": None, "redirected_url": None, "check_error": None}
                out["links"].append(link)
                if tag == "a":
                    link["text"] = ""
                    anchor = (link, [])
    if title is not None and out["title"] is None:
        out["title"] = trim("".join(title))
    close_heading()
    close_anchor()
    return out
