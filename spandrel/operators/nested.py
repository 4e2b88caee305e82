"""Deeply nested records into related flat tables, by shared inlining.

The graph of element types is analysed first: the root, and every element that repeats, is shared by several parents or
occurs within itself, gets a table; an element that occurs at most once in one parent becomes columns of its parent's
table. A row knows its own id, its parent's id and its place. Documents are parsed once a level as VARIANT and all lists
of a level are unnested by one generator, so the plan has no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Element:
    """An element type: its scalar fields with their types, and its children; ``many`` names those that repeat.

    ``keyed`` names repeating children that may be an object of them by key in place of a list; ``sign`` is a scalar
    field that tells a single such child from an object of them by key.
    """

    name: str
    scalars: dict[str, str] = field(default_factory=dict)
    children: dict[str, Element] = field(default_factory=dict)
    many: frozenset[str] = frozenset()
    keyed: frozenset[str] = frozenset()
    sign: str = "url"


@dataclass
class Table:
    """A table: its element, and its columns as (name, path within the element, type)."""

    name: str
    element: Element
    columns: list[tuple[str, str, str]]
    children: list[tuple[str, Element]]


def analyse(root: Element) -> dict[str, Table]:
    """The tables that shared inlining makes of the graph below ``root``, by element name."""
    parents: dict[str, int] = {}
    repeated: set[str] = set()
    recursive: set[str] = set()
    seen: dict[str, Element] = {}

    def visit(e: Element, above: tuple[str, ...]) -> None:
        if e.name in above:
            recursive.add(e.name)
        if e.name in seen:
            return
        seen[e.name] = e
        for name, child in e.children.items():
            parents[child.name] = parents.get(child.name, 0) + 1
            if name in e.many:
                repeated.add(child.name)
            visit(child, (*above, e.name))

    visit(root, ())
    own = {root.name} | repeated | recursive | {n for n, k in parents.items() if k > 1}
    tables = {}
    for name in own:
        columns: list[tuple[str, str, str]] = []
        below: list[tuple[str, Element]] = []

        def inline(e: Element, prefix: str, path: str, columns: list = columns, below: list = below) -> None:
            columns.extend((prefix + s, f"{path}.{s}", kind) for s, kind in e.scalars.items())
            for child_name, child in e.children.items():
                if child.name in own:
                    below.append((f"{path}.{child_name}", child))
                else:
                    inline(child, f"{prefix}{child_name}_", f"{path}.{child_name}")

        inline(seen[name], "", "$")
        tables[name] = Table(name, seen[name], columns, below)
    return tables


def whole_json(text: Column | str) -> Column:
    """The VARIANT of a text that is one whole JSON value; null for null, empty, invalid and cut-off texts."""
    text = F.col(text) if isinstance(text, str) else text
    # The parser stops after a value; inside of brackets what follows it is an error.
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(parsed) == 1, parsed[0])


def _is_object(v: Column) -> Column:
    """Whether a VARIANT is an object: nothing else can be read as a struct, of whatever field."""
    return F.try_variant_get(v, "$", "struct<_:string>").isNotNull()


def found_within(rows: DataFrame, column: str, name: str, text: str) -> DataFrame:
    """``rows`` with the VARIANT ``column`` being the object with the field ``name`` that it is or holds, else null.

    It may be wrapped in objects and JSON strings any number of times; ``text`` is the column of the text that was parsed.
    A wrapper adds a brace or a quotation mark of its own before the field, so their number there bounds the steps.
    """
    has = lambda x: F.try_variant_get(x, f"$.{name}", "variant").isNotNull()

    def step(v: Column) -> Column:
        values = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        likely = F.filter(values, lambda x: has(x) | F.coalesce(F.try_variant_get(x, "$", "variant").isNotNull() & (_is_object(x) | F.try_variant_get(x, "$", "string").rlike(r'^\s*[{"]')) & F.contains(F.try_variant_get(x, "$", "string"), F.lit(name)), F.lit(False)))
        return F.when(has(v), v).when(_is_object(v), F.get(likely, F.lit(0))).otherwise(whole_json(F.try_variant_get(v, "$", "string")))

    before = F.expr(f"left({text}, length({text}) - length(substring_index({text}, '\"{name}', -1)))")
    steps = F.length(F.regexp_replace(before, r"[^{]", "")) + F.regexp_count(before, F.lit(r'"(?=\\*["{])'))
    v = F.col(column)
    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), v, lambda x, _: step(x))
    rows = rows.withColumn(column, F.when(has(v), v).otherwise(inner))
    return rows.withColumn(column, F.when(has(v), v))


_LISTED = "array<struct<idx:int,key:string,element:variant>>"


def as_list(v: Column, keyed: bool = False, sign: str = "url") -> Column:
    """The members of a list as (idx, key, element), null ones counted but left out; a single object is a list of one.

    With ``keyed``, an object without the scalar ``sign`` holds its members by key.
    """
    listed = F.try_variant_get(v, "$", "array<variant>")
    of_list = F.transform(listed, lambda x, i: F.struct(i.alias("idx"), F.lit(None).cast("string").alias("key"), x.alias("element")))
    single = F.when(_is_object(v), F.array(F.struct(F.lit(0).alias("idx"), F.lit(None).cast("string").alias("key"), v.alias("element"))))
    out = F.coalesce(of_list, single)
    if keyed:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        of_map = F.transform(entries, lambda x, i: F.struct(i.alias("idx"), x["key"].alias("key"), x["value"].alias("element")))
        out = F.coalesce(of_list, F.when(F.try_variant_get(v, f"$.{sign}", "string").isNotNull() & ~_is_object(F.try_variant_get(v, f"$.{sign}", "variant")), single).otherwise(of_map))
    return F.filter(out, lambda x: _is_object(x["element"]))


def _named(child: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(child).alias("child"), x["idx"].alias("idx"), x["key"].alias("key"), x["element"].alias("element"))


def inlined(table: Table, name: str) -> list[tuple[str, str]]:
    """The (field, path) of the columns that the singleton ``name`` became in ``table``."""
    return [(path.rpartition(".")[2], path) for column, path, _ in table.columns if path.startswith(f"$.{name}.")]


def unnest(rows: DataFrame, table: Table, carry: dict[str, str] | None = None, singles: tuple[str, ...] = ()) -> DataFrame:
    """(id, parent_id, child, idx, key, element, carried...) of all members of all lists of the rows of ``table``.

    ``rows`` has id and element; ``carry`` maps further columns to names that the result has them by. Of the inlined
    singletons ``singles`` there is a member for each field that isn't null, by its name as key.
    """
    carried = [F.col(a).alias(b) for a, b in (carry or {}).items()]
    lists = []
    for name in singles:
        fields = F.array(*(F.struct(F.lit(name).alias("child"), F.lit(0).alias("idx"), F.lit(f).alias("key"), F.try_variant_get("element", path, "variant").alias("element")) for f, path in inlined(table, name)))
        lists.append(F.filter(fields, lambda x: ~F.is_variant_null(x["element"]) & x["element"].isNotNull()))
    for path, child in table.children:
        name = path.rpartition(".")[2]
        members = as_list(F.try_variant_get("element", path, "variant"), name in table.element.keyed, child.sign)
        lists.append(F.transform(F.coalesce(members, F.array().cast(_LISTED)), _named(name)))
    # Outer, and filtered behind: filters on what is generated would be moved before it and parse everything again.
    out = rows.select(F.col("id").alias("parent_id"), *carried, F.inline_outer(F.concat(*lists))).where("child is not null")
    return out.withColumn("id", F.concat_ws("/", "parent_id", F.concat_ws(".", "child", F.col("idx").cast("string"))))


def columns_of(table: Table) -> list[Column]:
    """The columns of ``table`` from its rows' elements, inlined elements included."""
    return [F.try_variant_get("element", path, kind).alias(name) for name, path, kind in table.columns]


def _roots(documents: DataFrame, id_column: str, text_column: str, root: Element, marker: str | None) -> DataFrame:
    """(id, parent_id, child, idx, key, element) of the root elements. A field given twice counts as it is given last."""
    spark = documents.sparkSession
    conf, before = "spark.sql.variant.allowDuplicateKeys", spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false")
    spark.conf.set(conf, "true")  # it is read when the expressions are made
    try:
        top = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("_text"), whole_json(text_column).alias("element"))
        top = found_within(top, "element", marker, "_text") if marker else top
        return top.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(root.name).alias("child"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("key"), "element")
    finally:
        spark.conf.set(conf, before)


def shred(documents: DataFrame, id_column: str, text_column: str, root: Element, marker: str | None = None) -> dict[str, DataFrame]:
    """The tables of JSON documents, by element name: id, parent_id, child, idx, key, and the element's columns.

    A root row's id is the document's, as text. ``marker`` is a field by which the root is found within wrappers. Null,
    empty and invalid documents give no rows; absent and null lists none either; fields of the graph that are absent,
    null or of another type are null, fields that the graph doesn't have are left out. Recursive elements are followed
    level by level until a level is empty.
    """
    tables = analyse(root)
    top = _roots(documents, id_column, text_column, root, marker)
    found: dict[str, DataFrame] = {root.name: top.where("element is not null")}
    keys = ["id", "parent_id", "child", "idx", "key", "element"]
    level = {root.name: top}
    met: dict[str, int] = {root.name: 1}
    while level:
        following: dict[str, DataFrame] = {}
        for name, rows in level.items():
            table = tables[name]
            if not table.children:
                continue
            members = unnest(rows, table).select(*keys)
            for path, child in table.children:
                own = members.where(F.col("child") == path.rpartition(".")[2])
                if met.get(child.name, 0) and own.isEmpty():
                    continue  # a recursive or shared element has ended here
                following[child.name] = following[child.name].unionByName(own) if child.name in following else own
        for name, rows in following.items():
            met[name] = met.get(name, 0) + 1
            found[name] = found[name].unionByName(rows) if name in found else rows
        level = following
    return {name: rows.select("id", "parent_id", "child", "idx", "key", *columns_of(tables[name])) for name, rows in found.items()}


# The graph of a saved crawl report.
TAGS = ("og_title", "og_description", "og_image", "og_url", "og_type", "og_site_name", "og_locale")
LINK = Element("links", {"url": "string", "text": "string", "is_external": "boolean", "status_code": "int", "redirected_url": "string", "check_error": "string"})
IMAGE = Element("images", {"src": "string", "alt": "string"})
ISSUE = Element("issues", {"severity": "string", "issue_type": "string", "message": "string"})
OPEN_GRAPH = Element("open_graph", {t: "string" for t in TAGS})
PAGE = Element(
    "pages",
    {"url": "string", "status_code": "int", "content_type": "string", "title": "string", "meta_description": "string", "h1_tags": "array<string>", "crawl_depth": "int"},
    {"links": LINK, "images": IMAGE, "issues": ISSUE, "open_graph": OPEN_GRAPH},
    frozenset({"links", "images", "issues"}),
)
SUMMARY = Element("summary", {x: "bigint" for x in ("total_pages", "total_links", "broken_links", "errors", "warnings", "infos")})
REPORT = Element("report", {"start_url": "string", "timestamp": "string"}, {"summary": SUMMARY, "pages": PAGE}, frozenset({"pages"}), frozenset({"pages"}))
#: The field that names a child record.
ITEM = {"links": "url", "images": "src", "issues": "issue_type"}


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The tables of saved reports (report_id, payload): report, pages, links, images, issues."""
    return shred(reports, "report_id", "payload", REPORT, "pages")


def report_children(reports: DataFrame) -> DataFrame:
    """(report_id, page_key, child, idx, item) of every child record of every page of ``reports`` (report_id, payload).

    ``page_key`` is the page's url, or where that is absent its key; ``idx`` the place in the list, null members counted
    but left out. Of open_graph there is one row for each tag that isn't null, with idx 0 and the tag's name. Payloads
    that are null, empty, not whole valid JSON or no report give no rows.
    """
    tables = analyse(REPORT)
    top = _roots(reports, "report_id", "payload", REPORT, "pages")
    pages = unnest(top, tables["report"], {"id": "report_id"})
    page_key = F.coalesce(F.try_variant_get("element", "$.url", "string"), F.col("key"))
    keyed = pages.select(F.col("report_id").cast("bigint").alias("report_id"), "id", page_key.alias("page_key"), "element")
    members = unnest(keyed, tables["pages"], {"report_id": "report_id", "page_key": "page_key"}, ("open_graph",))
    item = F.col("key")
    for child, name in ITEM.items():
        item = F.when(F.col("child") == child, F.try_variant_get("element", f"$.{name}", "string")).otherwise(item)
    return members.select("report_id", "page_key", "child", "idx", item.alias("item"))


def children_of_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``report_children`` by the keys of the tables of saved reports, with a join of children and pages."""
    pages = tables["pages"]
    page_key = F.coalesce("url", "key").alias("page_key")
    parents = pages.select(F.col("id").alias("parent_id"), F.col("parent_id").cast("bigint").alias("report_id"), page_key)
    records = [tables[child].select("parent_id", F.lit(child).alias("child"), "idx", F.col(name).alias("item")) for child, name in ITEM.items()]
    out = records[0].unionByName(records[1]).unionByName(records[2]).join(parents, "parent_id").select("report_id", "page_key", "child", "idx", "item")
    tags = F.array(*(F.when(F.col(f"open_graph_{t}").isNotNull(), F.lit(t)) for t in TAGS))
    of_tags = pages.select(F.col("parent_id").cast("bigint").alias("report_id"), page_key, F.lit("open_graph").alias("child"), F.lit(0).alias("idx"), F.explode(F.array_compact(tags)).alias("item"))
    return out.unionByName(of_tags)
