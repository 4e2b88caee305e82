import json

from spandrel.operators.nested import Element, analyse, children_of_tables, report_children, report_tables, shred


def children(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "report_id bigint, payload string")
    return sorted(tuple(r) for r in report_children(df).collect())


PAGE = {"url": "u", "links": [{"url": "a"}, None, {"url": "b", "extra": {"x": [1]}}], "images": {"src": "s"}, "issues": None, "open_graph": {"og_title": "", "og_type": None, "og_other": "x"}}
ROWS = [("u", "images", 0, "s"), ("u", "links", 0, "a"), ("u", "links", 2, "b"), ("u", "open_graph", 0, "og_title")]


def test_shapes_of_reports(spark):
    report = {"start_url": "s", "pages": [PAGE]}
    shapes = [report, {"pages": {"u": PAGE}}, {"pages": PAGE}, {"report": report}, json.dumps(report), {"wrap": json.dumps(report)}, {"other": {"a": 1}, "report": report}]
    got = children(spark, *map(json.dumps, shapes))
    assert got == sorted((i, *r) for i in range(len(shapes)) for r in ROWS)


def test_any_number_of_wrappers(spark):
    shapes = []
    for wrap in (lambda x: {"report": x}, lambda x: json.dumps(x), lambda x: {"a": 1, "data": json.dumps(x)}):
        value = {"start_url": "http://h/pages/", "pages": [PAGE]}
        for _ in range(6):
            value = wrap(value)
            shapes.append(value if isinstance(value, str) else json.dumps(value))
    assert children(spark, *shapes) == sorted((i, *r) for i in range(len(shapes)) for r in ROWS)


def test_fields_given_twice(spark):
    assert children(spark, '{"a": 1, "a": 2, "pages": [{"url": "u", "url": "v", "links": [{"url": "x"}]}]}') == [(0, "v", "links", 0, "x")]


def test_tables_give_the_same_children(spark):
    page = {**PAGE, "url": None}
    df = spark.createDataFrame([(1, json.dumps({"pages": {"k2": PAGE, "k1": page}})), (2, json.dumps({"pages": [None, PAGE]})), (3, None)], "report_id bigint, payload string")
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(children_of_tables(report_tables(df))) == rows(report_children(df)) and len(rows(report_children(df))) == 12


def test_what_gives_no_rows(spark):
    whole = json.dumps({"pages": [PAGE]})
    assert children(spark, None, "", "  ", "null", "[]", "{}", '{"a": 1}', whole[:-1], whole + "x", whole + whole, '{"pages": null}', '{"pages": []}', '{"pages": [null, 3, "x"]}', "'x'", '"x"') == []


def test_page_keys(spark):
    pages = {"k": {"links": {"url": "a"}}, "k2": {"url": "own", "links": [{"text": "no url"}]}}
    assert children(spark, json.dumps({"pages": pages})) == [(0, "k", "links", 0, "a"), (0, "own", "links", 0, None)]


def test_repeated_reports_and_long_lists(spark):
    page = {"url": "u", "links": [{"url": "x"}] * 5000}
    text = json.dumps({"pages": [page]})
    assert len(children(spark, text, text)) == 10_000


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(7, json.dumps({"pages": [PAGE]}), "c", 1)], "report_id bigint, payload string, child string, idx int")
    assert [r.report_id for r in report_children(df).collect()] == [7] * 4
    assert report_children(df.limit(0)).count() == 0
    tables = report_tables(df.limit(0))
    assert tables["links"].count() == 0 and "open_graph_og_title" in tables["pages"].columns


def test_tables_are_linked(spark):
    df = spark.createDataFrame([(7, json.dumps({"start_url": "s", "summary": {"errors": 2}, "pages": [PAGE, {"url": "v", "h1_tags": ["x", "y"], "status_code": "bad"}]}))], "report_id bigint, payload string")
    t = report_tables(df)
    assert t["report"].first().summary_errors == 2 and t["report"].first().id == "7"
    pages = {r.id: r for r in t["pages"].collect()}
    assert set(pages) == {"7/pages.0", "7/pages.1"} and pages["7/pages.1"].h1_tags == ["x", "y"] and pages["7/pages.1"].status_code is None
    assert pages["7/pages.0"].open_graph_og_title == ""
    assert {(r.id, r.parent_id, r.url) for r in t["links"].collect()} == {("7/pages.0/links.0", "7/pages.0", "a"), ("7/pages.0/links.2", "7/pages.0", "b")}


def test_shared_inlining():
    leaf = Element("leaf", {"x": "int"})
    shared = Element("shared", {"y": "int"})
    root = Element("root", {"a": "string"}, {"one": leaf, "p": shared, "q": shared, "list": Element("item", {"z": "int"}, {"one": Element("inner", {"w": "int"})})}, frozenset({"list"}))
    tables = analyse(root)
    assert set(tables) == {"root", "shared", "item"}
    assert [c[0] for c in tables["root"].columns] == ["a", "one_x"] and [c[0] for c in tables["item"].columns] == ["z", "one_w"]


def test_recursive_elements(spark):
    node = Element("node", {"name": "string"})
    node.children = {"children": node}
    node.many = frozenset({"children"})
    tree = {"name": "r", "children": [{"name": "a", "children": [{"name": "b"}]}, {"name": "c"}]}
    df = spark.createDataFrame([("t", json.dumps(tree))], "id string, text string")
    got = {(r.id, r.parent_id, r.name) for r in shred(df, "id", "text", node)["node"].collect()}
    assert got == {("t", None, "r"), ("t/children.0", "t", "a"), ("t/children.1", "t", "c"), ("t/children.0/children.0", "t/children.0", "b")}
