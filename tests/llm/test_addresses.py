import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm.addresses import _survivors, canonical_address, collapse_addresses, repeated_addresses, with_built_in

PLAIN = "https://h.example/a/caf%C3%A9/x-1?id=1&q=old%20town"
SPELLINGS = [
    "HTTPS://H.Example/a/caf%C3%A9/x-1?id=1&q=old%20town",
    " https://h.example/a/caf%c3%a9/x-1?q=old+town&id=1\n",
    "https://h.example:443/a/café/x-1?id=1&q=old town",
    "https://h.example./a//./caf%C3%A9/x-1/?id=1&&q=old%20town&#top",
    "https://h.example.:443/b/../a/%63af%C3%A9/%78%2D1?&id=%31&q=old+town#/tab?x=1",
    "ht\ntps://h.exam\tple/a/caf%C3%A9/\r\nx-1?id=1&q=old%20town#",
]
OTHERS = [
    "http://h.example/a/caf%C3%A9/x-1?id=1&q=old%20town",
    "https://www.h.example/a/caf%C3%A9/x-1?id=1&q=old%20town",
    "https://h.example/A/caf%C3%A9/x-1?id=1&q=old%20town",
    "https://h.example/a/caf%C3%A9/x-1.html?id=1&q=old%20town",
    "https://h.example/a/caf%C3%A9/x-1?id=2&q=old%20town",
    "https://h.example/a/caf%C3%A9/x-1?id=1&q=Old%20town",
    "https://h.example/a/caf%C3%A9/x-1?id=1&id=1&q=old%20town",
    "https://h.example:8443/a/caf%C3%A9/x-1?id=1&q=old%20town",
    "https://h.example/a/caf%C3%A9/x-1?id=1&q=old%2Btown",
    "https://h.example/a%2Fcaf%C3%A9/x-1?id=1&q=old%20town",
]


@pytest.mark.parametrize("spelling", SPELLINGS)
def test_same(spelling):
    assert canonical_address(spelling) == canonical_address(PLAIN) == PLAIN


@pytest.mark.parametrize("other", OTHERS)
def test_different(other):
    assert canonical_address(other) != PLAIN


@pytest.mark.parametrize("text", [None, "", " ", "mailto:a@b", "tel:1", "javascript:void(0)", "ftp://h/x", "/relative", "https:", "https://", "http:///x", "https://."])
def test_no_cases(text):
    assert canonical_address(text) is None


def test_root_spellings():
    assert {canonical_address(x) for x in ("http://h", "http://h/", "http://h:80", "http://h//", "http://h/?", "http://h/..", "http://h?#x")} == {"http://h/"}


def test_odd_escapes_stay_apart():
    assert len({canonical_address(x) for x in ("http://h/%FF", "http://h/%FE", "http://h/%", "http://h/%3F", "http://h/x?a=%26", "http://h/x?a&=")}) == 6


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB/.%2eé?=&+ #~;:@\t", max_size=30))
def test_canonical_text_is_stable(text):
    once = canonical_address("http://h.example/" + text)
    assert canonical_address(once) == once


def rows(spark, *urls, kind="pages"):
    return spark.createDataFrame([(kind, i, u) for i, u in enumerate(urls)], "kind string, id bigint, url string")


def test_found_and_counts(spark):
    df = rows(spark, None, "", PLAIN, OTHERS[0], *SPELLINGS, PLAIN, "mailto:x", "mailto:x").unionByName(rows(spark, PLAIN, SPELLINGS[0], kind="links"))
    got = {tuple(r) for r in repeated_addresses(df).collect()}
    assert got == {("pages", 2, i) for i in range(4, 11)} | {("links", 0, 1)}
    assert {(r.kind, r.address, r.first_id, r.n) for r in collapse_addresses(df).collect()} == {("pages", PLAIN, 2, 8), ("pages", OTHERS[0], 3, 1), ("links", PLAIN, 0, 2)}


def test_hot_address_long_address_empty_table_and_clashes(spark):
    hot = rows(spark, *[f"http://h/x#{i % 50}" for i in range(3000)], "http://h/" + "y" * 100_000)
    assert repeated_addresses(hot).count() == 2999
    clash = hot.selectExpr("*", "1 as n", "'z' as address", "2 as first_id", "3 as low")
    assert repeated_addresses(clash).columns == ["kind", "first_id", "copy_id"] and repeated_addresses(clash).count() == 2999
    assert repeated_addresses(hot.limit(0)).count() == 0 and collapse_addresses(hot.limit(0)).count() == 0


ODD = ["http://h/%FF", "http://h/%", "http://u@h/", "http://[::1]/", "http://h%2Eexample/", "http://h/%EF%BF%BD", "http://h:x/", "http://h/?a=%", "http://h/\u2028x ", "\x1chttp://h/a*b~c/%7E%2a", "http://h/a+b?c+d=e+f&&=&x", "HTTP://H:080./", "http://h/a/../../b/./%2e%2E/c"]


def test_built_in_expressions_agree(spark):
    texts = [PLAIN, *SPELLINGS, *OTHERS, *ODD]
    rows = with_built_in(spark.createDataFrame([(x,) for x in texts], "url string")).withColumnRenamed("easy", "b").collect()
    assert all(r.b is None or r.b == canonical_address(r.url) for r in rows)
    assert sum(r.b is not None for r in rows) >= len(texts) - 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="hH:/.?#&=%+ *~aé2eE", max_size=25), min_size=20, max_size=40))
def test_built_in_expressions_agree_on_anything(spark, tails):
    texts = [f"http://h{x}" for x in tails]
    rows = with_built_in(spark.createDataFrame([(x,) for x in texts], "url string")).withColumnRenamed("easy", "b").collect()
    assert [r for r in rows if r.b is not None and r.b != canonical_address(r.url)] == []


def test_addresses_are_canonicalised_once(spark):
    df = spark.createDataFrame([("pages", 1, PLAIN), ("pages", 2, PLAIN + "#x")], "kind string, id bigint, url string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert plan(_survivors(df)).count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in plan(repeated_addresses(df))
