from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.functions.urls import parse as parse_url
from spandrel.operators import robots
from spandrel.operators.robots import Rule


PATHS = ["/" + "".join(x) for n in range(5) for x in product("ab/", repeat=n)]
FILLERS = ["".join(x) for n in range(5) for x in product("ab/", repeat=n)]


def admitted(pattern):
    """The paths of PATHS that a pattern is for, told from what it stands for and not by walking along it.

    Without an anchor these are all that begin with the pattern, whatever stands in the place of its stars. With one and
    no star it is the pattern alone; with both, a quirk, only what stands before stars at the very end.
    """
    body = pattern.removesuffix("$")
    if body == pattern:
        pieces = body.split("*")
        begins = {pieces[0]}
        for piece in pieces[1:]:
            begins = {b + f + piece for b in begins for f in FILLERS if len(b + f + piece) <= 5}
        return {p for p in PATHS if p.startswith(tuple(begins)) or p == pattern}
    return {p for p in PATHS if p == pattern or p == body.rstrip("*")}


@pytest.mark.parametrize("pattern", ["/", "/a", "/ab/", "/a*", "/*b", "/a*b", "/*/a", "/a**b", "/*a*", "/b$", "/$", "/ab*$", "/a**$", "/*b$", "/a*/$"])
def test_patterns(pattern, spark):
    from pyspark.sql import functions as F

    assert {p for p in PATHS if robots.matches(pattern, p)} == admitted(pattern)
    got = spark.createDataFrame([(p,) for p in PATHS], "u string").where(robots.matched(F.lit(pattern), F.col("u")))
    assert {r.u for r in got.collect()} == admitted(pattern)


@pytest.mark.parametrize(("pattern", "path", "expected"), [("/a\\E(x", "/a\\E(x/y", True), ("/a\\E.*z", "/aqqz", False), ("/a\\E*z", "/a\\Eqqz", True), ("/[x]+*{2}", "/[x]+--{2}", True), ("/é*ß", "/éaß", True), ("/a.*c", "/abxc", False)])
def test_signs_are_taken_literally(pattern, path, expected, spark):
    from pyspark.sql import functions as F

    assert robots.matches(pattern, path) is expected
    assert spark.createDataFrame([(pattern, path)], "p string, u string").select(robots.matched(F.col("p"), F.col("u"))).first()[0] is expected


def test_strict_matches_the_end():
    assert robots.matches("/*.php$", "/a.php", strict=True)
    assert not robots.matches("/*.php$", "/a.phpx", strict=True)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="/ab*", max_size=4), st.booleans())
def test_any_pattern_admits_what_it_stands_for(body, end):
    pattern = "/" + body + ("$" if end else "")
    assert {p for p in PATHS if robots.matches(pattern, p)} == admitted(pattern)


def test_texts_are_parsed_where_they_are(spark):
    df = spark.createDataFrame([("http://h", "User-agent: A\nDisallow: /x"), ("http://i", None), ("http://j", "")], "domain string, text string")
    assert [tuple(r) for r in robots.parsed(df).collect()] == [("http://h", "a", 0, "/x", False)]
    assert robots.parsed(df.limit(0)).count() == 0


def test_parse_groups():
    text = "# c\nUser-agent: A\nUser-agent: b\nDisallow: /x # kept\nnonsense\nSitemap: http://h/s.xml\nUser-agent: *\nDisallow:\nUser-agent: c\nAllow: /y\r\nDisallow: /\n"
    got = robots.parse(text)
    assert got["a"] == got["b"] == [Rule("/x # kept", False)]
    assert got["*"] == got["c"] == [Rule("/y", True), Rule("/", False)]  # the empty group runs on


def test_later_group_replaces():
    assert robots.parse("User-agent: *\nDisallow: /a\nUser-agent: *\nDisallow: /b")["*"] == [Rule("/b", False)]


def test_longest_then_last_wins():
    rules = [Rule("/p", False), Rule("/page", True), Rule("/pag*", False)]
    assert robots.allowed(rules, "/page") is False
    assert robots.allowed(rules, "/pa") is False
    assert robots.allowed([], "/x") is True


def test_own_group_replaces_star_and_query_is_ignored():
    groups = robots.parse("User-agent: *\nDisallow: /\nUser-agent: spandrel\nDisallow: /q?x=1")
    assert robots.is_allowed(groups, parse_url("http://h/q?x=1"))
    assert not robots.is_allowed({"*": groups["*"]}, parse_url("http://h/q"))


def test_decide(spark):
    rules = spark.createDataFrame([("http://h", "*", 0, "/a", False), ("http://h", "*", 1, "/a/b", True), ("http://h", "Bot", 0, "/c", False), ("http://h:81", "*", 0, "/", False)], robots.SCHEMA)
    urls = spark.createDataFrame([("http://h/a/x",), ("http://h/a/b/c",), ("http://h:80/c",), ("https://h/a/x",), ("http://h:81/",), (None,), ("mailto:x",)], "url string")
    star = {r.url: r.allowed for r in robots.decide(urls, rules, "other").collect()}
    assert star == {"http://h/a/x": False, "http://h/a/b/c": True, "http://h:80/c": True, "https://h/a/x": True, "http://h:81/": False, None: True, "mailto:x": True}
    own = {r.url: r.allowed for r in robots.decide(urls, rules, "bot").collect()}
    assert own["http://h:80/c"] is False and own["http://h/a/x"] is True
    assert robots.decide(urls, rules.limit(0)).where("allowed").count() == 7
    assert robots.rows("d", "User-agent: *\nAllow: /x") == [("d", "*", 0, "/x", True)]
