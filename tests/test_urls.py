import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spandrel.functions import urls

BASE = "http://H.com:80/a/b/c.html?q#f"


@pytest.mark.parametrize(
    ("reference", "expected"),
    [
        ("x", "http://h.com/a/b/x"),
        ("../y", "http://h.com/a/y"),
        ("/für", "http://h.com/f%C3%BCr"),
        ("a b", "http://h.com/a/b/a%20b"),
        ("//Other.com", "http://other.com/"),
        ("?z=1", "http://h.com/a/b/c.html?z=1"),
        ("#top", "http://h.com/a/b/c.html?q#top"),
        ("", "http://h.com/a/b/c.html?q"),
        ("HTTP://b.com", "http://b.com/"),
        ("mailto:a@b", "mailto:a@b"),
        ("tel:+1", "tel:+1"),
        ("javascript:void(0)", "javascript:void(0)"),
        ("./.././..//k", "http://h.com//k"),
        ("\\\\x\\y", "http://x/y"),
        ("https://h:443/%2e%2E/x", "https://h/x"),
        ("http://[::1]:8080/", "http://[::1]:8080/"),
        ("http://1.2.3/", "http://1.2.0.3/"),
        ("ht\ntp://h.com/\tz", "http://h.com/z"),
        ("http://", None),
        ("http://a b/", None),
        ("http://h:99999/", None),
    ],
)
def test_join(reference, expected):
    assert urls.join(BASE, reference) == expected


def test_opaque_base_takes_only_fragments():
    assert urls.join("mailto:a@b", "#x") == "mailto:a@b#x"
    assert urls.join("mailto:a@b", "x") is None


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=25))
def test_serialised_addresses_are_stable(text):
    first = urls.join("https://site.example/dir/page?x=1", text)
    if first is not None:
        assert str(urls.parse(first)) == first


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc/.%2eE?#=&:@~-_ 1", max_size=20))
def test_fast_path_agrees(text):
    whole = f"https://site.example/{text}"
    fast = urls.try_parse(whole)
    slow = urls.try_parse(" " + whole)
    assert fast == slow


def test_external_ignores_scheme_but_not_port_or_subdomain():
    base = urls.parse("http://h.com")
    assert not urls.is_external(urls.parse("https://h.com/x"), base)
    assert urls.is_external(urls.parse("http://h.com:8080/x"), base)
    assert urls.is_external(urls.parse("http://www.h.com/"), base)
    assert urls.is_external(urls.parse("mailto:a@h.com"), base)


def test_crawlable_and_endings():
    assert urls.is_crawlable("https://h/a.html")
    assert urls.is_crawlable("https://h/")
    assert not urls.is_crawlable("https://h/pic.JPG?x=1")
    assert not urls.is_crawlable("https://h/dir/doc.pdf/")
    assert not urls.is_crawlable("mailto:x@y")
    assert not urls.is_crawlable("not an address")
    assert len(urls.NON_PAGE_ENDINGS) == 52


def test_seed_and_scan_checks():
    assert urls.checked_seed("https://h").origin == "https://h"
    with pytest.raises(ValueError, match="Invalid URL scheme 'ftp': only http and https are supported"):
        urls.checked_seed("ftp://h")
    with pytest.raises(ValueError, match="Invalid URL"):
        urls.checked_seed("nonsense")
    assert urls.is_scan_url("http://x")
    assert not urls.is_scan_url("HTTP://x")


def test_robots_key_and_url():
    assert urls.parse("https://h:443/x").origin == "https://h"
    assert urls.parse("https://h:8443/x").origin == "https://h:8443"
    assert urls.robots_url(urls.parse("https://h:8443/x?y#z")) == "https://h:8443/robots.txt"


def test_normalize_cuts_at_the_first_hash_only():
    assert urls.normalize("HTTP://H/?a#b#c") == "HTTP://H/?a"
    assert urls.normalize("http://h/#x", keep_fragments=True) == "http://h/#x"


def test_columns_agree_with_the_parser(spark):
    rows = ["https://h.com/a/b.PDF?x#y", "http://h.com:8080/", "http://h.com:80/x/", "mailto:a@b", "https://h.com", "https://u@h.com/é/", None, ""]
    u = F.col("u")
    got = spark.createDataFrame([(x,) for x in rows], "u string").select("u", urls.scheme_of(u).alias("s"), urls.host_of(u).alias("h"), urls.port_of(u).alias("p"), urls.ending_of(u).alias("e"), urls.crawlable(u).alias("c"), urls.origin_of(u).alias("o")).collect()
    for r in got:
        parsed = urls.try_parse(r.u) if r.u else None
        if parsed:
            assert (r.s, r.h, r.p, r.e) == (parsed.scheme, parsed.host, parsed.port, urls.ending(parsed))
            assert r.c == urls.is_crawlable(r.u)
            if parsed.host:
                assert r.o == parsed.origin
        else:
            assert (r.s, r.h, r.p, r.e, r.c) == (None, None, None, None, False)


def test_redirects_ignore_fragments(spark):
    df = spark.createDataFrame([("http://h/a#x", "http://h/a"), ("http://h/a", "http://h/b"), ("http://h/a", None)], "u string, f string")
    assert [r[0] for r in df.select(urls.redirected(F.col("u"), F.col("f"))).collect()] == [None, "http://h/b", None]


def test_a_port_out_of_range_is_no_error(spark):
    assert spark.createDataFrame([("http://h.com:99999999999/",)], "u string").select(urls.port_of(F.col("u"))).first()[0] is None
