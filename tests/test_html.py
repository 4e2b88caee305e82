from pyspark.sql import functions as F

from spandrel.functions.html import attributes, extract
from spandrel.functions.urls import parse
from spandrel.operators.extract import extracted, images_of, links_of

BASE = parse("http://h/")


def pull(source, url="http://h/dir/page"):
    return extract(source, url, BASE)


def test_titles():
    assert pull("<title> a &amp; <b>x</b> </title>")["title"] == "a & <b>x</b>"
    assert pull("<title></title><title>b</title>")["title"] == ""
    assert pull("<p>x")["title"] is None
    assert pull("<title>open to the end")["title"] == "open to the end"
    assert pull("<svg></svg><body><TITLE>late</TITLE>")["title"] == "late"


def test_description_is_the_first_and_untrimmed():
    assert pull('<meta name="description" content=" a "><meta name=description content=b>')["meta_description"] == " a "
    assert pull('<meta name="description"><meta name="description" content="b">')["meta_description"] is None


def test_headings():
    got = pull("<h1> a <i>b</i><!-- no --><script>c</script></h1><h1></h1><h1>open")
    assert got["h1_tags"] == ["a bc", "", "open"]
    assert pull("<h1>a<h2>b</h2>c")["h1_tags"] == ["a"]


def test_open_graph():
    got = pull('<meta property="og:title" content=""><meta property="og:title" content="x"><meta property="og:site_name" content="s"><meta property="og:image">')["open_graph"]
    assert got["og_title"] == "" and got["og_site_name"] == "s" and got["og_image"] is None and got["og_locale"] is None


def test_links_in_document_order():
    got = pull(
        """<a href="x">  A <b>b</b> </a><iframe src="//o/f" title="T"><a href="no"></a></iframe><video src=v.mp4><source src=s.webm type=video/webm></video>
        <audio src=a></audio><embed src=e><object data=d></object><a>none</a><a href="http://">bad</a><a href="mailto:q@r">m</a><a href="x">A</a><textarea><a href=t></textarea>"""
    )["links"]
    assert [(x["url"], x["text"], x["is_external"]) for x in got] == [
        ("http://h/dir/x", "A b", False),
        ("http://o/f", "[iframe] T", True),
        ("http://h/dir/v.mp4", "[video]", False),
        ("http://h/dir/s.webm", "[source type=video/webm]", False),
        ("http://h/dir/a", "[audio]", False),
        ("http://h/dir/e", "[embed]", False),
        ("http://h/dir/d", "[object]", False),
        ("mailto:q@r", "m", True),
        ("http://h/dir/x", "A", False),
    ]


def test_nested_anchor_closes_the_open_one():
    assert [x["text"] for x in pull("<a href=1>one<a href=2>two</a> x")["links"]] == ["one", "two"]


def test_images_keep_the_difference_of_no_and_empty_alt():
    got = pull("<img src=a><img src=b alt><img src=c alt='x'><img alt=z>")["images"]
    assert [(x["src"], x["alt"]) for x in got] == [("http://h/dir/a", None), ("http://h/dir/b", ""), ("http://h/dir/c", "x")]


def test_attributes():
    assert attributes(' A="1" a=2 b=\'x>y\' c d = e href="?a=1&copy=2&amp;b"') == {"a": "1", "b": "x>y", "c": "", "d": "e", "href": "?a=1&copy=2&b"}


def test_broken_markup_takes_linear_time():
    assert pull("<a " + "=\"'" * 50_000)["links"] == []
    assert pull("<" * 100_000)["links"] == []
    assert len(pull("<a href=x>" * 2000)["links"]) == 2000


def test_extracted(spark):
    rows = [("http://h/a", None, "<title>t</title><a href=b>x</a><img src=i>"), ("http://h/b", "image/png", "<title>t</title>"), ("http://h/c", "text/html", None), ("bad", "text/html", "<title>t</title>"), ("http://h/d", "application/xhtml+xml", "")]
    got = extracted(spark.createDataFrame(rows, "url string, content_type string, body string").withColumn("title", F.lit("clash")).withColumn("page_key", F.col("url")), "http://h")
    by = {r.url: r for r in got.collect()}
    assert by["http://h/a"].title == "t" and by["http://h/b"].title is None and by["bad"].title is None and by["http://h/d"].links == []
    assert [tuple(r)[:3] for r in links_of(got).collect()] == [("http://h/a", 0, "http://h/b")]
    assert images_of(got).first().alt is None
    assert extracted(spark.createDataFrame([], "url string, content_type string, body string")).count() == 0
