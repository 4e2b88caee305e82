from pyspark.sql import functions as F

from spandrel.functions import text


def run(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


def test_trim_takes_all_white_space(spark):
    assert run(spark, "  \t　a b \n", text.trimmed) == "a b"
    assert run(spark, "a\x0b\x0c", text.trimmed) == "a"
    assert run(spark, None, text.trimmed) is None
    assert run(spark, "​", text.trimmed) == "​"


def test_blank(spark):
    assert [run(spark, x, text.is_blank) for x in (None, "", " 　", "x")] == [True, True, True, False]


def test_lengths_are_bytes(spark):
    assert run(spark, "für", text.byte_length) == 4


def test_contains_takes_percent_literally(spark):
    assert run(spark, "A 100% B", lambda c: text.contains_folded(c, F.lit("0% b")))
    assert not run(spark, "A 100 B", lambda c: text.contains_folded(c, F.lit("%")))


def test_shortening(spark):
    assert run(spark, "abcdef", lambda c: text.shortened(c, 6)) == "abcdef"
    assert run(spark, "abcdefg", lambda c: text.shortened(c, 6)) == "abcde…"
    assert run(spark, "éééé", lambda c: text.shortened(c, 3)) == "éé…"
    assert run(spark, "abcdefg", lambda c: text.shortened_left(c, 4)) == "…efg"
    assert run(spark, "abc", lambda c: text.shortened_left(c, 0)) == ""
    assert run(spark, "abc", lambda c: text.shortened_left(c, 1)) == "…"


def test_duration(spark):
    assert [run(spark, x, text.duration, "bigint") for x in (0, 61, 3599, 3600, 360000)] == ["00:00", "01:01", "59:59", "01:00:00", "100:00:00"]


def test_display_title(spark):
    df = spark.createDataFrame([(" A ", "http://h/x", "text/html"), (None, "http://h/media/v.mp4", "video/mp4"), ("", "http://h/", None), (None, "http://h/", "video/mp4")], "t string, u string, k string")
    assert [r[0] for r in df.select(text.display_title(F.col("t"), F.col("u"), F.col("k"))).collect()] == ["A", "v.mp4", "(untitled)", "(untitled)"]


def test_html_gate(spark):
    assert [run(spark, x, text.is_html) for x in (None, "TEXT/HTML; x", "application/xhtml+xml", "image/png")] == [True, True, True, False]
