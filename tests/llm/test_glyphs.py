import random
import re
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import glyphs


def brute(text):
    """Character by character, with the interpreter's own normaliser."""
    if text is None:
        return None
    resembles = {a: b for x, y in glyphs.LOOKALIKES for a, b in zip(x, y, strict=True)} | {"µ": "μ"}
    out = []
    for ch in text:
        kind, cp = unicodedata.category(ch), ord(ch)
        if ch.isspace() or kind in ("Zs", "Zl", "Zp"):
            out.append(" ")
            continue
        if kind in ("Cf", "Cc") or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp < 0xE01F0:
            continue
        if unicodedata.decomposition(ch).startswith(glyphs.SAME_LOOK) or cp in glyphs.LIGATURES:
            ch = unicodedata.normalize("NFKC", ch)
        out += [resembles.get(x, x) for x in unicodedata.normalize("NFD", ch)]
    return re.sub(" +", " ", unicodedata.normalize("NFC", "".join(out))).strip(" ")


def forms(*texts):
    return glyphs.same_look(pa.array(texts, pa.string())).to_pylist()


def test_examples():
    same = forms("Café №1 – Nord", "Café №1 – Nord", "Ｃａｆé\xa0№１　– Nord", " C​af­é\t№1 – Nоrd ", "Саfé №1 – Nord﻿")
    assert len(set(same)) == 1
    apart = forms("Cafe", "CAFE", "Café", "Cafe²", "Cafe2", "a-b", "a–b", "a—b", "ª", "a")
    assert len(set(apart)) == 10
    assert forms("a‐b", "a‑b", "a-b") == ["a-b"] * 3
    assert forms("が", "が", "ｶﾞ") == ["が", "が", "ガ"]
    assert forms("각", "각", "ﬁn", "fin") == ["각", "각", "fin", "fin"]
    assert forms("q̣̇", "q̣̇")[0] == forms("q̣̇")[0]


def test_nothing_and_blanks():
    assert forms(None, "", " ", "​﻿", "\n\t a \r\n") == [None, "", "", "", "a"]
    assert glyphs.same_look(pa.array([], pa.string())).to_pylist() == []
    assert glyphs.same_look(pa.array([None], pa.string())).to_pylist() == [None]


def test_slices_and_long_texts():
    texts = ["x", "é" * 50_000, None, "Ａ" * 10]
    assert glyphs.same_look(pa.array(texts).slice(1, 3)).to_pylist() == ["é" * 50_000, None, "A" * 10]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=5))
def test_against_brute_force(texts):
    assert forms(*texts) == [brute(x) for x in texts]


def test_marks_against_brute_force():
    rng = random.Random(5)
    signs = "aeoqÅА゙̨̣́̇̈か ‍각가ﬁ½"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(5000)]
    assert forms(*texts) == [brute(x) for x in texts]


def test_groups(spark):
    rows = [("t", 1, "Café"), ("t", 2, "Café"), ("t", 3, "Café"), ("t", 4, "CAFÉ"), ("u", 5, "Café"), ("t", 6, None), ("t", 7, " "), ("t", 8, "​"), ("t", 9, " Café"), ("u", 1, "Café")]
    df = spark.createDataFrame(rows, "field string, id bigint, value string").selectExpr("*", "'x' as form", "0 as low", "1 as n", "2 as first_id", "3 as first")
    assert {tuple(r) for r in glyphs.same_looking(df).collect()} == {("t", 1, 2), ("t", 1, 9), ("u", 1, 5)}
    assert glyphs.same_looking(df.limit(0)).count() == 0
    assert {r.value: r.form for r in glyphs.consistent(df).where("field = 't' and id < 3").collect()} == {"Café": "Café", "Café": "Café"}


@pytest.mark.parametrize("n", [1, 3000])
def test_a_hot_value(spark, n):
    df = spark.range(n).selectExpr("'t' as field", "id", "if(id % 2 = 0, 'a b', 'a　b') as value")
    assert glyphs.same_looking(df).count() == n // 2


def test_values_are_brought_to_their_form_once(spark):
    df = spark.createDataFrame([("t", 1, "a"), ("t", 2, "а")], "field string, id bigint, value string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert plan(glyphs.distinct_forms(df)).count("MapInArrow") == 1 and "MapInArrow" not in plan(glyphs.same_looking(df))


def test_dotless_i_is_seen():
    assert len(set(glyphs.same_look(pa.array(["ısı", "isi"])).to_pylist())) == 2


def test_letters_against_the_public_confusables(spark):
    """The pairs are those of the data that comes with the session's libraries; of the letters that it has for Latin ones
    in these scripts, at least two thirds are in the table."""
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except Exception:
        pytest.skip("no confusables data")
    skeleton = {}
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        skeleton.setdefault(checker.getSkeleton(c), []).append(c)
    known = {}
    for cp in [*range(0x370, 0x590), *range(0x13A0, 0x13F6), *range(0x2C80, 0x2CE4), *range(0x10D0, 0x1100)]:
        c = chr(cp)
        if c.isalpha() and not unicodedata.decomposition(c) and checker.getSkeleton(c) in skeleton:
            known[c] = skeleton[checker.getSkeleton(c)]
    own = {a: b for x, y in glyphs.LOOKALIKES for a, b in zip(x, y, strict=True)}
    assert {a for a, b in own.items() if a in known and b not in known[a]} <= {"\u04cf"}  # a bare stroke, there a dotless i
    assert sum(a in own for a in known) >= 2 / 3 * len(known)
