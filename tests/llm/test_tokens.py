import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabularies")
ODD = ["", None, " ", "  a b", "x ", "a\n\nb c", "x \n y", "x  \n  y\t z", "don't we'll 'LL", "<|endoftext|> a", "日本語のテキスト。次", "🇩🇪 a", "a\x1c b", "!\x1c b", "a　b\xa0c", "a" * 20_000, "ab" * 3000, "é" * 300, "a\r\n\r\n b", "  x", "é ́"]


def reference(texts, name="byte_bpe_50k"):
    made = tokens.tokenizer(tokens.TOKENIZERS, name)
    return [x.ids for x in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts():
    assert tokens.Units(tokens.TOKENIZERS, ()).encode(ODD).to_pylist() == reference(ODD)


def test_random_texts_in_batches():
    rng = random.Random(1)
    own = tokens.Units(tokens.TOKENIZERS, ("byte_bpe_50k", "word_bpe_49k"))
    for _ in range(5):
        texts = ["".join(rng.choice(" \n\t\x1cab.'1é日sS") for _ in range(rng.randrange(30))) for _ in range(1500)]
        sizes = own.measure(texts)
        for name in own.names:
            assert sizes[name].tolist() == [len(x) for x in reference(texts, name)]
        assert tokens.units(tokens.TOKENIZERS, ()).encode(texts).to_pylist() == reference(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=4))
def test_any_text(texts):
    assert tokens.units(tokens.TOKENIZERS, ()).encode(texts).to_pylist() == reference(texts)


def test_walk_against_merges():
    m = tokens.merges(tokens.TOKENIZERS)
    rng = random.Random(2)
    words = [bytes(rng.choice(b" theinglypre") for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    assert all(ids == m.merge(word) for word, ids in m.walk(words))


def test_starting_anew_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", 3)
    own = tokens.Units(tokens.TOKENIZERS, ())
    for texts in (["a b c d e"], ["e f g h"], ["a b"]):
        assert own.encode(texts).to_pylist() == reference(texts)


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b"), (None, "x")], "doc_id bigint, text string").selectExpr("*", "array(1) as ids", "0 as byte_bpe_50k")
    got = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert got[1] == got[4] == reference(["a b"])[0] and got[2] == got[3] == []
    assert tokens.encoded(df.limit(0)).count() == 0
    assert {r.doc_id: r.byte_bpe_50k for r in tokens.measured(df, ("byte_bpe_50k",)).collect()}[2] == 0
