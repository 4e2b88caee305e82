import os
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import packing, tokens

HISTOGRAMS = st.dictionaries(st.integers(0, 40), st.integers(1, 60), min_size=1, max_size=12)


def containers(plan):
    held = defaultdict(list)
    for size, low, high, first, per, items in plan.rows:
        for rank in range(low, high):
            held[first + (rank - low) // per].append((items + (rank - low) % per, size))
    return held


@settings(max_examples=300, deadline=None)
@given(HISTOGRAMS, st.integers(40, 90))
def test_plans(histogram, capacity):
    plan = packing.planned(histogram, capacity)
    held = containers(plan)
    assert Counter(s for xs in held.values() for _, s in xs) == Counter(histogram)
    assert all(sum(s for _, s in xs) <= capacity for xs in held.values())
    assert all(sorted(p for p, _ in xs) == list(range(len(xs))) for xs in held.values())
    assert set(held) <= set(range(plan.containers))
    total = sum(s * n for s, n in histogram.items())
    # Best fit in descending order takes no more than 11/9 of the fewest and 6/9.
    low = max(-(-total // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))
    assert plan.containers <= max(1, low * 11 / 9 * 11 / 9 + 2)


def naive_best_fit(histogram, capacity):
    room = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n) if s), reverse=True):
        fitting = [i for i, r in enumerate(room) if r >= size]
        if fitting:
            room[min(fitting, key=lambda i: room[i])] -= size
        else:
            room.append(capacity - size)
    return max(len(room), 1)


@settings(max_examples=200, deadline=None)
@given(HISTOGRAMS, st.integers(40, 90))
def test_best_fit_counts(histogram, capacity):
    assert packing.best_fit(histogram, capacity) == naive_best_fit(histogram, capacity)
    assert packing.planned(histogram, capacity).containers <= naive_best_fit(histogram, capacity)


def test_many_equal_sizes_make_a_short_plan():
    plan = packing.planned({7: 10**9, 3: 10**9, 0: 10**9}, 10)
    assert plan.containers == 10**9 and len(plan.rows) < 20


def _shape(rows):
    """What doesn't depend on the order in which documents of one size are ranked."""
    assert len({(r.pack_name, r.container, r.place) for r in rows}) == len(rows)
    return Counter((r.pack_name, r.container, r.place, r.n_tokens) for r in rows)


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabularies")
def test_frames(spark):
    texts = [None, "", "a", "a b c", "a b c d e f g", "a b c d e f g h i j k l m n o p q r s t u v w x y z", *["a b"] * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as salt", "2 as piece", "3 as tokens")
    specs = [("small", "byte_bpe_50k", 8), ("large", "word_bpe_49k", 100)]
    got = packing.packed(df, specs).collect()
    assert sorted(map(str, got)) != [] and _shape(packing.packed(df, specs, salts=7).collect()) == _shape(got)
    sizes = {r.doc_id: r.byte_bpe_50k for r in tokens.measured(df, ("byte_bpe_50k",)).collect()}
    for name, capacity in (("small", 8), ("large", 100)):
        own = [r for r in got if r.pack_name == name]
        assert {r.doc_id for r in own} == set(range(len(texts)))
        load = Counter()
        for r in own:
            load[r.container] += r.n_tokens
        assert max(load.values()) <= capacity and len({(r.container, r.place) for r in own}) == len(own)
    small = [r for r in got if r.pack_name == "small"]
    assert sum(r.n_tokens for r in small) == sum(sizes.values())
    assert [(r.piece, r.start, r.n_tokens) for r in sorted(small, key=lambda r: r.piece) if r.doc_id == 5] == [(0, 0, 8), (1, 8, 8), (2, 16, 8), (3, 24, 2)]
    assert all(sum(r.doc_id == i for r in small) == 1 for i in range(5))
    assert packing.packed(df.limit(0), specs).count() == 0
    empty = packing.packed(df.where("doc_id < 2"), specs).collect()
    assert {(r.n_tokens, r.container) for r in empty} == {(0, 0)} and len(empty) == 4


def test_by_cost_as_far_as_it_goes():
    """Large documents go by cost, and only the small ones where they leave the least room."""
    rng = random.Random(5)
    sizes = Counter(min(1024, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(20_000))
    plan = packing.planned(sizes, 1024)
    total = sum(s * n for s, n in sizes.items())
    assert plan.containers == packing.best_fit(sizes, 1024) and plan.by_cost >= 0.5 * total
    assert packing.planned(sizes, 1024, 0.02).by_cost >= plan.by_cost
    costs = [packing.cost(sum(s for _, s in xs)) for xs in containers(plan).values()]
    assert max(costs) <= packing.cost(1024)


def test_every_size_is_ranked_in_parts(spark):
    df = spark.createDataFrame([("p", i, 0, 5) for i in range(500)], "pack_name string, doc_id bigint, piece bigint, n_tokens bigint")
    for salts in (1, 3, 64):
        assert sorted(r["rank"] for r in packing._ranked(df, salts).collect()) == list(range(500))
