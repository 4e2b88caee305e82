import random

import numpy as np
import pytest

from spandrel.llm import reading

LEVELS = {"basic": "cat dog bus cup hat pen", "plain": "garden market letter kitchen harbour village", "skilled": "maintenance visibility hierarchy inspection repository integration", "scholarly": "commensurability epistemology systematisation intermediation proportionality indeterminacy"}


def write(rng, band, n):
    words = LEVELS[band].split()
    return " ".join(f"the {rng.choice(words)} of our {rng.choice(words)} is a {rng.choice(words)}" for _ in range(n // 8 + 1)) + "."


@pytest.fixture
def graded(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(write(rng, b, 80), b) for b in LEVELS for _ in range(15)], "text string, band string")


def test_bands_and_what_is_left_out(spark, graded):
    rng = random.Random(4)
    rows = [(i, write(rng, b, 60)) for i, b in enumerate([*LEVELS] * 5)]
    special = {
        100: None,
        101: "",
        102: write(rng, "basic", 20),
        103: "Die alten Hügel wärmen rötliche Öfen für Geübte und schließen " * 10,
        104: "2025-09-06T08:14:57Z INFO GET https://h/x 200 98ms\n" * 30,
        105: "Home | Guides | Contact\n\nQuiet boats\n\n" + write(rng, "skilled", 120) + " don't we'll x_y 🎉",
        106: write(rng, "scholarly", 60_000),
    }
    df = spark.createDataFrame([*rows, *special.items(), rows[0]], "doc_id bigint, text string").selectExpr("*", "0 as level", "'x' as band")
    got = {}
    for r in reading.graded_levels(df, graded).collect():
        got[r.doc_id] = r.band
    assert {i: got.pop(i) for i, _ in rows} == {i: b for i, b in enumerate([*LEVELS] * 5)}
    assert got == {105: "skilled", 106: "scholarly"}
    assert reading.graded_levels(df, graded).count() == len(rows) + 3  # a repeated row is a row


def test_held_out_accuracy(spark, graded):
    held = graded.limit(60).selectExpr("monotonically_increasing_id() as doc_id", "text", "band as truth")
    got = reading.graded_levels(held, graded.sample(0.5, 1)).join(held.select("doc_id", "truth"), "doc_id").collect()
    assert len(got) > 50 and sum(r.band == r.truth for r in got) >= 0.95 * len(got)


def test_words_met_only_in_documents_get_a_difficulty(spark, graded):
    rng = random.Random(6)
    mixed = [(i, write(rng, "scholarly", 60) + " zymurgical" * 10) for i in range(30)]
    df = spark.createDataFrame(mixed, "doc_id bigint, text string")
    samples = reading.Samples([r.text for r in graded.collect()], [r.band for r in graded.collect()], reading.BANDS)
    first = samples.model(samples.responses())
    heard, owner = reading._heard(df, first)
    second = samples.model(heard + samples.responses(), first, owner)
    word = reading.hash_of("zymurgical")
    at = word & (reading.SLOTS - 1)
    assert first.weight[at] == 0 and owner[at] == word
    assert second.weight[at] > 0.2 and second.difficulty[at] > second.cuts[-1]


def test_alternation_grades_what_the_samples_alone_cannot(spark):
    """Half of each band's words stand in no sample: only documents that have some of both halves tell their level."""
    rng = random.Random(8)
    known = {b: ws.split()[:2] for b, ws in LEVELS.items()}
    fresh = {b: [f"{b}{x}" for x in "qwrtzpsdfghjkl"] for b in LEVELS}
    glue = "the of our is a".split()
    text = lambda words: " ".join(f"{rng.choice(glue)} {rng.choice(words)}" for _ in range(40))
    graded = spark.createDataFrame([(text([*known[b], *glue * 3]), b) for b in LEVELS for _ in range(12)], "text string, band string")
    rows, truth = [], {}
    for i in range(400):
        b = [*LEVELS][i % 4]
        # Some have words of the samples beside new ones, some nearly none: of these only neighbours of new words tell.
        share = 6 if i % 3 else 1
        words = [*known[b] * share, *fresh[b], *glue * 6]
        rows.append((i, text(words) + " " + " ".join(rng.choices(glue, k=30))))
        truth[i] = b
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    right = {}
    for rounds in (0, reading.MAX_ROUNDS):
        got = reading.graded_levels(df, graded, rounds=rounds).collect()
        assert len(got) >= 390
        right[rounds] = sum(r.band == truth[r.doc_id] for r in got) / len(got)
    assert got[0].rounds < reading.MAX_ROUNDS and got[0].changed <= reading.SETTLED_BANDS and got[0].moved <= reading.SETTLED_LEVELS
    assert right[reading.MAX_ROUNDS] > right[0] and right[reading.MAX_ROUNDS] >= 0.95


def test_words_that_share_a_slot_stay_apart(spark, graded):
    samples = reading.Samples([r.text for r in graded.collect()], [r.band for r in graded.collect()], reading.BANDS)
    model = samples.model(samples.responses())
    cat = reading.hash_of("cat")
    assert model.slots(np.array([cat, cat ^ (1 << 40)])).tolist() == [cat & (reading.SLOTS - 1), reading.NONE]
    assert reading.unheard(spark.createDataFrame([(1, write(random.Random(1), "basic", 80))], "doc_id bigint, text string"), graded) < 0.01


def test_levels_are_the_likeliest(spark, graded):
    samples = reading.Samples([r.text for r in graded.collect()], [r.band for r in graded.collect()], reading.BANDS)
    m = samples.model(samples.responses())
    slots = m.slots(np.array([reading.hash_of(w) for w in "the cat of our garden is a maintenance cat".split()]))
    level = m.levels(slots, np.array([len(slots)]))[0]
    said, weight = m.said[slots], m.weight[slots]
    likely = lambda x: (weight[:, None] * ((p := 1 / (1 + np.exp(-(m.difficulty[slots][:, None] - m.steps)))) * np.log(1 / (1 + np.exp(-(x - m.steps)))) + (1 - p) * np.log(1 / (1 + np.exp(x - m.steps))))).sum()
    assert all(likely(level) >= likely(level + d) for d in (-0.5, -0.05, 0.05, 0.5)) and len(said) == 9


def test_empty_tables(spark, graded):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert reading.graded_levels(none, graded).count() == 0
    assert reading.graded_levels(none, graded.limit(0)).count() == 0


def test_counts_of_parts():
    words, ends, count = reading.Words().of(["a b　c\xa0d", None, "", "  ", "x-y z"])
    assert count.tolist() == [4, 0, 0, 0, 2] and ends.tolist() == [4, 4, 4, 4, 7] and len(words) == 7
