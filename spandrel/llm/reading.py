"""Reading level of English prose, on the scale of graded samples.

A rating-scale Rasch model: the levels are divided by steps, and the odds that a document in which a word occurs lies
above step k are exp(difficulty of the word - step k). A document's level is the maximum of that likelihood: where the
expected number of steps passed equals the mean over its words, so that levels and difficulties lie on one scale. Both
are estimated in turns: difficulties and steps from graded samples (whose levels are given) and from all documents (at
their levels so far), summed up where the documents are; then levels from these; until neither bands nor levels move.
Words count by how well their documents agree, so that words of all levels, headings, menus and inserted fragments
hardly weigh.

A word is known by 64 bits of its hash: the lower ones are its slot of SLOTS, the others must be equal. So what is
broadcast and gathered has a fixed size, however large the corpus is, and no word is taken for another. Of words that
share a slot the samples' has it, else the most frequent; the others weigh nothing (see ``unheard``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.batches import Growing, slices
from spandrel.tables import written

SLOTS = 1 << 18
#: The slot of words that have none.
NONE = SLOTS
BANDS = ("basic", "plain", "skilled", "scholarly")
#: Least number of parts between white space, share of known words and share of function words of English prose.
MIN_WORDS, MIN_KNOWN, MIN_FUNCTION = 50, 0.5, 0.12
#: Share of the samples of each band that have a word, for it to be a function word.
FUNCTION_SHARE = 0.2
#: Neutral responses that each word's difficulty starts with.
PRIOR = 0.5
#: How sharply a document's level tells on which side of a step it lies.
SHARPNESS = 3.0
#: The alternation ends when fewer documents change their band, and levels move less in the mean, or after so many rounds.
SETTLED_BANDS, SETTLED_LEVELS, MAX_ROUNDS = 0.0005, 0.02, 20
#: Words that a worker sums up before it hands them on.
SUMMED_AT_ONCE = 300_000
#: The most graded samples that are fitted; more than that are an error, not cut off.
MAX_SAMPLES = 100_000
KEPT_UNITS = 500_000
_WORD = re.compile(r"[^\W\d_]+")


def hash_of(word: str) -> int:
    """The 64 bits by which a word is known, as a signed number."""
    return (xxhash.xxh64_intdigest(word.encode("utf-8")) ^ (1 << 63)) - (1 << 63)


class _Parts(dict):
    """Numbers the parts between white space, and keeps the hashes of their words."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[list[int]] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self.hashes)
        self.hashes.append([hash_of(w) for w in _WORD.findall(part.lower())])
        return number


class Words:
    """The words of whole texts as hashes, each distinct part being looked at once a worker."""

    def __init__(self) -> None:
        self.parts = _Parts()
        self.done = 0
        self.length, self.start, self.pool = Growing(np.int64), Growing(np.int64), Growing(np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' hashes, where each text's end, and each text's number of parts."""
        if len(self.parts.hashes) > KEPT_UNITS:
            self.__init__()
        numbers: list[int] = []
        count = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = text.split()
                count[i] = len(own)
                numbers += map(self.parts.__getitem__, own)
        fresh = self.parts.hashes[self.done :]
        self.done = len(self.parts.hashes)
        length = np.array([len(x) for x in fresh], np.int64)
        self.start.extend(len(self.pool) + np.cumsum(length) - length)
        self.length.extend(length)
        self.pool.extend(np.array([b for x in fresh for b in x], np.int64))
        units = np.array(numbers, np.int64)
        length = self.length[units]
        tail = np.cumsum(length)
        words = self.pool[np.repeat(self.start[units] - (tail - length), length) + np.arange(tail[-1] if len(tail) else 0)]
        ends = np.concatenate([[0], tail])[np.cumsum(count)]
        return words, ends, count


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[ends], prepend=0.0)


_GRID = np.linspace(-14, 14, 2801)


def passed(levels: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The expected number of steps passed at each level."""
    return (1 / (1 + np.exp(-(levels[:, None] - steps[None, :])))).sum(1)


@dataclass
class Model:
    """By slot, and last for words without one: the hash of its word, difficulty, weight, whether the samples have the
    word and it is a function word; steps, and cuts on the levels."""

    owner: np.ndarray
    difficulty: np.ndarray
    weight: np.ndarray
    known: np.ndarray
    function: np.ndarray
    steps: np.ndarray
    cuts: np.ndarray

    @functools.cached_property
    def said(self) -> np.ndarray:
        """By slot, the number of steps that its word says are passed."""
        return passed(self.difficulty.astype(np.float64), self.steps)

    @functools.cached_property
    def grid(self) -> np.ndarray:
        return passed(_GRID, self.steps)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (SLOTS - 1)
        return np.where(self.owner[at] == hashes, at, NONE).astype(np.int32)

    def levels(self, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The likeliest level of each text: the one at which as many steps are passed as its words say. Without any word
        that weighs, the middle."""
        said, weight = self.said, self.weight[slots]
        total = _sums(weight, ends)
        mean = np.where(total > 0, _sums(weight * said[slots], ends) / np.where(total > 0, total, 1.0), len(self.steps) / 2)
        return np.interp(mean, self.grid, _GRID)

    def prose(self, slots: np.ndarray, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(ends, prepend=0), 1)
        return (count >= MIN_WORDS) & (_sums(self.known[slots], ends) >= MIN_KNOWN * n) & (_sums(self.function[slots], ends) >= MIN_FUNCTION * n)

    def bands(self, levels: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, levels)

    def above(self, levels: np.ndarray) -> np.ndarray:
        """For each level and step, the probability to lie above it."""
        return 1 / (1 + np.exp(-np.clip(SHARPNESS * (levels[:, None] - self.cuts[None, :]), -30, 30)))


class Responses:
    """Sums of responses by slot: their number, those above each step, and squares of the number of steps passed."""

    def __init__(self, steps: int) -> None:
        self.n = np.zeros(SLOTS + 1)
        self.above = np.zeros((steps, SLOTS + 1))
        self.square = np.zeros(SLOTS + 1)

    def add(self, slots: np.ndarray, ends: np.ndarray, above: np.ndarray) -> None:
        size = np.diff(ends, prepend=0)
        self.n += np.bincount(slots, minlength=SLOTS + 1)
        for k in range(above.shape[1]):
            self.above[k] += np.bincount(slots, np.repeat(above[:, k], size), SLOTS + 1)
        self.square += np.bincount(slots, np.repeat(above.sum(1) ** 2, size), SLOTS + 1)

    def __add__(self, other: Responses) -> Responses:
        out = Responses(len(self.above))
        out.n, out.above, out.square = self.n + other.n, self.above + other.above, self.square + other.square
        return out


def fit_difficulty(r: Responses, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's difficulty at the steps given (its responses' maximum of likelihood), and its weight."""
    k = len(steps)
    score = (r.above.sum(0) + PRIOR * k / 2) / (r.n + PRIOR)
    difficulty = np.interp(score, passed(_GRID, steps), _GRID)
    mean = r.above.sum(0) / np.maximum(r.n, 1)
    spread = np.maximum(r.square / np.maximum(r.n, 1) - mean**2, 0)
    agreement = np.maximum(0.0, 1 - spread / ((k + 1) ** 2 / 12 + 1e-9)) ** 2
    weight = np.where(r.n > 0, agreement * r.n / (r.n + 4), 0.0)
    return difficulty, weight


def fit_steps(r: Responses, difficulty: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each step at the difficulties given, centred."""
    out = []
    for k, at in enumerate(steps):
        for _ in range(30):
            p = 1 / (1 + np.exp(-(difficulty - at)))
            at += ((r.n * p).sum() - r.above[k].sum()) / max((r.n * p * (1 - p)).sum(), 1e-9)
        out.append(at)
    return np.array(out) - np.mean(out)


def fit_cuts(levels: np.ndarray, bands: np.ndarray, k: int) -> np.ndarray:
    """Between neighbouring bands, the level that parts the graded samples with the fewest errors."""
    cuts = []
    for j in range(k):
        below, over = np.sort(levels[bands <= j]), np.sort(levels[bands > j])
        if not len(below) or not len(over):
            cuts.append(0.0)
            continue
        at = np.unique(np.concatenate([below, over]))
        middle = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
        wrong = (len(below) - np.searchsorted(below, middle)) + np.searchsorted(over, middle)
        best = np.flatnonzero(wrong == wrong.min())
        # Among equally good places the one in the widest gap.
        gap = np.diff(at)[best] if len(at) > 1 else np.ones(1)
        cuts.append(float(middle[best[np.argmax(gap)]]))
    return np.array(cuts)


class Samples:
    """The graded samples as words; the levels of these are given."""

    def __init__(self, texts: list[str | None], bands: list[str], names: tuple[str, ...]) -> None:
        self.bands = np.array([names.index(b) for b in bands])
        self.steps = len(names) - 1
        self.hashes, self.ends, _ = Words().of(texts)
        self.above = (self.bands[:, None] > np.arange(self.steps)[None, :]).astype(float)
        # The most frequent word of the samples has a slot.
        word, n = np.unique(self.hashes, return_counts=True)
        order = np.argsort(n, kind="stable")
        self.owner = np.zeros(SLOTS + 1, np.int64)
        self.owner[word[order] & (SLOTS - 1)] = word[order]

    def slots(self, owner: np.ndarray) -> np.ndarray:
        at = self.hashes & (SLOTS - 1)
        return np.where(owner[at] == self.hashes, at, NONE).astype(np.int32)

    def responses(self) -> Responses:
        r = Responses(self.steps)
        r.add(self.slots(self.owner), self.ends, self.above)
        return r

    def function_words(self) -> np.ndarray:
        sample = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        pair = np.unique(sample * (SLOTS + 1) + self.slots(self.owner))
        often = np.ones(SLOTS + 1, bool)
        for j in range(self.steps + 1):
            own = self.bands[pair // (SLOTS + 1)] == j
            often &= np.bincount(pair[own] % (SLOTS + 1), minlength=SLOTS + 1) >= FUNCTION_SHARE * max((self.bands == j).sum(), 1)
        often[NONE] = False
        return often

    def model(self, r: Responses, before: Model | None = None, owner: np.ndarray | None = None) -> Model:
        """The model of the responses ``r``: difficulties and steps in turns, cuts by the samples."""
        steps = before.steps if before else np.linspace(-2, 2, self.steps)
        met = np.flatnonzero(r.n[:SLOTS])
        heard = Responses(self.steps)
        heard.n, heard.above, heard.square = r.n[met], r.above[:, met], r.square[met]
        for _ in range(5):
            of_met, weight_of_met = fit_difficulty(heard, steps)
            steps = fit_steps(heard, of_met, steps)
        difficulty, weight = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        difficulty[met], weight[met] = of_met, weight_of_met
        if before:
            known, function = before.known, before.function
        else:
            known, function = self.responses().n > 0, self.function_words()
            known[NONE] = False
        owner = owner if owner is not None else before.owner if before else self.owner
        out = Model(owner, difficulty.astype(np.float32), weight.astype(np.float32), known, function, steps, np.zeros(self.steps))
        out.cuts = fit_cuts(out.levels(self.slots(owner), self.ends), self.bands, self.steps)
        return out


_words: list[Words] = []


def _worker_words() -> Words:
    if not _words:
        _words.append(Words())
    return _words[0]


def _columns(k: int) -> list[str]:
    return ["n", "square", *(f"a{j}" for j in range(k))]


def _heard(documents: DataFrame, model: Model) -> tuple[Responses, np.ndarray]:
    """The responses of all prose documents at their levels by ``model``, and the word of each slot: that of the samples,
    else the most frequent. At most SLOTS rows reach the driver."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers each
    k, columns = len(model.cuts), _columns(len(model.cuts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = shared.value, _worker_words()
        held: list[np.ndarray] = []  # columns of word, n, square, above

        def merged() -> np.ndarray:
            every = np.concatenate(held, axis=1)
            words, at = np.unique(every[0].view(np.int64), return_inverse=True)
            sums = [np.bincount(at, x, len(words)) for x in every[1:]]
            return np.stack([words.view(np.float64), *sums])

        def batch_of(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), *(pa.array(y) for y in x[1:])], ["word", *columns])

        for batch in batches:
            for part in slices(batch, 1):
                hashes, ends, count = own.of(part.column(1).to_pylist())
                slots = m.slots(hashes)
                prose = m.prose(slots, ends, count)
                size = np.diff(ends, prepend=0)
                above = m.above(m.levels(slots, ends))
                every = np.repeat(prose, size)
                taken = m.owner[hashes & (SLOTS - 1)]
                every &= (taken == hashes) | (taken == 0)  # the others' slot is another word's of the samples
                words, at = np.unique(hashes[every], return_inverse=True)
                of = [np.repeat(x, size)[every] for x in (np.ones(len(size)), above.sum(1) ** 2, *above.T)]
                held.append(np.stack([words.view(np.float64), *(np.bincount(at, x, len(words)) for x in of)]))
                if sum(x.shape[1] for x in held) > SUMMED_AT_ONCE:
                    held[:] = [merged()]
                    if held[0].shape[1] > SUMMED_AT_ONCE // 2:
                        yield batch_of(held.pop())
        if held:
            yield batch_of(merged())

    sums = documents.mapInArrow(work, "word bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))
    slot = F.col("word").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    won = sums.groupBy(slot).agg(F.max(F.struct("n", "word", *columns[1:])).alias("x")).select("slot", "x.*").toPandas()
    r, at = Responses(k), won["slot"].to_numpy().astype(np.int64)
    r.n[at], r.square[at] = won["n"].to_numpy(), won["square"].to_numpy()
    for j in range(k):
        r.above[j][at] = won[f"a{j}"].to_numpy()
    owner = model.owner.copy()
    owner[at] = won["word"].to_numpy()
    return r, owner


def _slotted(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, slots) of the prose documents: their words by slot, so that texts are taken apart no more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = shared.value, _worker_words()
        for batch in batches:
            for part in slices(batch, 1):
                hashes, ends, count = own.of(part.column(1).to_pylist())
                slots = m.slots(hashes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(slots))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "slots"]).filter(pa.array(m.prose(slots, ends, count)))

    return documents.mapInArrow(work, "doc_id bigint, slots array<int>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(1)
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], (ends[1:] - ends[0]).astype(np.int64)


def _gather(slotted: DataFrame, model: Model, before: Model) -> tuple[Responses, float, float]:
    """The responses of all documents at their levels by ``model``; the share of documents whose band, and how far in the
    mean their level, isn't what it was ``before``. At most SLOTS rows reach the driver."""
    shared = slotted.sparkSession.sparkContext.broadcast((model, before))
    k, columns = len(model.cuts), _columns(len(model.cuts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, old), r, tally = shared.value, Responses(k), np.zeros(3)
        for batch in batches:
            slots, ends = _lists(batch)
            level, was = m.levels(slots, ends), old.levels(slots, ends)
            tally += len(ends), (m.bands(level) != old.bands(was)).sum(), np.abs(level - was).sum()
            r.add(slots, ends, m.above(level))
        met = np.flatnonzero(r.n[:SLOTS])
        rows = [np.append(met, -1), np.append(r.n[met], tally[0]), np.append(r.square[met], tally[1]), *(np.append(r.above[j][met], tally[2]) for j in range(k))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["slot", *columns])

    sums = slotted.mapInArrow(work, "slot bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    tally, sums = sums[sums["slot"] < 0], sums[sums["slot"] >= 0]
    r, at = Responses(k), sums["slot"].to_numpy().astype(np.int64)
    r.n[at], r.square[at] = sums["n"].to_numpy(), sums["square"].to_numpy()
    for j in range(k):
        r.above[j][at] = sums[f"a{j}"].to_numpy()
    docs = max(float(tally["n"].sum()), 1.0)
    return r, float(tally["square"].sum()) / docs, float(tally["a0"].sum()) / docs


def _score(slotted: DataFrame, model: Model, names: tuple[str, ...]) -> DataFrame:
    shared = slotted.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            level = m.levels(*_lists(batch))
            band = pa.array([names[i] for i in m.bands(level)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level), band], ["doc_id", "level", "band"])

    return slotted.mapInArrow(work, "doc_id bigint, level double, band string")


def unheard(documents: DataFrame, graded: DataFrame, names: tuple[str, ...] = BANDS) -> float:
    """The share of word occurrences in prose documents whose word has no slot, as another word has it."""
    rows = graded.select("text", "band").where(F.col("band").isin(*names)).limit(MAX_SAMPLES + 1).collect()
    samples = Samples([r.text for r in rows], [r.band for r in rows], names)
    model = samples.model(samples.responses())
    documents = documents.select("doc_id", "text").where("text is not null")
    _, owner = _heard(documents, model)
    model.owner = owner
    n, lost = _slotted(documents, model).select(F.sum(F.size("slots")), F.sum(F.size(F.filter("slots", lambda x: x == NONE)))).first()
    return (lost or 0) / max(n or 0, 1)


def graded_levels(documents: DataFrame, graded: DataFrame, names: tuple[str, ...] = BANDS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(doc_id, level, band, rounds, changed, moved) of every document of English prose with at least MIN_WORDS parts
    between white space.

    ``documents`` has doc_id and text, ``graded`` text and band, of ``names`` from the easiest; it may have MAX_SAMPLES
    rows at most. ``rounds``: how often difficulties are estimated anew from all documents, at most; the result says how
    often they were, and which share of documents changed their band and how far levels moved in the last round. Null,
    empty, short and foreign texts give no row, nor does anything if there are no graded samples.
    """
    spark: SparkSession = documents.sparkSession
    documents = documents.select("doc_id", "text").where("text is not null")
    rows = graded.select("text", "band").where(F.col("band").isin(*names)).limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} graded samples")
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, level double, band string, rounds int, changed double, moved double")
    samples = Samples([r.text for r in rows], [r.band for r in rows], names)
    first = model = samples.model(samples.responses())
    done, changed, moved = 0, 0.0, 0.0
    if rounds:
        heard, owner = _heard(documents, first)
        model, done = samples.model(heard + samples.responses(), first, owner), 1
        first.owner = owner
    slotted = written(_slotted(documents, model))
    before = first
    while done:
        heard, changed, moved = _gather(slotted, model, before)
        if done >= rounds or changed <= SETTLED_BANDS and moved <= SETTLED_LEVELS:
            break
        before, model, done = model, samples.model(heard + samples.responses(), model), done + 1
    return _score(slotted, model, names).select("doc_id", "level", "band", F.lit(done).alias("rounds"), F.lit(changed).alias("changed"), F.lit(moved).alias("moved"))
