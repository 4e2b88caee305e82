"""Encoding of whole texts with public tokenizers.

A text falls into units at places that are token boundaries whatever stands around them, so that each distinct unit is
encoded once a worker and a text is a gather of its units' ids. The distinct words of the units are encoded in the
order of a depth-first walk through the trie of their bytes: for every prefix, the last token of its encoding is found
from the last tokens of shorter prefixes, and what words share at their start is computed once.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spandrel.llm.batches import Growing, slices

TOKENIZERS = os.environ.get("SPANDREL_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before byte-level merges.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# Fixed value: the white space of the pattern.
SPACE = "\t-\r \x85\xa0  -     　"
#: White space other than single spaces and line breaks: such texts are split by UNITS in place of at spaces.
UNEVEN = re.compile(f"[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]|  | \n")
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
#: Distinct units a worker keeps; then it starts anew. It bounds memory, not what is encoded.
KEPT_UNITS = 400_000


class Merges:
    """Byte-pair merges as ranks: the encoding of words by the last tokens of their prefixes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        # The length of the longest token by its last two bytes bounds the search at every place.
        self.longest: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > 1:
                self.longest[t[-2:]] = max(self.longest.get(t[-2:], 0), len(t))

    def merge(self, data: bytes) -> list[int]:
        """The encoding of ``data`` by doing the merges in their order; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            pair = parts[best[1]] + parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] + parts[i + 1] == pair:
                    out.append(pair)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[x] for x in parts]

    def _stands(self, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merge(self.token[token]) == [token]
        return ok

    def _follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a`` in an encoding: their bytes together are encoded as the two."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            ok = self.fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return ok

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its encoding, in the order of a depth-first walk through their trie."""
        last: list[int] = [-1]  # of the encoding of the prefix that ends here, the last token
        size: list[int] = [0]
        before = b""
        ranks, longest = self.ranks, self.longest
        for word in sorted(set(words)):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                low = max(0, end - longest.get(word[max(0, end - 2) : end], 1))
                for start in range(low, end):
                    token = ranks.get(word[start:end])
                    if token is not None and (self._stands(token) if start == 0 else self._follows(last[start], token)):
                        last.append(token)
                        size.append(end - start)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            yield word, ids[::-1]
            before = word


class _Numbers(dict):
    """Numbers units as they are met, and keeps the new ones for encoding."""

    def __init__(self, owner: Units, lead: str) -> None:
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, key: str) -> int:
        if self.lead:
            number = self.owner.plain[self.lead + key]
        else:
            number = self.owner.count
            self.owner.count += 1
            self.owner.fresh.append(key)
        self[key] = number
        return number


class Units:
    """The distinct units met so far, with their ids (``encode``) or numbers of tokens (``measure``)."""

    def __init__(self, home: str, names: tuple[str, ...]) -> None:
        self.home, self.names = home, names
        self.clear()

    def clear(self) -> None:
        self.count, self.fresh = 0, []
        self.plain, self.spaced = _Numbers(self, ""), _Numbers(self, " ")
        self.words: dict[str, list[int]] = {}
        self.start, self.length, self.pool = Growing(np.int64), Growing(np.int64), Growing(np.int32)
        self.sizes = {n: Growing(np.int64) for n in self.names}

    def split(self, text: str) -> list[int]:
        if UNEVEN.search(text):
            return list(map(self.plain.__getitem__, UNITS.findall(text)))
        first, *rest = text.split(" ")
        return [self.plain[first], *map(self.spaced.__getitem__, rest)]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units of the texts, and where each text's end."""
        if self.count > KEPT_UNITS:
            self.clear()
        units: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                units += self.split(text)
            ends[i] = len(units)
        return np.array(units, np.int64), ends

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text by the byte-level vocabulary; of an empty and of a null text an empty list."""
        units, ends = self.numbers(texts)
        self._encode_fresh()
        length = self.length[units]
        tail = np.cumsum(length)
        at = np.repeat(self.start[units] - (tail - length), length) + np.arange(tail[-1] if len(tail) else 0)
        offsets = np.concatenate([[0], np.concatenate([[0], tail])[ends]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.pool[at]))

    def _encode_fresh(self) -> None:
        split = [WORDS.findall(x) for x in self.fresh]
        fresh = {w for ws in split for w in ws if w not in self.words}
        spelled = {w.encode("utf-8"): w for w in fresh}
        for data, ids in merges(self.home).walk(list(spelled)):
            self.words[spelled[data]] = ids
        ids = [[i for w in ws for i in self.words[w]] for ws in split]
        length = np.array([len(x) for x in ids], np.int64)
        self.start.extend(len(self.pool) + np.cumsum(length) - length)
        self.length.extend(length)
        self.pool.extend(np.fromiter((i for x in ids for i in x), np.int32))
        self.fresh = []

    def measure(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """The number of tokens of each text, by tokenizer."""
        units, ends = self.numbers(texts)
        for name in self.names:
            got = [len(x.ids) for x in tokenizer(self.home, name).encode_batch(self.fresh, add_special_tokens=False)] if self.fresh else []
            self.sizes[name].extend(np.array(got, np.int64))
        self.fresh = []
        out = {}
        for name in self.names:
            total = np.concatenate([[0], np.cumsum(self.sizes[name][units])])[ends]
            out[name] = np.diff(total, prepend=0)
        return out


@functools.cache
def merges(home: str) -> Merges:
    with open(os.path.join(home, "byte_bpe_50k.tiktoken"), "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@functools.cache
def tokenizer(home: str, name: str):  # noqa: ANN201
    """A tokenizer of the folder, special tokens' strings being plain text. Its name is a file's, without the ending."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(os.path.join(home, f"{name}.json"), encoding="utf-8") as f:
        made = Tokenizer.from_str(json.dumps(json.load(f)))
    made.encode_special_tokens = True
    return made


@functools.cache
def units(home: str, names: tuple[str, ...]) -> Units:
    return Units(home, names)


def encoded(documents: DataFrame, home: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document: the ids of its whole text by byte_bpe_50k, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are plain text. No shuffle; other columns are
    ignored, repeated rows give one row each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units(home, ())
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), own.encode(part.column(1).to_pylist())], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, ids array<int>")


def measured(documents: DataFrame, names: tuple[str, ...], home: str = TOKENIZERS) -> DataFrame:
    """doc_id and, for each tokenizer in ``names``, the number of tokens of the whole text in a column of its name.

    Null and empty texts have no token. No shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units(home, names)
        for batch in batches:
            for part in slices(batch, 1):
                sizes = own.measure(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(sizes[n]) for n in names)], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))
