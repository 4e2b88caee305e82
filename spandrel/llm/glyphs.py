"""Text that looks the same in one consistent form, on whole Arrow batches.

A batch is turned into one array of code points. Table gathers replace each by what it looks like (nothing for
invisible characters, a space for any white space, the resembled letter for full-width and look-alike ones, its
canonical parts for an accented letter), expansion offsets make room for more than one, and marks are put into order
and composed for the whole batch at once. There is no call per row.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.batches import slices
from spandrel.tables import written

# Letters of other scripts beside the Latin letters they look like: of the public confusables data the single
# letters of the same case that differ by no visible stroke.
LOOKALIKES = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮԀԌԚԜӀѴ", "ABESIJKMHOPCTYXYDGQWIV"),
    ("аеорсухіјѕһԁԛԝӏѵү", "aeopcyxijshdqwlvy"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("αγινορυχϲ", "ayivopuxc"),
    ("ͿϜϺ", "JFM"),
    # Cyrillic omega
    ("ѡ", "w"),
    # Armenian, and Latin letters of odd shape
    ("օսոհցյ", "ounhgj"),
    ("ՍՏՕաքզռ", "USOwfqn"),
    # Cherokee, Coptic, Georgian and Hebrew
    ("ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴ", "DRTYAJEWMHYGZRWSVSLCPKGB"),
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"),
    ("ყჿס", "yoo"),
    # small capitals
    ("ᴄᴏᴑᴜᴠᴡᴢ", "coouvwz"),
    ("ɑɡƖǀ", "agll"),
    # hyphens that do and don't allow a line break
    ("\u2010\u2011", "--"),
)
#: Kinds of compatibility forms that only change width or font.
SAME_LOOK = ("<wide>", "<narrow>", "<font>")
LIGATURES = range(0xFB00, 0xFB07)
LIMIT = 0x110000
HANGUL_L, HANGUL_V, HANGUL_T, HANGUL = 0x1100, 0x1161, 0x11A7, 0xAC00


class Tables:
    """Lookup tables over all code points, built from the Unicode data of the interpreter and LOOKALIKES."""

    def __init__(self) -> None:
        resembles = {a: b for x, y in LOOKALIKES for a, b in zip(x, y, strict=True)} | {"µ": "μ", "Ω": "Ω"}
        self.length = np.ones(LIMIT, np.int32)
        self.start = np.arange(LIMIT, dtype=np.int32)
        self.ccc = np.zeros(LIMIT, np.uint8)
        extra: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for cp in [*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]:
            if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900 or 0x13000 <= cp < 0x1D000:
                continue
            ch = chr(cp)
            self.ccc[cp] = unicodedata.combining(ch)
            form = self._looks(ch, resembles)
            if form != ch:
                self.length[cp], self.start[cp] = len(form), LIMIT + len(extra)
                extra += map(ord, form)
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
                pair = unicodedata.decomposition(ch).split()
                pairs[int(pair[0], 16), int(pair[1], 16)] = cp
        self.pool = np.concatenate([np.arange(LIMIT, dtype=np.int32), np.array(extra, np.int32)])
        keys = np.array([a * LIMIT + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(pairs.values()), np.int32)[order]

    @staticmethod
    def _looks(ch: str, resembles: dict[str, str]) -> str:
        kind = unicodedata.category(ch)
        if ch.isspace() or kind in ("Zs", "Zl", "Zp"):
            return " "
        cp = ord(ch)
        if kind in ("Cf", "Cc") or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp < 0xE01F0:
            return ""
        if unicodedata.decomposition(ch).startswith(SAME_LOOK) or cp in LIGATURES:
            ch = unicodedata.normalize("NFKC", ch)
        parts = unicodedata.normalize("NFD", ch)
        return "".join(resembles.get(x, x) for x in parts)


@functools.cache
def tables() -> Tables:
    return Tables()


def same_look(values: pa.Array) -> pa.Array:
    """Each text in its one consistent form; null stays null, a text of which nothing shows becomes empty.

    White space of any kind and length is one space, with none at the ends. Letter case, accents, super- and
    subscripts are kept, and dashes are kept apart from hyphens. The form is in canonical composition (NFC).
    """
    values = values.cast(pa.large_string())
    raw, rows = _code_points(values)
    t = tables()
    # Replace, with room for expansions.
    length = t.length[raw]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(t.start[raw] - (ends - length), length) + np.arange(total)
    cps, row = t.pool[at], np.repeat(rows, length)
    # One space between words, none at the ends.
    space = cps == 32
    first = np.ones(total, bool)
    first[1:] = row[1:] != row[:-1]
    before = np.zeros(total, bool)
    before[1:] = space[:-1]
    keep = ~(space & (first | before))
    cps, row = cps[keep], row[keep]
    if len(cps):
        last = np.ones(len(cps), bool)
        last[:-1] = row[1:] != row[:-1]
        keep = ~(last & (cps == 32))
        cps, row = cps[keep], row[keep]
    cps, row = _composed(cps, row, t)
    return _texts(cps, row, values)


def _code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the row of each."""
    n = len(values)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
    data = values.buffers()[2]
    data = bytes(data.slice(int(ends[0]), int(ends[-1] - ends[0]))) if data is not None else b""
    cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(starts)])[ends - ends[0]]
    return cps, np.repeat(np.arange(n), np.diff(count))


def _composed(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, and composed with what they stand on."""
    ccc = t.ccc[cps]
    marks = ccc > 0
    if marks.any():
        fresh = np.ones(len(cps), bool)
        fresh[1:] = row[1:] != row[:-1]
        run = np.cumsum(~marks | fresh)
        if (marks[1:] & marks[:-1] & (run[1:] == run[:-1]) & (ccc[1:] < ccc[:-1])).any():
            order = np.lexsort((ccc, run))
            cps, row = cps[order], row[order]
    while len(cps) > 1:
        ccc = t.ccc[cps].astype(np.int16)
        place = np.arange(len(cps))
        base = np.maximum.accumulate(np.where(ccc == 0, place, -1))
        before = np.concatenate([[-1], base[:-1]])  # the base before each, which a starter may compose with too
        base = np.where(ccc == 0, before, base)
        known = (base >= 0) & (row[base] == row)
        prior = np.concatenate([[0], ccc[:-1]])
        free = (base == place - 1) | ((ccc > prior) & (prior > 0))
        i = np.flatnonzero(known & free)
        a, b = cps[base[i]], cps[i]
        key = a.astype(np.int64) * LIMIT + b
        j = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        to = np.where(t.pair_keys[j] == key, t.pair_to[j], 0)
        lead = (a >= HANGUL_L) & (a < HANGUL_L + 19) & (b >= HANGUL_V) & (b < HANGUL_V + 21)
        to = np.where(lead, HANGUL + ((a - HANGUL_L) * 21 + b - HANGUL_V) * 28, to)
        tail = (a >= HANGUL) & (a < 0xD7A4) & ((a - HANGUL) % 28 == 0) & (b > HANGUL_T) & (b < HANGUL_T + 28)
        to = np.where(tail, a + b - HANGUL_T, to)
        hit = to > 0
        i, to = i[hit], to[hit]
        if not len(i):
            break
        one = np.unique(base[i], return_index=True)[1]  # one a round for each base: the first
        i, to = i[one], to[one]
        # A base that is itself absorbed this round waits for the next.
        ok = ~np.isin(base[i], i)
        i, to = i[ok], to[ok]
        cps = cps.copy()
        cps[base[i]] = to
        keep = np.ones(len(cps), bool)
        keep[i] = False
        cps, row = cps[keep], row[keep]
    return cps, row


def _texts(cps: np.ndarray, row: np.ndarray, like: pa.Array) -> pa.Array:
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
    per = np.bincount(row, weights=size, minlength=len(like)).astype(np.int64) if len(row) else np.zeros(len(like), np.int64)
    ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_string(), len(like), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    if like.null_count:
        out = pa.compute.if_else(pa.compute.is_valid(like), out, pa.scalar(None, pa.large_string()))
    return out


def _with_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "value"):
            form = same_look(part.column("value")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, form], [*part.schema.names, "form"])


def consistent(values: DataFrame) -> DataFrame:
    """``values``, which has a text column ``value``, with its consistent form as ``form`` (one that it has is replaced)."""
    values = values.drop("form")
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in values.schema)
    return values.mapInArrow(_with_form, f"{schema}, form string")


def distinct_forms(values: DataFrame) -> DataFrame:
    """(field, value, low, n, form) of each distinct stored value in ``values`` (field, id, value): its smallest id,
    number of rows and form. Nulls and values of which nothing shows are left out."""
    stored = values.where("value is not null").groupBy("field", "value").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    return consistent(stored).where("form <> ''")


def same_looking(values: DataFrame) -> DataFrame:
    """(field, first_id, id) of each row whose value looks like that of an earlier row but is stored otherwise.

    ``values`` has field, id (unique within a field) and value. The first of a group is its smallest id; rows that
    store the very value of the first aren't listed. Null, blank and invisible values form no group.
    """
    values = values.select("field", "id", "value")
    forms = written(distinct_forms(values))
    firsts = forms.groupBy("field", "form").agg(F.min("low").alias("first_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    # Each stored value has its own smallest id, so the first one's is told by it.
    others = forms.join(firsts, ["field", "form"]).where("low <> first_id").select("field", "value", "first_id")
    return values.join(others, ["field", "value"]).select("field", "first_id", "id")
