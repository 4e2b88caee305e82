"""Text of one single-byte encoding read as another: what each pair makes of letters, and what a language may look like.

A language is known by its letters, and one of a script of its own by frequent pairs of letters too. Both say whether a
word is likely as it stands or as it is restored; what is likely in two ways is not decided here.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

from spandrel.llm.glyphs import LOOKALIKES

#: Single-byte encodings in which text may have been read.
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-7", "iso8859-15", "mac-roman", "cp437", "cp850", "cp852", "cp866", "koi8-r")
# Letters beside a-z of languages in Latin script, and the encodings their texts are written in.
WESTERN, CENTRAL, TURKISH = ("cp1252", "mac-roman", "cp850", "cp437"), ("cp1250", "iso8859-2", "cp852"), ("cp1254",)
LATIN = {
    "fr": ("àâæçéèêëîïôœùûüÿ", WESTERN),
    "de": ("äöüßé", WESTERN),
    "es": ("áéíñóúüªº", WESTERN),
    "pt": ("áâãàçéêíóôõúüªº", WESTERN),
    "it": ("àèéìíîòóùú", WESTERN),
    "ca": ("àçèéíïòóúü", WESTERN),
    "nl": ("áéèëïíóöúüĳ", WESTERN),
    "da": ("æøåéó", WESTERN),
    "sv": ("åäöéàü", WESTERN),
    "fi": ("äöåšž", WESTERN),
    "et": ("äöõüšž", ()),
    "is": ("áðéíóúýþæö", ()),
    "pl": ("ąćęłńóśźż", CENTRAL),
    "cs": ("áčďéěíňóřšťúůýž", CENTRAL),
    "sk": ("áäčďéíĺľňóôŕšťúýž", CENTRAL),
    "hu": ("áéíóöőúüű", ()),
    "hr": ("čćđšž", CENTRAL),
    "lt": ("ąčęėįšųūž", ()),
    "lv": ("āčēģīķļņōŗšūž", ()),
    "cy": ("âêîôûŵŷáéíóúäëïöü", ()),
    "sq": ("çë", ()),
    "ro": ("ăâîșțşţ", ("cp1250", "iso8859-2")),
    "tr": ("çğıöşüâîû", TURKISH),
}
# Frequent pairs of letters in Russian and, without accents, in Greek.
RUSSIAN_PAIRS = "ст ен ов но ни на ра ко то ри во го ре ли ер пр ла ан ка ос ва ор та от ол ел ом не по ин ес ны ые ый ий ая их ам ми де ле те за до ве пе ро ки об ть ет ят ют ие ой ых ча ша ши жи уз кн иг ти иц ус из ме ль си ся же ту ск оч ог ед со ав ат ад се зд уд ря ду му лу бу ку".split()
GREEK_PAIRS = "αι ου ει οι το τη τα τι να με σε απ πο ρο ρι ερ στ ικ κα αν εν ον ων ες ος ης ας πρ λο λι μα μο ια ιο νο νη ντ τε τω λα ετ σι σα θε γι δι δε δη εκ ελ επ υς ιν ις ισ κε κη κι κο λη μη μι μπ ευ αυ ρα ρη ρε αρ ορ γρ γο νε νι τρ τρο οσ ασ εσ αλ ολ χρ χω χα βι βα δα δο πα πε πι ημ υπ υν συ φω φι ζω θα εί ού".split()
#: What Russian never has: й after a consonant, a sign after a vowel or at the start, a hard sign but before е, ё, ю, я.
RUSSIAN_NEVER = re.compile("[бвгджзклмнпрстфхцчшщ]й|[аеёиоуыэюя][ьъ]|(?<![Ѐ-џ])[ьъы]|ъ(?![еёюя])")
#: What Greek never has: a final sigma within a word, another one at its end, most consonants at its end.
GREEK_NEVER = re.compile("ς[α-ώ]|[βγδζθκλμξπστφχψ](?![Ά-ώ])")
NEVER = {"ru": RUSSIAN_NEVER, "el": GREEK_NEVER}
#: Signs that follow figures, and how a letter in their place is told from a word.
SIGNS = "€°"


@dataclass(frozen=True)
class Script:
    """A language of a script of its own: its letters as a character class, encodings, and frequent pairs of letters."""

    name: str
    letters: str
    written: tuple[str, ...]
    pairs: tuple[str, ...]

    @functools.cached_property
    def word(self) -> re.Pattern:
        return re.compile(f"[{self.letters}]{{2,}}")

    @functools.cached_property
    def only(self) -> re.Pattern:
        return re.compile(f"[{self.letters}№–—…’«» ]+")

    @functools.cached_property
    def three(self) -> re.Pattern:
        return re.compile(f"[{self.letters}]{{3}}")

    @functools.cached_property
    def frequent(self) -> frozenset[str]:
        return frozenset(self.pairs)

    @functools.cached_property
    def letter(self) -> re.Pattern:
        return re.compile(f"[{self.letters}]")

    def count(self, text: str) -> int:
        return len(self.letter.findall(text))

    def score(self, text: str) -> float:
        """Share of the pairs of letters of its words that are frequent."""
        low, total, good = bare(text.lower()) if self.name == "el" else text.lower(), 0, 0
        for m in self.word.finditer(low):
            for i in range(len(m[0]) - 1):
                total += 1
                good += m[0][i : i + 2] in self.frequent
        return good / total if total else 0.0


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


RUSSIAN = Script("ru", "ЁА-яё", ("cp1251", "koi8-r", "cp866", "iso8859-5"), tuple(dict.fromkeys(RUSSIAN_PAIRS)))
GREEK = Script("el", "Ά-ώ", ("cp1253", "iso8859-7"), tuple(dict.fromkeys(x for x in GREEK_PAIRS if len(x) == 2)))
SCRIPTS = (RUSSIAN, GREEK)


def encoded(text: str, codec: str) -> bytes | None:
    """``text`` in a single-byte ``codec``, where a control character of the 0x80 block stands for an undefined byte."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def decoded(data: bytes, codec: str) -> str:
    """What ``data`` looks like when read in a single-byte ``codec``; an undefined byte is a control character."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return "".join(x if (x := bytes([b]).decode(codec, "ignore")) else chr(b) for b in data)


def garbled(text: str, written: str, read: str) -> str | None:
    """What ``text`` becomes when written in one encoding and read in the other; None if it can't be written."""
    try:
        return decoded(text.encode(written), read)
    except UnicodeEncodeError:
        return None


@functools.cache
def script_pairs(script: Script) -> tuple[tuple[str, str], ...]:
    return tuple((w, r) for w in script.written for r in READ + (("iso8859-5",) if script is RUSSIAN else ()) if r != w and garbled("".join(script.pairs[:9]), w, r) != "".join(script.pairs[:9]))


@functools.cache
def latin_pairs() -> dict[tuple[str, str], dict[str, str]]:
    """For each pair of encodings of Latin script, the letters by what they become, where that differs."""
    out: dict[tuple[str, str], dict[str, str]] = {}
    for letters, codecs in LATIN.values():
        for w in codecs:
            for r in READ:
                if r == w:
                    continue
                table = out.setdefault((w, r), {})
                for ch in letters + letters.upper():
                    bad = garbled(ch, w, r) if len(ch) == 1 else None
                    if bad and bad != ch and len(bad) == 1:
                        table[bad] = ch
    return {pair: table for pair, table in out.items() if table}


#: Encodings that are rarely met: of two restorations those of the others count.
RARE = frozenset(("mac-roman", "cp437", "cp850", "cp852", "cp866", "koi8-r"))
#: Letters that stand beside each other in texts of several western languages.
MIXED = frozenset("".join(LATIN[x][0] for x in ("fr", "de", "es", "pt", "it", "ca", "nl")))
#: Letters of other scripts that look Latin: within Latin words they were put there on purpose.
LOOK_LATIN = frozenset("".join(x for x, _ in LOOKALIKES))
LOOKED_LIKE = frozenset("".join(x for _, x in LOOKALIKES))
_WORD = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f\s])+")
#: Signs that words may have without being garbled: apostrophes, dots, dashes, quotation marks, trade marks, ordinals.
_HARMLESS = frozenset("’‘ʼ·‧–—‑‐…“”„«»‹›™®©²³¹°½¼¾×÷№€\xad​‌‍⁠﻿′″")


#: Anything but small letters of western languages and such signs.
_UNUSUAL = re.compile(f"[^\x00-\x7f\xa0{''.join(sorted(MIXED - set('ªº')))}{''.join(sorted(_HARMLESS - set('²³¹½¼¾')))}]")


@functools.cache
def likely(marks: frozenset[str]) -> bool:
    """Whether some language in Latin script has all these letters (small ones)."""
    return any(marks <= frozenset(letters) for letters, _ in LATIN.values())


def odd(word: str) -> tuple[set[str], set[str]]:
    """Small letters beside a-z of a word, and what no word has: signs between letters, letters of another script in a
    Latin word, and capitals after small letters."""
    letters, wrong = set(), set()
    latin = any(c.isascii() and c not in LOOKED_LIKE for c in word) or sum(map(str.isascii, word)) >= 3 * sum(c.isalpha() and not c.isascii() for c in word)
    for i, c in enumerate(word):
        if c.isascii() or c in _HARMLESS and c not in "²³¹½¼¾" or c.isalpha() and unicodedata.decomposition(c).startswith("<"):
            continue  # ligatures and wide letters are a matter of form
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        if c.isalpha() and c not in "ªº":
            if c.isupper() and before.islower():
                wrong.add(c)
            elif not unicodedata.name(c, "").startswith("LATIN"):
                if latin and c not in LOOK_LATIN:
                    wrong.add(c)
            else:
                letters.add(c.lower() if len(c.lower()) == 1 else "i")
        elif before.isalpha() and after.isalpha():
            wrong.add(c)
    return letters, wrong


def latin_edits(text: str) -> tuple[bool, list[tuple[int, int, str]]]:
    """Whether words of Latin script fit no language as they stand but one when restored, and the edits of these words.

    Where two pairs of encodings restore them to different words, nothing is edited.
    """
    if not _UNUSUAL.search(text):
        return False, []
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text) if not m[0].isascii()]
    words = [w for w in words if any(c.isascii() for c in w[2])]
    if not words:
        return False, []
    seen = [odd(w) for _, _, w in words]
    marks, wrong = set().union(*(a for a, _ in seen)), set().union(*(b for _, b in seen))
    if not wrong and (marks <= MIXED or likely(frozenset(marks))):
        return False, []
    found: dict[tuple, tuple[int, int]] = {}
    for pair, table in latin_pairs().items():
        if wrong and not wrong <= table.keys():
            continue
        edits, letters, changed = [], set(), 0
        for (a, b, word), (_, bad) in zip(words, seen, strict=True):
            new = "".join(table.get(c, c) for c in word)
            if new == word:
                continue
            own, still = odd(new)
            if still or not likely(frozenset(own)):
                if bad:
                    edits = []
                    break
                continue
            edits.append((a, b, new))
            letters |= own
            changed += sum(x != y for x, y in zip(word, new, strict=True))
        rest = set().union(*(own for (a, b, _), (own, _) in zip(words, seen, strict=True) if (a, b) not in {e[:2] for e in edits}))
        mixed = not likely(frozenset(letters | rest))
        alone = any(bad or not own <= MIXED and not likely(frozenset(own)) for own, bad in seen)
        if not alone and changed < 3:
            continue  # words of two languages beside each other
        if mixed:
            # Beside correct text of another language only what no language has as it stands, and what such words enclose.
            odd_ones = [(a, b) for (a, b, _), (own, bad) in zip(words, seen, strict=True) if bad or not own <= MIXED and not likely(frozenset(own))]
            clear = [x for x in odd_ones if x in {e[:2] for e in edits}]
            if 2 * len(clear) <= len(odd_ones):
                continue  # what is odd here, this pair doesn't explain
            edits = [e for e in edits if clear[0][0] <= e[0] <= clear[-1][0]]
            changed = sum(x != y for a, b, new in edits for x, y in zip(text[a:b], new, strict=True))
        if edits and changed >= (1 if wrong else 2) and likely(frozenset(letters)):
            # Words of nothing but such letters, as French has them: between edited ones, or anywhere in text of one language.
            for m in _WORD.finditer(text, edits[0][1] if mixed else 0, edits[-1][0] if mixed else len(text)):
                new = "".join(table.get(c, "") for c in m[0])
                if len(new) == len(m[0]) and likely(frozenset(letters | set(new.lower()))):
                    edits.append((m.start(), m.end(), new))
            key, rank = tuple(edits), (changed, -sum(x in RARE for x in pair))
            found[key] = max(found.get(key, rank), rank)
    if not found:
        return False, []
    best = max(found.values())
    top = [list(e) for e, n in found.items() if n == best]
    return True, top[0] if len(top) == 1 else []
