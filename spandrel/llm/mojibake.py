"""Text that was read in another encoding than it was written in: found, and restored where it still can be.

The garbled sequences of all letters and signs of REPERTOIRE are computed once for all pairs of encodings and put into
one automaton. Only where it matches does anything happen: the run around a match is encoded back and decoded rightly,
and replaced if that gives whole characters. Text that matches nothing stays as it is, also beside garbled text.
Pairs whose garbled letters are letters too need more than a match: the whole word must be implausible as
it stands and plausible when restored. Replacement characters and control characters of the 0x80 block mean that
letters were lost or misread; they make a case also if nothing can be restored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from spandrel.llm import codepages
from spandrel.llm.codepages import GREEK, RUSSIAN, RUSSIAN_NEVER, SCRIPTS, SIGNS, Script, latin_edits, script_pairs
from spandrel.llm.glyphs import LOOKALIKES

#: Encodings in which UTF-8 may have been read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-15", "mac-roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "gb18030", "big5", "cp932", "euc-kr")
MULTIBYTE = ("gb18030", "big5", "cp932", "euc-kr")
#: (written in, read as) where one byte is one letter, or half of one.
POLISH_AS_LATIN = (("iso8859-2", "cp1252"), ("cp1250", "cp1252"))
JAPANESE_AS_LATIN = (("cp932", "cp1252"), ("euc-jp", "cp1252"))
#: Pairs for which all two Cyrillic letters in a row are looked for, not only frequent ones.
ALL_CYRILLIC = tuple((w, r) for w in ("cp1251", "koi8-r", "cp866") for r in ("cp1252", "mac-roman") if (w, r) != ("koi8-r", "mac-roman"))
#: Letters and signs whose garbled forms are looked for.
REPERTOIRE = "".join(map(chr, [*range(0xA0, 0x180), *range(0x218, 0x21C), *range(0x386, 0x3CF), *range(0x400, 0x460), 0x490, 0x491, *range(0x2010, 0x2040), 0x20AC, 0x2116, 0x2122, 0x221A, *range(0x2080, 0x208A), *range(0x3000, 0x3003), 0x300C, 0x300D, *range(0x3041, 0x3097), *range(0x30A1, 0x30FD), *range(0xFF01, 0xFF5F), 0xFEFF]))
#: The ideographs of the first level of the Japanese standard, in the order of their codes.
KANJI = "".join(dict.fromkeys(bytes([a, b]).decode("euc-jp", "ignore") for a in range(0xB0, 0xD0) for b in range(0xA1, 0xFF)))
# Pairs of letters that Polish has and the languages written with the garbled letters haven't.
POLISH_PAIRS = "ięc ięk ięd ięt ięż ięs ięć pię ęk ęś ęż ędz ęg ęb rzę czę szę ęz ąc ąz ąd ąt ąk ąs ąż ąp ąb cią ają łą łę ść śc śl śn śm śp św śr śk ąś źr źd źn ćw ńc ńs żn żd ża żó ży że żo łó ło ła ły łe łk łk ół ał ył iał ąć yć óć eć".split()

_CONTROL = re.compile("[\x80-\x9f]")
_HIGH = re.compile("[^\x00-\x7f]+")
_INVERTED = re.compile("(?<![Ѐ-џ])[а-яё][А-ЯЁ]{2,}")
_KANA = re.compile("[぀-ヿ]")


def _bytes(text: str, codec: str) -> bytes | None:
    """``text`` in ``codec``, where a control character of the 0x80 block stands for an undefined byte."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec in MULTIBYTE:
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _read(data: bytes, codec: str) -> str | None:
    """What ``data`` looks like when read in ``codec``; an undefined byte is a control character."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        if codec in MULTIBYTE:
            return None
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """All garbled sequences, each with the pairs (written in, read as) it comes from."""
    found: dict[str, set[tuple[str, str]]] = {}

    def add(garbled: str | None, pair: tuple[str, str], least: int = 2) -> None:
        if garbled and len(garbled) >= least and not garbled.isascii():
            found.setdefault(garbled, set()).add(pair)

    for codec in READ_AS:
        for ch in REPERTOIRE + KANJI:
            data = ch.encode("utf-8")
            add(_read(data, codec), ("utf-8", codec), 1 if codec in MULTIBYTE else 2)
            if codec in MULTIBYTE and len(data) == 3:  # its bytes pair up with those of what stands beside it
                add(_read(data[:2], codec), ("utf-8", codec), 1)
                add(_read(data[1:], codec), ("utf-8", codec), 1)
    for pair in ALL_CYRILLIC:
        for a in map(chr, range(0x410, 0x450)):
            for b in map(chr, range(0x430, 0x450)):
                add(_read((a + b).encode(pair[0]), pair[1]), pair)
    for script in SCRIPTS:
        for pair in script_pairs(script):
            for two in script.pairs:
                for form in (two, two.capitalize(), two.upper()):
                    add(codepages.garbled(form, *pair), pair)
    for pair, signs in sign_pairs():
        for figure in "0123456789":
            for sign in signs:
                add(f"{figure} {sign}", pair)
    for pair in POLISH_AS_LATIN:
        for seq in set(POLISH_PAIRS):
            for form in (seq, seq.capitalize(), seq.upper()):
                add(_read(form.encode(pair[0]), pair[1]), pair)
        for ch in "łśźżąćŁŚŹŻĄ":
            garbled = _read(ch.encode(pair[0]), pair[1])
            if garbled and not garbled.isalpha():
                for x in "abcdefghijklmnopqrstuvwxyzó":
                    add(garbled + x, pair)
                    add(x + garbled, pair)
    for pair in JAPANESE_AS_LATIN:
        for ch in map(chr, [*range(0x3041, 0x3094), *range(0x30A1, 0x30F5), 0x3001, 0x3002]):
            add(_read(ch.encode(pair[0]), pair[1]), pair)
    out = ahocorasick.Automaton()
    for garbled, pairs in found.items():
        out.add_word(garbled, (len(garbled), tuple(sorted(pairs))))
    out.make_automaton()
    return out


def restore(text: str | None) -> tuple[bool, str | None]:
    """Whether a part of ``text`` was read in a wrong encoding, and the text with what could be restored.

    Null, empty and plain ASCII texts are no case and come back as they are. A text of any length is looked at whole.
    """
    if text is None or text.isascii():
        return False, text
    lost = "�" in text or _CONTROL.search(text) is not None
    hit, now = False, text
    for turn in range(5):
        runs = [m.span() for m in _HIGH.finditer(now)]
        hits = _hits(now, runs)
        found, edits = _utf8_edits(now, runs, hits) if turn < 4 else (False, [])  # garbled more than once, as UTF-8
        if not found:
            found, edits = _letter_edits(now, hits)
            return hit or found or lost, _applied(now, edits)
        hit, now = True, _applied(now, edits)
    return hit or lost, now


Hit = tuple[int, int, tuple[tuple[str, str], ...]]
Edit = tuple[int, int, str]


def _hits(text: str, runs: list[tuple[int, int]]) -> list[Hit]:
    """Where garbled sequences stand: every sequence has a character of a run, and at most two beside it."""
    find = automaton().iter
    return [(end - n + 1, end + 1, of) for a, b in runs for end, (n, of) in find(text, max(0, a - 2), min(len(text), b + 1))]


def _applied(text: str, edits: list[Edit]) -> str:
    """``text`` with the edits; everything else stays as it is."""
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def _utf8_edits(text: str, runs: list[tuple[int, int]], hits: list[Hit]) -> tuple[bool, list[Edit]]:
    at, own, edits = 0, {}, []
    for h in sorted((h for h in hits if h[2][-1][0] == "utf-8"), key=lambda h: h[0]):  # the pairs are in order, utf-8 last
        while runs[at][1] <= h[0]:
            at += 1
        if runs[at][0] <= h[0]:
            own.setdefault(at, []).append(h)
    for k, of in own.items():
        edits += _utf8_run(text, *runs[k], of)
    return bool(edits), edits


def _letter_edits(text: str, hits: list[Hit]) -> tuple[bool, list[Edit]]:
    """Of single-byte pairs the one whose restored words are likeliest. Where languages tie, nothing is restored."""
    pairs = {p for _, _, of in hits for p in of if p[0] != "utf-8"}
    for pair in JAPANESE_AS_LATIN:
        if pair in pairs and (edits := _japanese(text, pair, hits)):
            return True, edits
    ranked: list[tuple[float, str, list[Edit]]] = []
    view = _View(text) if pairs else None
    for script in SCRIPTS if view and view.doubtful else ():
        for pair in script_pairs(script):
            if pair in pairs and (edits := _script_edits(view, script, pair, hits)):
                ranked.append((script.score(" ".join(new for _, _, new in edits)) * sum(b - a for a, b, _ in edits) / 2 ** sum(x in codepages.RARE - {"koi8-r", "cp866"} for x in pair), script.name, edits))
    if ranked:
        best = max(ranked, key=lambda x: x[0])
        tied = any(x[1] != best[1] and x[0] >= 0.9 * best[0] for x in ranked)
        return True, [] if tied else best[2]
    signs = _signs(text, hits)
    if edits := max((_polish(text, pair, hits) for pair in POLISH_AS_LATIN if pair in pairs), key=lambda e: sum(b - a for a, b, _ in e), default=[]):
        return True, edits
    found, edits = latin_edits(text)
    return found or bool(signs), edits or signs


def _utf8_run(text: str, start: int, end: int, hits: list) -> list[tuple[int, int, str]]:
    """The run of non-ASCII characters start..end decoded as the UTF-8 it was, or the matched parts of it."""
    run = text[start:end]
    codecs = dict.fromkeys(read for _, _, of in hits for written, read in of if written == "utf-8")
    for codec in sorted(codecs, key=READ_AS.index):
        data = _bytes(run, codec)
        if not data:
            continue
        try:
            right = data.decode("utf-8")
        except UnicodeDecodeError as e:
            # Cut off by a lost character: what stands before it is whole.
            if text[end - 1] == "�" or not (codec in MULTIBYTE and e.reason == "unexpected end of data"):
                continue
            right = data[: e.start].decode("utf-8") + "�"
        if len(right) < len(data) and right != run and _fits(text, start, end, right, codec):
            return [(start, end, right)]
    # The run as a whole is no UTF-8: the matched sequences in it alone, whatever they touch.
    spans, at = [], -1
    for a, b, of in sorted(hits, key=lambda h: (h[0], -h[1])):
        read = [r for w, r in of if w == "utf-8" and r not in MULTIBYTE]
        if a >= at and read and not text[a:b].isalpha() and _visible(text[a]) and not _imitates(text, a, b, read[0]):  # letters alone may be a word
            spans.append((a, b, read[0]))
            at = b
    covered = sum(b - a for a, b, _ in spans)
    sure = spans and (covered >= 0.6 * (end - start) and len(spans) >= 2 or any(b - a >= 3 for a, b, _ in spans))
    out = []
    for a, b, codec in spans:
        data = _bytes(text[a:b], codec)
        right = data.decode("utf-8", "replace") if data else None
        if right and covered < 0.6 * (end - start) and all("㐀" <= c <= "鿿" for c in right):
            continue  # a lone ideograph beside what is no UTF-8
        if right and (sure or text[a] in "ÃÂ" and not text[b - 1].isspace() and text[b : b + 1].isalpha() and _fits(text, a, b, right, codec)):
            out.append((a, b, right))
    return out


def _visible(ch: str) -> bool:
    return not ch.isspace() and unicodedata.category(ch) != "Cf"


def _fits(text: str, start: int, end: int, right: str, codec: str) -> bool:
    """Whether ``right`` is likely in the place of text[start:end]."""
    if codec in MULTIBYTE:
        # A lone ideograph may well be one: it has to stand in text of another script.
        rest = text[:start] + text[end:]
        near = text[max(0, start - 1) : start] + text[end : end + 1]
        if len(right) > 2 or _KANA.search(right):
            return True
        return len(right) == 2 and not _KANA.search(text[start:end]) or bool(re.search("[A-Za-z]", near)) or not _KANA.search(rest) and not re.search("[一-鿿]{2}", rest) and bool(re.search("[A-Za-z]{2}", rest))
    if text[end - 1] in _CLOSING and _quoted(text[: end - 1], text[end - 1]):
        return False  # the sign closes a quotation
    if _imitates(text, start, end, codec) or not _visible(text[start]):
        return False
    if len(right) == 1 and text[end - 1] == "\xa0" and re.search(f"(?<!{re.escape(text[end - 2 : end - 1])})\xa0", text):
        return False  # such spaces are what this text has between words
    if len(right) == 1 and right.isupper() and text[:start][-1:].islower():
        return False  # a capital within a word
    if len(right) == 1 and right.islower():
        # Capitals all around and a small letter in the middle: the text is as it was meant.
        before = re.search(r"[^\W\d_]{2,}$", text[:start])
        if before and before[0].isupper():
            return False
    return True


#: Cyrillic letters that look like Latin ones.
_LOOK = "".join(x for x, _ in LOOKALIKES[:2])


def _imitates(text: str, start: int, end: int, codec: str) -> bool:
    """Whether the Cyrillic letters of text[start:end] are look-alikes, as are others in the text that aren't garbled."""
    look = lambda run: (letters := re.findall(r"[^\W\d_]", run)) and all(x in _LOOK for x in letters)
    if codec not in ("cp1251", "koi8-r", "cp866") or not look(text[start:end]):
        return False
    for m in _HIGH.finditer(text):
        if (m.end() <= start or m.start() >= end) and look(m[0]):
            try:
                (_bytes(m[0], codec) or b"\xff").decode("utf-8")
            except UnicodeDecodeError:
                return True
    return False


_CLOSING = {"”": "“„", "’": "‘‚", "»": "«", "«": "»", "“": "„", "›": "‹"}


def _quoted(before: str, closing: str) -> bool:
    """Whether a quotation that ``closing`` ends was opened at the start of a word and not closed yet."""
    opened = [m.end() for m in re.finditer(rf"(?:^|(?<=[\s(\[])) ?[{_CLOSING[closing]}]", before)]
    return bool(opened) and closing not in before[opened[-1] :]


def _japanese(text: str, pair: tuple[str, str], hits: list) -> list[tuple[int, int, str]]:
    edits, own = [], [(a, b) for a, b, of in hits if pair in of]
    for m in re.finditer(r"[^\x00-\x7f](?:[^\s]*[^\x00-\x7f])?[\x40-\x7e]?", text):
        if not any(m.start() < b and a < m.end() for a, b in own):
            continue
        for end in (m.end(), m.end() - 1):
            data = _bytes(text[m.start() : end], pair[1])
            try:
                right = data.decode(pair[0]) if data else ""
            except UnicodeDecodeError:
                continue
            if len(_KANA.findall(right)) + len(re.findall("[一-鿿]", right)) >= max(3 if re.search("[A-Za-z]", right) else 2, len(right) // 2) and _KANA.search(right):
                edits.append((m.start(), end, right))
                break
    return edits


def _matched(text: str, words: list[Edit], own: list[tuple[int, int]]) -> list[Edit]:
    """Those of ``words`` in which a sequence matches, and those that only such words enclose: none but signs, figures
    and space stand between, or between them and the end of the text."""
    sure = [any(a < b2 and a2 < b for a2, b2 in own) for a, b, _ in words]
    out: list[Edit] = []
    for i, word in enumerate(words):
        if not sure[i]:
            left = next((words[j][1] for j in range(i - 1, -1, -1) if sure[j]), None)
            right = next((words[j][0] for j in range(i + 1, len(words)) if sure[j]), None)
            before = text[0 if left is None else left : word[0]]
            behind = text[word[1] : len(text) if right is None else right]
            if left is None and right is None or re.search("[A-Za-z]", before) or re.search("[A-Za-z]", behind):
                continue
        out.append(word)
    return out


class _View:
    """The words of a text that have no Latin letter of ASCII, the script they stand in, and how likely they are in it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words, stood = [], []
        for m in _HIGH.finditer(text):
            a, b = m.span()
            if _ascii_letter(text[a - 1 : a]) or _ascii_letter(text[b : b + 1]):
                continue  # within a Latin word
            self.words.append((a, b, m[0]))
            if not m[0].isalpha():
                shown = "".join(c for c in unicodedata.normalize("NFKC", m[0]) if not c.isascii() and not c.isspace() and unicodedata.category(c) not in ("Cf", "Mn", "Pd", "Pi", "Pf", "Po", "Ps", "Nd"))
                stood.append(shown if any(map(str.isalpha, m[0])) else "")
            else:
                stood.append("".join(c for c in unicodedata.normalize("NFKC", m[0]) if not c.isascii()))
        self.as_is = " ".join(filter(None, stood))
        size = len(self.as_is.replace(" ", ""))
        self.stands = next((x for x in SCRIPTS if x.count(self.as_is) >= 0.8 * size), None) if size else None
        self.before = self.stands.score(self.as_is) if self.stands else 0.0
        #: Text that is likely as it stands is left alone.
        self.doubtful = bool(self.words) and (self.stands is None or self.before < 0.25 or bool(codepages.NEVER[self.stands.name].search(self.as_is.lower())) or bool(_INVERTED.search(text)))


def _ascii_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _script_edits(view: _View, script: Script, pair: tuple[str, str], hits: list[Hit]) -> list[Edit]:
    """Words that aren't likely as they stand and are words of ``script`` when restored."""
    text, stands, before = view.text, view.stands, view.before
    own = [(a, b) for a, b, of in hits if pair in of]
    words = []
    for a, b, word in view.words:
        data = codepages.encoded(word, pair[1])
        right = codepages.decoded(data, pair[0]) if data else ""
        if script.only.fullmatch(right):
            words.append((a, b, right))
    words = _matched(text, words, own)
    new = " ".join(x for _, _, x in words)
    letters = script.count(new)
    if not words or any(a.islower() and b.isupper() for a, b in zip(new, new[1:], strict=False)):
        return []
    after = script.score(new)
    if stands is None:
        # Words of nothing but accented letters and signs, at least one of three.
        return words if letters >= 4 and any(sum(map(_visible, text[a:b])) >= max(2, 0.6 * (b - a)) and script.three.search(x) and script.score(x) >= 0.25 for a, b, x in words) else []
    if stands is RUSSIAN and script is RUSSIAN:
        a = " ".join(text[x:y] for x, y, _ in words)
        if letters >= 4 and RUSSIAN_NEVER.search(a.lower()) and not RUSSIAN_NEVER.search(new.lower()) and after >= 0.3 or _INVERTED.search(text) and after >= 0.2:
            return words
    if stands is not script:  # one script in the place of another: only if no word is likely as it stands
        return words if letters >= 4 and before < 0.2 and after >= 0.5 and codepages.NEVER[stands.name].search(view.as_is.lower()) and not codepages.NEVER[script.name].search(new.lower()) else []
    return words if letters >= 4 and before < 0.25 and after >= max(0.34, 1.5 * before) else []


def sign_pairs() -> list[tuple[tuple[str, str], str]]:
    """For each pair of single-byte encodings what signs behind figures become, if that is no sign and no word."""
    out = []
    for w in dict.fromkeys(x for of in (codepages.WESTERN, codepages.CENTRAL, codepages.TURKISH, RUSSIAN.written, GREEK.written) for x in of):
        for r in codepages.READ:
            signs = "".join(bad for sign in SIGNS if (bad := codepages.garbled(sign, w, r)) and bad != sign and (unicodedata.category(bad) in ("Sk", "Lm") or bad in "њЊџЏћЋђЂљЉ"))
            if r != w and signs:
                out.append(((w, r), signs))
    return out


def _signs(text: str, hits: list[Hit]) -> list[Edit]:
    """Signs behind figures, where all pairs that match agree: a degree before its scale, another before no letter."""
    meant: dict[tuple[int, int], set[str]] = {}
    for a, b, of in hits:
        if b - a == 3 and text[a].isdigit() and text[a + 1] == " ":
            for w, r in of:
                if w == "utf-8":
                    continue
                right = codepages.decoded(codepages.encoded(text[b - 1], r) or b"?", w)
                if right == "°" and re.match(r"[CF]\b", text[b:]) or right == "€" and not text[b : b + 1].isalpha():
                    meant.setdefault((b - 1, b), set()).add(right)
    return [(a, b, next(iter(signs))) for (a, b), signs in meant.items() if len(signs) == 1]


_POLISH_SYMBOL = re.compile("(?<=[A-Za-zó])[±³¶¼¿¹£¦¬¯](?=[A-Za-zóêæñ])|(?<![\\w±³¶¼¿])[³¶¼¦¯¹](?=[a-zó]{2})|(?<=[a-z]{2})[±¹³¶](?![\\w])|(?<=[a-z])[±¶](?!\\w)")
_UNIT = re.compile("(?<![A-Za-z])(?:[kcdm]?m|ft|in|yd)[¹²³]")
_POLISH_LETTERS = "".maketrans("", "", "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ")


def _polish(text: str, pair: tuple[str, str], hits: list) -> list[tuple[int, int, str]]:
    """Signs inside of words, or letters in places where only Polish has the letters they stand for."""
    plain = _UNIT.sub("", text)
    sure = bool(_POLISH_SYMBOL.search(plain))
    if not sure:
        other = re.search("[àèéîôûâçãõäöüßíáúë]", text)
        own = [text[a:b] for a, b, of in hits if pair in of]
        sure = bool(own) and not other and _polish_likely(text, pair)
    if not sure:
        return []
    own = [(a, b) for a, b, of in hits if pair in of]
    words, others = [], False
    for m in re.finditer(r"[^\W_\d]*[^\x00-\x7f][^\s\x00-\x40]*", text):
        data = _bytes(m[0], pair[1])
        right = data.decode(pair[0], "replace") if data else m[0]
        if not re.search("[A-Za-z]", right) or not right.translate(_POLISH_LETTERS).isascii():
            others |= any(map(str.isalpha, m[0]))
        elif right != m[0]:
            words.append((m.start(), m.end(), right))
    edited = {(a, b) for a, b, _ in words}
    if any(codepages.odd(m[0])[1] for m in re.finditer(r"[^\W_\d]*[^\x00-\x7f][^\s\x00-\x40]*", text) if m.span() not in edited):
        return []  # what is wrong there, this pair doesn't explain
    sure = [any(a < y and x < b for x, y in own) for a, b, _ in words]
    # Words without a match only where all words of the text are Polish, or between matched ones.
    return [w for i, w in enumerate(words) if sure[i] or not others or any(sure[:i]) and any(sure[i:])]


def _polish_likely(text: str, pair: tuple[str, str]) -> bool:
    data = _bytes(text, pair[1])
    right = data.decode(pair[0], "replace") if data else ""
    return bool(right) and not re.search("[^\x00-\x7fąćęłńóśźżĄĆĘŁŃÓŚŹŻ–’„”…°№ ]", right) and bool(re.search("|".join(POLISH_PAIRS), right.lower()))


_MEMO_LIMIT = 200_000


def _flagged(batches: Iterator[pa.RecordBatch], keep_all: bool) -> Iterator[pa.RecordBatch]:
    memo: dict[str | None, tuple[bool, str | None]] = {}
    for batch in batches:
        values = batch.column("value").to_pylist()
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        out = []
        for value in values:
            if (got := memo.get(value)) is None:
                got = memo[value] = restore(value)
            out.append(got)
        bad = pa.array([x for x, _ in out], pa.bool_())
        table = pa.RecordBatch.from_arrays([*batch.columns, bad, pa.array([x for _, x in out], pa.string())], [*batch.schema.names, "garbled", "restored"])
        yield table if keep_all else table.filter(bad)


def repaired(values: DataFrame) -> DataFrame:
    """``values``, which has a text column ``value``, with ``garbled`` (boolean) and ``restored`` (text).

    No shuffle. A value that isn't garbled is restored to itself, null to null. Columns of these names are replaced.
    """
    values = values.drop("garbled", "restored")
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in values.schema)
    return values.mapInArrow(lambda b: _flagged(b, True), f"{schema}, garbled boolean, restored string")


def garbled(values: DataFrame) -> DataFrame:
    """The rows of ``values`` whose ``value`` is garbled, with ``restored``. Plain ASCII values don't reach Python.

    Columns named garbled or restored are replaced.
    """
    values = values.drop("garbled", "restored")
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in values.schema)
    high = values.where(r"value rlike '[^\\x00-\\x7F]'")
    return high.mapInArrow(lambda b: _flagged(b, False), f"{schema}, garbled boolean, restored string").drop("garbled")
