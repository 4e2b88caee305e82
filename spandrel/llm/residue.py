"""Values that stand in for content: unfilled placeholders, filler, and messages of servers, programs and gates.

Two kinds of evidence are summed. What a value says by itself: placeholder syntax and filler are detected anywhere in
it and decide alone; of a message, the register of its words is weighed (see register: 1, 0.5 or 0). What the hosts say:
the same words on several hosts (their names and figures aside), on pages whose address, title and body terms disagree
with them, made of terms of low information, which nearly never recur in the other texts of their pages. A message is
a case from a weight of 1 on. So the register decides alone only where a value has no other words; what is half of it,
or is in a language of which no words are known here, needs the hosts.
Patterns are held against the consistent form of a value (see glyphs), so odd characters hide nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.batches import slices
from spandrel.llm.glyphs import same_look
from spandrel.llm.register import weights
from spandrel.tables import settle

# Names that templates give to their fields.
FIELD_NAMES = "title page headline heading h1 h2 name sitename site company category product item post seo meta description desc content intro label keyword keywords brand author tag date price city location url slug text summary subtitle excerpt".split()
# The customary filler text.
FILLER_TEXT = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum".split()
LOREM = [w for w in dict.fromkeys(FILLER_TEXT) if w != "in"]
# Placeholder syntax of template languages; {id} stands for a field's name.
PLACEHOLDERS = (
    r"\{\{\{?[^{}]+\}?\}\}",
    r"[$#]\{[^{}]+\}",
    r"<%[=-]?[^%<>]+%>",
    r"<\?(?:php|=)[^?]+\?>",
    r"\{%[^%{}]+%\}",
    r"%%[a-z][\w.]*%%",
    r"@@[a-z][\w.]*@@",
    r"(?:^|[^\pL\pN_])__[a-z][\w.]*?__(?:[^\pL\pN_]|$)",
    r"\[\[[^\[\]]+\]\]",
    r"\{[a-z][\w.]*\}",
    r"\[(?:{id})(?:[_. -]?\w+)*\]",
    r"\[\w+[_.]\w[\w.]*\]",
    r"\[(?:insert|enter|your|add|put|placeholder|replace)\b[^\[\]]*\]",
    r"(?:^|[^%\pL\pN_])%(?:\d\$)?[sd](?:[^\pL\pN_]|$)",
    r"\{\d\}",
    r"\[object object\]",
)
# Filler that was never replaced, as all of a value.
FILLER = (
    r"(?:asdf|qwer|qwerty|foo|bar|blah|bla|test|text|xxx+|tbd|todo|title|dummy)(?:[ ,.-]+(?:asdf|qwer|qwerty|foo|bar|blah|bla|test|text|xxx+|tbd|todo|dummy))+",
    rf"(?:(?:{'|'.join(LOREM)})[ ,.…]+)*(?:{'|'.join(w for w in LOREM if len(w) > 4)})[ ,.…]+(?:{'|'.join(LOREM)})(?:[ ,.…]+(?:{'|'.join(LOREM)}))*|(?:{'|'.join(LOREM)})[ ,.…]+(?:(?:{'|'.join(LOREM)})[ ,.…]+)*(?:{'|'.join(w for w in LOREM if len(w) > 4)})",
    r"x{3,}|tbd|todo|asdf(?:gh)?|n/a|test ?\d*|foo ?bar",
    r"(?:undefined|null|nan|none|nil)(?:[ |:–—-]+(?:undefined|null|nan|none|nil))*",
    r"untitled(?: (?:document|page|\d+))*|unbenannt(?:es dokument)?|sans titre|sin título|sem título|bez tytułu|без названия|無題",
    r"(?:sample|new|example|default|blank|test|demo) (?:page|title|post|document|heading|description|text|headline)(?: ?\(?\d+\)?)?",
    r"(?:your|the|page|my)? ?(?:meta )?(?:title|headline|heading|description|text|content|copy|tagline|name) (?:goes )?here(?: ?\(max\.? \d+ char\w*\))?",
    r"(?:insert|enter|add|type|write|put|edit|replace)(?: (?:your|the|a|page|this|some))* (?:short |meta |brief )*(?:title|headline|heading|description|text|content|copy|summary)\b.*",
    r"(?:title|headline|heading|text|description|content|copy) placeholder|placeholder(?: (?:title|text|headline|heading|copy|description|page|content))?(?:,? (?:to be|tbc|tbd).*)?",
    r"this is (?:a|the) (?:placeholder|sample|dummy|default) (?:title|text|description|page|heading|copy)\b.*",
    r"(?:meta |page |seo )?(?:title|description|heading) \(max\.? \d+ \w+\)",
    r"(?:todo|tbd|fixme):? (?:write|add|fill|insert|replace|title|description|text|heading|headline|content|copy|summary|meta)\b.*|(?:todo|tbd|fixme): .*",
    r"(?:default|sample|example|dummy) (?:title|headline|heading|description|text|page|content|summary) (?:for|of) .*",
    r"just another (?:\w+ )?(?:site|blog|website|page)(?: \w+)?",
    r"(?:titel|überschrift|beschreibung|text|inhalt)(?: bitte)? hier (?:eingeben|einfügen|einsetzen)",
    r"hier (?:könnte|steht|kommt|folgt) .*(?:titel|überschrift|beschreibung|text|inhalt)\b.*",
    r"(?:titre|description|texte|contenu) à (?:compléter|remplir|définir|remplacer)",
    r"(?:insérez|saisissez|entrez|ajoutez) (?:votre|le|un) (?:texte|titre|contenu|description) ici",
    r"(?:inserte|escriba|introduzca|ingrese|añada) (?:su|el|un|aquí)\b.*|(?:título|texto|descripción) (?:aquí|de ejemplo|de prueba)",
    r"(?:insira|digite|escreva|adicione) (?:o|seu|um|aqui)\b.*|(?:título|texto|descrição) (?:aqui|de exemplo)",
    r"(?:wpisz|wstaw|dodaj|wprowadź) (?:tytuł|tekst|opis|nagłówek)\b.*|(?:tytuł|opis|tekst) (?:tutaj|zastępczy)",
    r"(?:введите|вставьте|добавьте) (?:заголовок|текст|описание|название)\b.*|(?:заголовок|описание|текст) (?:здесь|по умолчанию)",
    r"(?:ここに)?(?:タイトル|見出し|説明|本文|テキスト)を?(?:入力|挿入)(?:してください)?|ダミーテキスト.*",
)
# Messages without a thing and its state, as all of a value, and what programs write.
MESSAGES = (
    r"just a moment ?(?:\.\.\.|…|\.)?|attention required!?|one more step|please wait|are you (?:a )?(?:human|robot)\??|security check",
    r"(?:error )?(?:not found|forbidden|unauthori[sz]ed|bad gateway|bad request|service unavailable|access denied|too many requests)",
    r"(?:oops|sorry)?[!, ]*(?:something|that) (?:went|has gone) wrong\b.*",
    r"you (?:don[’']t|do not) have (?:the )?(?:permissions?|access|rights?)\b.*",
    r"(?:under (?:construction|maintenance)|coming soon|site offline|index of /.*|it works!|welcome to nginx!?|account suspended)",
    r"traceback \(most recent call last\).*|(?:fatal error|parse error|warning|notice|deprecated): .* in /\S+(?: on line \d+|:\d+)",
    r"(?:application|server|runtime|script) error(?::| [–—-]) an? \S+ exception has occurred.*",
)
#: Hosts a value must stand on, the highest share of its terms' occurrences that recur on their pages, and the least share
#: of its rows on pages that disagree, for the hosts to be evidence.
MIN_HOSTS, MAX_RECURRING, MIN_DISAGREEING = 3, 0.4, 0.5
#: A letter, figure or underscore of any script.
LETTER = r"[\pL\pN_]"


def _alike(pattern: str) -> str:
    """``pattern``, written in small letters, in the consistent form of the values, with words of any script."""
    pattern = pattern if pattern.isascii() else same_look(pa.array([pattern]))[0].as_py()
    return pattern.replace(r"\b.*", r"(?:[^\pL\pN_].*)?").replace(r"[\w", r"[\pL\pN_").replace(r"\w", LETTER)


def _runs() -> list[str]:
    """All three words in a row of the filler text, also where it is shortened or starts again."""
    short = [w for i, w in enumerate(FILLER_TEXT[: FILLER_TEXT.index("duis")]) if not 19 <= i < 24 and not (w == "ut" and i > 24)]
    return sorted({" ".join((text * 2)[i : i + 3]) for text in (FILLER_TEXT, short) for i in range(len(text))})


def _lorem() -> str:
    """The runs of filler words as a pattern, those with the same first letter together."""
    by_letter: dict[str, list[str]] = {}
    for run in _runs():
        by_letter.setdefault(run[0], []).append(run[1:].replace(" ", r"[ ,.…]+"))
    return r"(?:^|[^\pL\pN_])(?:" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items()) + r")(?:[^\pL\pN_]|$)|^[^\pL\pN_]*lorem ipsum[^\pL\pN_]*$"


def placeholders() -> str:
    return "|".join(_alike(x.replace("{id}", "|".join(FIELD_NAMES))) for x in PLACEHOLDERS)


def whole(patterns: tuple[str, ...]) -> str:
    """A pattern of ``patterns`` as all of a value, but for a site's name after or before it."""
    body = "|".join(_alike(x) for x in patterns)
    word = r"[@.\pL\pN_-]+"
    return rf"^[\s\"'“”«»*>.…-]*(?:{word}(?: {word}){{0,2}} [|–—-] )?(?:{body})[.!…。]*(?:\s*(?:[|–—·]|\s-\s)\s*{word}(?: {word}){{0,2}})?[\s\"'“”«»*<.]*$"


@functools.cache
def _detectors() -> tuple[tuple[str, str], ...]:
    return ("placeholder", placeholders()), ("filler", _lorem()), ("filler", whole(FILLER))


def judged(forms: pa.Array) -> tuple[pa.Array, pa.Array]:
    """What is detected in each value (placeholder, filler or nothing), of which these are the consistent forms in small
    letters, and its weight as a message by its own words. The time is linear in the length of the texts."""
    text = pc.fill_null(forms.cast(pa.string()), "")
    found = pa.nulls(len(text), pa.string())
    for name, pattern in reversed(_detectors()):
        found = pc.if_else(pc.match_substring_regex(text, pattern), name, found)
    phrase = pc.match_substring_regex(text, whole(MESSAGES)).to_numpy(zero_copy_only=False)
    return found, pa.array(np.where(phrase, 1.0, weights(text)))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda x: (F.length(x) >= 3) | (F.length(x) >= 2) & (F.octet_length(x) > F.length(x)))


def _agrees(terms: Column, page: Column) -> Column:
    """Whether three of the terms, or over half of them, are the page's; null if there is nothing to compare."""
    shared = F.size(F.array_intersect(terms, page))
    return F.when((F.size(terms) > 0) & (F.size(page) > 0), (shared >= 3) | (shared * 2 > F.size(terms)))


def stand_ins(values: DataFrame, *also: str, bodies: DataFrame | None = None) -> DataFrame:
    """(page_id, field, source) of every value that stands in for content, and the columns ``also``.

    ``values`` has page_id, site, url, field, value and others (the page's other texts, for its terms); a list is one row
    per element. ``bodies`` (page_id, text) are texts of the pages; they are read for the few values that only the hosts
    speak against. ``source`` is placeholder or filler, message where the register of the words decides alone, message and
    hosts where both do, and hosts where these decide. Null, empty and blank values are never listed; neither are
    values about such things. A null site or url gives no evidence. Nothing is decided by the status of the page.
    """
    # A site's own name says nothing, and would hide that sites show the same.
    host = F.lower(F.coalesce("site", F.lit("")))
    name = F.regexp_extract(host, r"([^.]+)\.[^.]+$", 1)
    low = F.when(F.length(host) >= 4, F.replace(F.lower("value"), host, F.lit("@"))).otherwise(F.lower("value"))
    slug = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/]*/(.*)", 1)
    shown = values.where("value is not null").withColumn("_low", F.when(F.length(name) >= 4, F.replace(low, name, F.lit("@"))).otherwise(low))
    terms_of = lambda df: df.withColumn("_terms", F.array_distinct(_terms(F.col("_low")))).withColumn("_page", F.array_distinct(F.concat(_terms(F.col("others")), _terms(slug))))
    # How often a term recurs in the other texts of its pages: what content is made of does, messages hardly.
    recurring = terms_of(shown).where("size(_page) > 0").select(F.explode(F.transform("_terms", lambda t: F.struct(t.alias("term"), F.array_contains("_page", t).alias("again")))).alias("x")).groupBy("x.term").agg(F.avg(F.col("x.again").cast("double")).alias("again"))
    small = shown.select("page_id", "site", "field", *also, "_low", "others", "url")
    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in small.schema)
    opened = terms_of(small.mapInArrow(_open, f"{kept}, _form string, _found string, _weight double, _plain boolean"))
    # Few rows are left: they are written down, so that texts are looked at once.
    left = settle(opened.select("page_id", "site", "field", *also, "_form", "_found", "_weight", "_plain", "_terms", _agrees(F.col("_terms"), F.col("_page")).alias("_agrees")))
    # Words alike on several hosts, names of hosts and numbers aside, on pages that speak of something else.
    alike = F.regexp_replace(F.regexp_replace("_form", r"[a-z0-9@-]+(?:\.[a-z0-9@-]+)+", "@"), r"\d+", "#")
    weighed = left.where("_found is null").withColumn("_key", alike)
    # Rows stored with odd characters, whose terms can't be compared, follow those that aren't.
    by_host = weighed.groupBy("_key", "site").agg(F.count_if("_plain").alias("plain"), F.count_if(F.col("_plain") & ~F.col("_agrees")).alias("m"), F.first(F.when(F.col("_plain"), F.col("_terms")), True).alias("_terms"))
    spread = by_host.groupBy("_key").agg(F.count("site").alias("hosts"), F.sum("plain").alias("n"), F.sum("m").alias("m"), F.first("_terms", True).alias("_terms")).where((F.col("hosts") >= MIN_HOSTS) & (F.col("n") > 0) & (F.col("m") >= F.col("n") * MIN_DISAGREEING))
    of_key = spread.select("_key", F.explode("_terms").alias("term")).join(recurring, "term", "left")
    evidence = of_key.groupBy("_key").agg(F.avg(F.coalesce("again", F.lit(0.0))).alias("again")).where(F.col("again") <= MAX_RECURRING).select("_key", F.lit(True).alias("_backed"))
    both = weighed.join(evidence, "_key", "left").where((F.col("_weight") >= 1) | F.col("_backed") & ~F.coalesce("_agrees", F.lit(False)))
    source = F.when(F.col("_weight") < 1, "hosts").when(F.col("_backed"), "message and hosts").otherwise("message")
    cases = both.withColumn("source", source)
    if bodies is not None:
        cases = settle(cases)
        doubtful = cases.where("source = 'hosts'").select("page_id", "_key", "_terms").dropDuplicates(["page_id", "_key"])
        read = bodies.select("page_id", F.col("text").alias("_text")).join(doubtful, "page_id").where(_agrees(F.col("_terms"), F.array_distinct(_terms(F.col("_text"))))).select("page_id", "_key", F.lit("hosts").alias("source"))
        cases = cases.join(read, ["page_id", "_key", "source"], "left_anti")
    detected = left.where("_found is not null").select("page_id", "field", F.col("_found").alias("source"), *also)
    return detected.unionByName(cases.select("page_id", "field", "source", *also))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are or may be cases, with form, what is detected and weight."""
    for batch in batches:
        for part in slices(batch, "_low"):
            low = part.column("_low")
            form = same_look(low).cast(pa.string())
            found, weight = judged(form)
            plain = pc.equal(pc.replace_substring_regex(low, r"\s+", ""), pc.replace_substring(form, " ", ""))
            out = pa.RecordBatch.from_arrays([*part.columns, form, found, weight, plain], [*part.schema.names, "_form", "_found", "_weight", "_plain"])
            shows = pc.and_(pc.greater(pc.binary_length(form), 0), pc.or_(pc.is_valid(found), pc.greater(weight, 0)))
            yield out.filter(shows)


def judge(text: str | None) -> tuple[str | None, float]:
    """What is detected in one value and its weight as a message, for tests and small uses; (None, 0) for None and blank."""
    form = same_look(pa.array([text.lower() if text is not None else None], pa.string()))
    found, weight = judged(form)
    return found[0].as_py(), weight[0].as_py()
