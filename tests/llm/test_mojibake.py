import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from spandrel.llm import codepages, mojibake
from spandrel.llm.mojibake import restore

GOOD = ["Öffnungszeiten für Gäste – Küche", "Élèves près de l’été, n° 3", "Łódź: święta i żaglówki", "Проверено читателями в прошлом году", "古い船の作り方 第12回", "Señores y años – 20 €"]
PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp1250"), ("utf-8", "cp1251")]


def garble(text, written="utf-8", read="cp1252"):
    return mojibake._read(text.encode(written), read)


@pytest.mark.parametrize("pair", PAIRS)
@pytest.mark.parametrize("text", GOOD)
def test_restored(text, pair):
    assert restore(garble(text, *pair)) == (True, text)


@pytest.mark.parametrize("text", GOOD[:4])
def test_restored_twice(text):
    assert restore(garble(garble(text))) == (True, text)


@pytest.mark.parametrize("text", GOOD[:2] + GOOD[3:4])
def test_multibyte(text):
    bad = text.replace("–", "-").replace("’", "'").encode("utf-8").decode("gb18030", "ignore")
    assert restore(bad)[0]


def test_single_byte_pairs():
    for text, written, read in (("Проверено читателями", "cp1251", "cp1252"), ("Проверено читателями", "koi8-r", "cp1251"), ("книги на берегу", "koi8-r", "cp1251"), ("Świeże jabłka od źródła", "iso8859-2", "cp1252"), ("Więcej gałęzi, książki", "cp1250", "cp1252"), ("長い庭園と家族", "cp932", "cp1252")):
        assert restore(garble(text, written, read)) == (True, text)


@pytest.mark.parametrize("text", [*GOOD, *map(str.upper, GOOD), "IRMÃ – AVÓ", "«MAÇÃ»", "INSCRIÇÃO E INFORMAÇÃO", "Ã: a letra com til", "√ Done", "20 °C, 3 × 5, CO₂ ½", "¿Quiénes somos?", "¡Hola!", "60 m³ и 20 m²", "Ёлка и ъ", "Pêcheurs secrets en pleine mer", "Nо. 1: thе rеаdеr’ѕ", "Дальние тропы (1505) | Віrсhlоw", "Еѕcrito pоr lectores", "thе\xa0neighbours", "Â\xa0is a letter\xa0too", "\xads ég\xadrés \xadde\xad, \xad \xadn\xad°\xad \xad1\xad61\xad.", "fo\xadrêt\xad,\xad\xa0\xadn\xad°\xad \xad1\xad61\xad", "аftеr thе\xa0rаіn", "Różnе\xa0gаłęzіе z łąkі", "Banos con azucar", "第3枚", "全角ＡＢＣ講座", "½ Maß", "Čia žaliųjų miškų šešėlis, ąžuolas ir ėglis", "Ģimenes šķērsiela, ļoti vēls ūdens", "Škoda a Citroën", "Łódź – Élysée – Żabka", "Ærø og Øresund", "Тихі вечори, їжа", "Ђурђевак џем", "Tiếng Việt và phở", "Dŵr y môr a’r tŷ", "Það er ný öld á Íslandi", "I ♥ NY 🎉", "AVÓ, IRMÃ\xa0E “MANHÃ”"])
def test_meant_as_they_are(text):
    assert restore(text) == (False, text)


def test_partly_garbled():
    text = "Große Grüße gegen KÃ¤lte (1086) â€“ Eldermoss"
    assert restore(text) == (True, "Große Grüße gegen Kälte (1086) – Eldermoss")


def test_lost_letters_are_cases():
    assert restore("Gr�ne W�lder") == (True, "Gr�ne W�lder")
    assert restore("caf\x82")[0]
    assert restore("Fr枚hliche D枚rfer 鈥�")[1].startswith("Fröhliche Dörfer")


def test_nothing_blank_and_long():
    assert [restore(x) for x in (None, "", "  ", "plain")] == [(False, None), (False, ""), (False, "  "), (False, "plain")]
    long = "Öffnungszeiten " * 20_000
    assert restore(garble(long)) == (True, long)
    assert restore(long) == (False, long)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.from_regex("[a-h]{2,5}[äöüßéèà]{0,2}[a-h]{1,3}", fullmatch=True), min_size=1, max_size=5).map(" ".join))
def test_round_trip(text):
    assume(not text.isascii())
    assert restore(garble(text)) == (True, text)
    assert restore(text) == (False, text)


def test_frames(spark):
    df = spark.createDataFrame([(1, "Ã©tÃ©"), (2, "été"), (3, None), (4, ""), (5, "plain"), (6, "Ã©tÃ©")], "id bigint, value string").selectExpr("*", "'x' as restored", "true as garbled")
    assert {(r.id, r.restored) for r in mojibake.garbled(df).collect()} == {(1, "été"), (6, "été")}
    assert {r.id: (r.garbled, r.restored) for r in mojibake.repaired(df).collect()} == {1: (True, "été"), 2: (False, "été"), 3: (False, None), 4: (False, ""), 5: (False, "plain"), 6: (True, "été")}
    assert mojibake.garbled(df.limit(0)).count() == 0


SAMPLES = {"ru": "Проверено читателями в прошлом году", "el": "Οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy", "tr": "Bütün insanlar özgür doğar, akıl ve vicdan sahibidirler, kardeşçe yaşar", "pl": "Więcej gałęzi, książki i świeże jabłka", "fr": "Élèves près de la forêt, goûter à l'été, garçon", "de": "Öffnungszeiten für Gäste, Grüße aus der Küche", "es": "Señores y años, corazón de niño, pingüino"}
RIGHT = ["Tous à l’été, très tôt", "Książki i gałęzie", "Οι άνθρωποι και η θάλασσα", "Северные мосты и реки", "£5 ±3 € 20 °C", "Käse und Brot", "古い船"]


def single_byte_pairs(language):
    written = {"ru": codepages.RUSSIAN.written, "el": codepages.GREEK.written}.get(language) or codepages.LATIN[language][1]
    for w in written:
        for r in codepages.READ:
            bad = codepages.garbled(SAMPLES[language], w, r)
            if w != r and bad is not None and bad != SAMPLES[language]:
                yield w, r, bad


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_all_single_byte_pairs(language):
    """Every pair's result is found but where letters are lost or both are letters of Greek and Russian; most are restored."""
    assert restore(SAMPLES[language]) == (False, SAMPLES[language])
    got = [(w, r, restore(bad)) for w, r, bad in single_byte_pairs(language)]
    windows = [x for x in got if not codepages.RARE & set(x[:2]) and "cp866" not in x[:2] and not {"cp1253", "iso8859-7"} & set(x[:2]) - set(codepages.GREEK.written if language == "el" else ())]
    assert sum(found for _, _, (found, _) in got) >= 0.9 * len(got)
    assert sum(text == SAMPLES[language] for _, _, (_, text) in got) >= 0.7 * len(got)
    assert sum(text == SAMPLES[language] for _, _, (_, text) in windows) >= 0.7 * len(windows)


@pytest.mark.parametrize("pair", [("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1252"), ("pl", "cp1250", "cp1252"), ("el", "cp1253", "cp1252"), ("cs", "cp1250", "cp1252"), ("tr", "cp1254", "cp1252")])
@pytest.mark.parametrize("right", RIGHT)
def test_text_outside_of_matches_stays(pair, right):
    """Whatever is beside it, correct text comes back byte for byte; where it makes the case undecidable, so does all."""
    language, written, read = pair
    for text in (right + " / " + codepages.garbled(SAMPLES[language], written, read), codepages.garbled(SAMPLES[language], written, read) + " / " + right):
        _, now = restore(text)
        assert right in now


def test_utf8_beside_correct_letters():
    assert restore("café Ã©à") == (True, "café éà")


def test_two_restorations_leave_the_text():
    assert restore("Käse crème") == (False, "Käse crème")
    found, edits = codepages.latin_edits("SeĄores y aĄos, corazón")
    assert found and edits == []
