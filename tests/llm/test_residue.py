import pytest

from spandrel.llm.residue import judge as weighed
from spandrel.llm.residue import stand_ins


def judge(text):
    """Whether a value is a case by itself."""
    found, weight = weighed(text)
    return found is not None or weight >= 1


SCHEMA = "page_id bigint, site string, url string, field string, value string, others string"
CASES = """{{ page.title }} | Shop
{{{h1}}}
Buy ${COMPANY} online
#{title}
<%= meta.description %>
<?php echo $title; ?> Open boats
{% block title %}
%%sitename%% - x
@@category@@
__seo.title__ | Shop
[[product_name]]
Welcome to {company}
[title] | Amberfold
[seo_title]
[Insert title here]
Lorem ipsum dolor sit amet
Quiet boats – Lorem ipsum dolor sit …
LOREM IPSUM DOLOR SIT AMET CONSECTETUR
Magna aliqua quis nostrud exercitation.
undefined
undefined | shop.example
None - None
NaN
[object Object]
Untitled Document
Sample Page
New Page 7
Your title here
Description goes here.
Enter your meta description here (max 160 characters)
Page title (max 60 characters)
TODO: write description
Titel hier eingeben
Titre à compléter
Insérez votre texte ici
Test test test
xxx xxx xxx
Just another site description
Placeholder copy, to be supplied by client
This is a placeholder description. Replace it before launch.
404 Not Found
503 Service Temporarily Unavailable
Error: 1020
HTTP Error 400. The request is badly formed.
Page Not Found – shop.example
Oops! That page can’t be found.
The requested URL was not found on this server.
Seite nicht gefunden
Page introuvable – Erreur 404
Página no encontrada
Nie znaleziono strony
Страница не найдена
ページが見つかりません
Please enable JavaScript
JavaScript ist deaktiviert
ВКЛЮЧИТЕ JAVASCRIPT
You need to enable JavaScript to run this app.
shop.example does not work properly without JavaScript enabled. Please turn it on to continue.
Enable scripts to view shop.example
Your browser is not supported
Just a moment...
Checking your browser
Access denied
Request blocked
Traceback (most recent call last): KeyError: 'description'
Warning: Undefined variable $desc in /srv/app/view_3.php on line 3
Application error: a client-side exception has occurred
Error establishing a database connection
Sorry, something went wrong
This site can't be reached
Default description for shop.example
We couldn't find that page | shop.example
The page you requested could not be found on shop.example. Please check the address or go back to the start page.
You don't have permission to access this resource on shop.example.
Ｐａｇｅ ｎｏｔ ｆｏｕｎｄ
P​age nоt found""".split("\n")
OTHERS = """What a 404 error teaches us
Page not found? A case study
Template placeholders explained
JavaScript for beginners
Sample texts for type designers
Curly braces { and } explained
A short history of lorem ipsum in print
Why visitors enable JavaScript, and why some do not
Access denied: rights on shared drives
How to write a helpful 404 page
100% wool, 0% fuss
Undefined feelings, a poem
Test, test, and test again
Null island and other places
No. 404: Quiet boats in the valley
Seasonal kettles above the tree line, No. 12 | Hollowfen
500 recipes for small kitchens
Error-free bookkeeping for beginners
[video] Open boats
Élèves et ateliers
The sample page of our wallpaper book""".split("\n")


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert judge(text)


@pytest.mark.parametrize("text", OTHERS)
def test_content(text):
    assert not judge(text)


@pytest.mark.parametrize("text", [None, "", " 　", "​"])
def test_nothing_is_no_case(text):
    assert not judge(text)


# In languages of which no words are known, and spoken about.
HELD_OUT = {
    "it": ["Pagina non trovata", "Attiva JavaScript per continuare", "Accesso negato", "Si è verificato un errore"],
    "da": ["Siden blev ikke fundet", "Adgang nægtet", "Der opstod en fejl, prøv igen senere", "Din browser understøttes ikke"],
    "tr": ["Sayfa bulunamadı", "Erişim engellendi", "Lütfen JavaScript'i etkinleştirin", "Bir hata oluştu"],
    "zh": ["网页无法找到", "访问被拒绝", "请启用浏览器脚本", "服务器暂时不可用"],
    "cs": ["Stránka nenalezena", "Přístup odepřen", "Zapněte prosím JavaScript", "Došlo k neočekávané chybě"],
}
ABOUT_THEM = ["Warning: contents may surprise", "Notice: new opening hours for the museum", "Exception: the rule that proved it", "Fatal error: a memoir", "System error: a novel about office life", "The server is down the hall: meeting our archivist", "JavaScript for beginners", "Page not found? A case study"]


def planted(spark, texts):
    """``texts`` as headings of six hosts each, on pages about something else, beside pages whose texts agree."""
    nouns, views = "barns kettles looms choirs ferries gardens windmills archives".split(), "quay valley harbour island market river".split()
    rows, i = [], 0
    for text in texts:
        for h in range(6):
            i += 1
            own = f"{nouns[i % 8].capitalize()} by the old {views[h]}"
            rows += [(i, f"s{h}.example", f"https://s{h}.example/{nouns[i % 8]}", "h1_tags", text, own), (i, f"s{h}.example", f"https://s{h}.example/{nouns[i % 8]}", "title", own, text + " " + own)]
    return spark.createDataFrame(rows, SCHEMA)


def test_languages_without_words_are_found_by_their_hosts(spark):
    texts = [x for xs in HELD_OUT.values() for x in xs]
    found = planted(spark, texts).join(stand_ins(planted(spark, texts)), ["page_id", "field"], "left_semi").select("value").distinct().collect()
    assert len({r.value for r in found} & set(texts)) >= 0.9 * len(texts) and {r.value for r in found} <= set(texts)


def test_what_speaks_about_messages_is_content_on_any_number_of_hosts(spark):
    df = planted(spark, [*ABOUT_THEM, *(x for x in OTHERS if x not in ("Élèves et ateliers", "500 recipes for small kitchens", "[video] Open boats"))])  # without content of nothing else
    assert {r.value for r in df.join(stand_ins(df), ["page_id", "field"]).collect()} == set()


def test_bodies_that_agree(spark):
    df = planted(spark, ["Pagina non trovata"])
    bodies = spark.createDataFrame([(3, "La pagina non era stata trovata."), (4, "Kettles by the river"), (5, None)], "page_id bigint, text string")
    assert {r.page_id for r in stand_ins(df, bodies=bodies).collect()} == {1, 2, 4, 5, 6}


def test_messages_of_any_length(spark):
    assert judge("The requested page was not found on this server. " * 50) and judge("{{ " + "x" * 500 + " }}")


def test_long_texts_take_linear_time():
    assert not judge("boats and kettles " * 20_000)
    assert not judge("{" * 50_000)
    assert judge("test " * 50_000)
    assert judge("lorem ipsum " * 50_000)
    assert judge("boats " * 20_000 + "{{ title }}")




def test_detectors_and_host_evidence(spark):
    gate = "Browser session portal of"  # half of it are words of messages; its spread over hosts does the rest
    rows = [(i, f"s{i}", f"https://s{i}/boats-{i}", "title", f"{gate} s{i}.example", "Quiet boats by the quay") for i in range(8)]
    rows += [(20 + i, f"s{i}", f"https://s{i}/x", "title", "Browser games museum", "browser games museum opening") for i in range(8)]
    rows += [(40, "s1", None, "title", "404 Not Found", None), (41, None, None, "title", "Quiet boats", None), (42, "s1", "u", "title", None, None), (43, "s1", "u", "title", "", None), (44, "s1", "u", "title", "Error museum on one host", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as form", "2 as key", "3 as shown", "4 as n")
    assert {r.page_id for r in stand_ins(df).collect()} == {*range(8), 40}
    assert stand_ins(df.limit(0)).count() == 0
