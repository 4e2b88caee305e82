"""The register of messages: how much of a value consists of the words that servers, programs and gates speak with.

A message names a thing of the trade (a page, a server, a browser) and its state (not found, denied, required) and
little else. Each word is a *thing*, a *state*, an *error* (both at once), *filling* that says nothing by itself, or
*other*; a value is weighed by the share of things and states among its words of meaning. A whole batch is taken apart
at once and only its distinct words are looked up.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spandrel.llm.glyphs import same_look

OTHER, FILLING, THING, STATE, ERROR, GENRE = range(6)
# Words of messages by language; a star stands for any ending. Filling, then things, then states, then errors.
WORDS = {
    "": ("", "javascript js cookie cookies http https url html captcha", "", ""),
    "en": (
        "a an the of to in on this that these those it its is are was were be been has have had do does did can cannot could will would may must should not no and or but if for from with by as we you your i our us my they there here what which while so any some all only other than then also just more most into about up out new t s re ve ll d don couldn doesn isn aren won hasn wasn didn please sorry oops unfortunately try trying tried again later reload refresh return back go turn turned switch switched update upgrade contact continue see view open use using work works working properly correctly run running temporarily currently longer requested looking asked check start something went help without before after recent call last attempted following side test tests text texts sample samples placeholder placeholders template templates default title titles headline heading description null none",
        "page pages site website webpage file files address link resource document content contents server servers service system database connection network request requests response browser script scripts scripting ad ads blocker blockers access permission permissions account session code status client application app gateway host domain proxy administrator admin login object variable line entity method runtime",
        "found find exist exists missing available unavailable unable denied forbidden blocked restricted refused rejected disabled disable enabled enable activate required requires require needed needs need supported unsupported outdated expired failed fail failure invalid wrong occurred happened moved removed deleted gone down offline overloaded busy exceeded unauthorized unauthorised authorized allowed permitted bad badly formed internal fatal parse uncaught undefined unexpected unhandled unknown checking verifying verify load loaded displayed locate reached reach connect timed timeout time-out conflict acceptable implemented establishing traceback deprecated suspended maintenance log sign handling service off warning notice",
        "error errors exception typeerror keyerror valueerror",
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines und oder ist sind war wurde wurden wird werden nicht kein keine es sie ihr ihre ihren ihrem ihrer in im an auf zu zur zum für von vom mit ohne um bei nach aus dass diese dieser dieses diesen diesem wir sich kann können konnte hat haben bitte leider angefordert* gesucht* versuch* erneut später fortzufahren nutzen verwenden korrekt richtig funktionier*",
        "seite* website* webseite* datei* adresse* server* browser* anwendung* zugriff* zugang* berechtigung* verbindung* sitzung* anfrage*",
        "gefunden existier* verfügbar verweigert gesperrt blockiert deaktivier* aktivier* benötig* erforder* unterstützt abgelaufen fehlgeschlagen ungültig* aufgetreten verboten verschoben gelöscht entfernt ausgeschaltet überlastet erlauben erreichbar veraltet",
        "fehler*",
    ),
    "fr": (
        "le la les l un une des du de d et ou est sont a ont été être n ne pas plus ce cette ces votre vos vous nous il elle en à au aux pour par sur dans avec sans que qui se veuillez désolé désolés oups demandé* recherch* réessay* tard continuer fonctionn* correctement afficher utiliser merci besoin doit",
        "page* site* fichier* adresse* serveur* navigateur* application* accès connexion* session* demande requête*",
        "introuvable* trouvé* existe* disponible* indisponible* refusé* interdit* bloqué* désactivé* activé* activer activez autoris* requis* requiert nécessit* nécessaire* supporté* expiré* échoué* invalide* produite survenue déplacé* supprimé* obsolète*",
        "erreur*",
    ),
    "es": (
        "el la los las un una de del y o es son ha han sido no su sus tu este esta esto en al para por con sin que se lo favor sentimos solicitad* pudo podido puede debe intente* nuevo más tarde ver continuar usar funcion* correctamente",
        "página* sitio* archivo* servidor* navegador* aplicación acceso conexión sesión solicitud* permiso*",
        "encontra* existe* disponible* denegad* prohibid* bloquead* desactivad* deshabilit* activ* habilit* requier* requerid* necesari* caducad* expirad* fallid* inválid* ocurrido producido movid* eliminad* compatible* soportad*",
        "error errores",
    ),
    "pt": (
        "o a os as um uma de do da dos das e ou é são foi não seu sua este esta em no na para por com sem que se ao favor desculpe solicitad* tente novamente mais tarde ver continuar usar funcion* corretamente precisa",
        "página* site* ficheiro* arquivo* servidor* navegador* aplicação acesso conexão sessão pedido* permissão",
        "encontrad* existe* disponível negado proibido bloquead* desativad* desabilit* ativ* active habilit* requer* necessári* expirou expirad* falhou inválid* ocorreu movid* removid* excluíd* suportad*",
        "erro erros",
    ),
    "pl": (
        "i w z na do nie jest są się to ta ten tej tego te lub oraz dla po od za o aby by ze że twoja twój twoje został* proszę przepraszamy żądan* można korzystać skorzystać kontynuować później ponownie spróbuj* prawidłowo poprawnie ustawieni* obsług*",
        "stron* witryn* plik* adres* serwer* przeglądar* aplikacj* dostęp* połączeni* sesj* kod* uprawnie*",
        "znalezion* odnalezion* znaleźć istnieje niedostępn* zabronion* zablokowan* wyłączon* wyłącz włącz* uruchom aktywuj* wymag* obsługiw* wygas* nieprawidłow* wystąpił* przeniesion* usunięt* wyświetlić",
        "błąd błęd*",
    ),
    "ru": (
        "и в на с не по для из к у о от до или это этот эта этой этого вы вас ваш* вам мы был* быть пожалуйста извините запрошенн* запрашиваем* просмотр* работ* продолж* настройк* позже повтор* снова корректн*",
        "страниц* сайт* файл* адрес* сервер* браузер* приложени* доступ* соединени* сесси* запрос* код*",
        "найден* найти существует недоступ* запрещ* заблокирован* отключ* выключ* включ* требу* поддерж* истек* истёк* неверн* произошл* перемещ* удален* удалён* устарел*",
        "ошибк*",
    ),
}
# What Japanese messages are made of; states first.
JAPANESE_STATES = "見つかりません 存在しません できません 拒否 有効 無効 必要 発生 メンテナンス エラー".split()
JAPANESE = "ページ サイト ファイル サーバー ブラウザ アクセス リクエスト 接続 権限 お探し 指定 オン オフ 設定 利用 表示 現在 しばらく 再度 お試し この その は が を に の で も と して ください する した され れ ました でした ません ため 中 見る 見 閲覧 ご お".split()
# Words for kinds of texts and their readers; a text that names one speaks about its matter.
GENRES = frozenset(same_look(pa.array("explained history guide tutorial lesson lessons story stories poem poems novel memoir book books study studies review essay introduction tips beginners dummies museum exhibition film song interview workshop course glossary handbook geschichte anleitung ratgeber einführung roman histoire conseils débutants historia guía cuento principiantes história iniciantes historia poradnik wiersz история руководство стихи повесть".split())).to_pylist())
#: Questions, at the start or in the middle.
ASKS = rf"^(?:{'|'.join(same_look(pa.array('how why what when who where wie warum wer wann pourquoi comment quand cómo cuándo como porque jak dlaczego kiedy как почему зачем'.split())).to_pylist())})\b|[?？]\s*[\pL\pN]"
#: Share of words of a language for it to be recognised, and of things and states for a value to be likely a message.
RECOGNISED, LIKELY = 0.5, 0.5
#: What isn't looked at: hosts, paths, variables and what stands in quotation marks of code; and a word that is cut off.
NOT_WORDS = r"""[a-z0-9@-]+(?:\.[a-z0-9@-]+)+|(?:^|\s)/[\w./-]+|\$\w+|'\w+'|\pL+\s*(?:…|\.\.\.)$"""
LANGUAGES = [x for x in WORDS if x]
_KANA, _HAN = re.compile("[぀-ヿ]"), re.compile("[㐀-鿿]")
_OF_JAPANESE = re.compile("|".join(sorted(map(re.escape, JAPANESE_STATES + JAPANESE), key=len, reverse=True)))
_OF_STATES = re.compile("|".join(map(re.escape, JAPANESE_STATES)))


@functools.cache
def _lexicon() -> dict[str, tuple[int, int]]:
    """Role and languages (as bits) of each word or, with a star, stem; of several roles the weightiest."""
    out: dict[str, tuple[int, int]] = {}
    for language, lists in WORDS.items():
        bit = 1 << LANGUAGES.index(language) if language else 0
        for role, words in zip((FILLING, THING, STATE, ERROR), lists, strict=True):
            # In the consistent form, in which letters that look alike are the same.
            for word in same_look(pa.array(words.split(), pa.string())).to_pylist():
                had = out.get(word, (OTHER, 0))
                out[word] = (max(had[0], role), had[1] | bit)
    return out


@functools.lru_cache(200_000)
def looked_up(word: str) -> tuple[int, int, int]:
    """(role, languages as bits, 1 if it is long enough to be a text of a script without spaces) of a word in small letters."""
    known = _lexicon()
    if word.isdigit():
        return (THING if len(word) == 3 and word[0] in "45" else FILLING), 0, 0
    if word in GENRES:
        return GENRE, known.get(word, (0, 0))[1], 0
    if _KANA.search(word) or _HAN.search(word):
        covered = sum(map(len, _OF_JAPANESE.findall(word)))
        kana = 1 << len(LANGUAGES) if _KANA.search(word) else 0
        if kana and covered >= 0.85 * len(word):
            return (ERROR if _OF_STATES.search(word) else THING), kana, 0
        return OTHER, kana, int(len(word) >= 4)
    role, bits = known.get(word, (OTHER, 0))
    for n in range(len(word), 2, -1):
        stem = known.get(word[:n] + "*")
        if stem:
            return max(role, stem[0]), bits | stem[1], 0
    return role, bits, 0


def weights(forms: pa.Array) -> np.ndarray:
    """How far each text, in its consistent form and small letters, is a message by its words: 1, 0.5 or 0.

    1: nothing but things and states, at least one of each, or nearly so in a long text. 0.5: half of the words of
    meaning are, or the words are of none of the languages known here, which other evidence then must decide. Questions,
    titles of texts, and messages that only head something else are 0, as are null and empty texts.
    """
    n = len(forms)
    text = pc.fill_null(forms.cast(pa.string()), "")
    asks = pc.match_substring_regex(text, ASKS).to_numpy(zero_copy_only=False)
    text = pc.replace_substring_regex(text, NOT_WORDS, " ")
    text = pc.replace_substring_regex(text, r":\s", " \x01 ", max_replacements=1)
    tokens = pc.split_pattern_regex(text, r"[^\pL\pN\x01]+")
    count = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(tokens).dictionary_encode()
    words = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), count)
    found = [looked_up(w) for w in words] or [(0, 0, 0)]
    role, bits, long = (np.array(x) for x in zip(*found, strict=True))
    real = np.array([w not in ("", "\x01") for w in words] or [False])[which] if len(which) else np.zeros(0, bool)
    mark = np.array([w == "\x01" for w in words] or [False])[which] if len(which) else np.zeros(0, bool)
    figure = np.array([w.isdigit() for w in words] or [False])[which] if len(which) else np.zeros(0, bool)
    role, bits, long = role[which], bits[which], long[which]

    def per(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask & real], minlength=n)

    thing, state, error, other, genre = (per(role == x) for x in (THING, STATE, ERROR, OTHER, GENRE))
    meant = thing + state + error
    share = meant / np.maximum(meant + other + genre, 1)
    # Words of the trade that all languages share, and figures, don't tell a language.
    shared = figure | ((bits == 0) & (role != OTHER))
    told = np.maximum(per(~shared), 1)
    language = np.max([per((bits >> k & 1 == 1) & ~shared) for k in range(len(LANGUAGES) + 1)], axis=0) / told
    # A head that is a message, over something that isn't.
    after = np.zeros(len(row), bool)
    if mark.any():
        passed = np.cumsum(mark)
        start = np.concatenate([[0], np.cumsum(count)[:-1]]).clip(max=max(len(row) - 1, 0))
        before_row = (passed[start] - mark[start])[row]
        after = (passed - before_row > 0) & ~mark
    loud = (role == THING) | (role == STATE) | (role == ERROR)
    tail_meant, tail_other = per(after & loud), per(after & ((role == OTHER) | (role == GENRE)))
    head_meant, head_other = meant - tail_meant, other + genre - tail_other
    heads = (head_meant > 0) & (head_other == 0) & (tail_other > 0) & (tail_meant < 3 * tail_other)
    about = asks | (genre > 0) | heads
    whole = (thing + error > 0) & (state + error > 0) & ((other + genre == 0) | (share >= 0.8) & (meant >= 4) & ~about)
    figures = per(figure & (role == FILLING)) > 0
    foreign = (language < RECOGNISED) & ~figures & ((other >= 2) | (per(long == 1) > 0) | (meant > 0))
    likely = ((share >= LIKELY) & (meant > 0) | foreign) & ~about
    return np.where(whole, 1.0, np.where(likely, 0.5, 0.0))
