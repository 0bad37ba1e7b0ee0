"""Problem 3: template residue, filler, error pages and demands for scripts instead of a message.

One Aho-Corasick automaton over the phrases below is run over each whole message (lower case, one blank for any white
space). A message is excluded when the phrases of one class cover at least ``COVERAGE`` of its letters and either one of
them suffices by itself (``FULL_WORDS`` words, a status code, markup) and the rest doesn't speak of work on it, or they are
all that it says (``NEARLY_ALL``) and more than a word or two; single words only add to that. Tags, hosts, ids and
numbers count neither way, and a phrase in quotation marks inside prose is quoted, not said. Unfilled
placeholders count wherever they stand for a value; where the sentence is about placeholders (escaping, expanding,
documenting them) or the name is that of an environment variable they don't. A form counts when only its headings,
hints and unticked boxes are left.

The work is one pass in Arrow batches without a shuffle, so a third of all rows in one library costs nothing extra; the
result is made distinct by id.

Defined cases: a null or blank message is no case; repeated rows of an id count once, and an id is a case when one of its
rows is; very long messages are read whole; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

#: Share of a message's letters that phrases of one class must cover.
COVERAGE = 0.5

# Phrases by class, in several languages.
ERROR = """
internal server error|bad gateway|service unavailable|service temporarily unavailable|gateway timeout|gateway time-out|gateway timed out|not found|page not found|forbidden|unauthorized|unauthorised|access denied|permission denied|too many requests|rate limit exceeded|bad request|request timeout|request timed out|method not allowed|unknown error|gone|http error|error code|error|server error|web server is down|connection refused|connection reset
the server met an unexpected condition|the server encountered an internal error|the server encountered an unexpected condition|the server could not complete your request|could not complete your request|the server is temporarily unable|temporarily unable to service your request|please try again later|try again later|try again|please contact the administrator|if you think this is a mistake|contact the operator|contact support|the page you asked for does not exist on this server|the page you requested|the page you are looking for|the requested url was not found|was not found on this server|does not exist on this server|does not exist|you do not have permission|you don't have permission to access|slow down and try again in|seconds
we are down for maintenance|down for maintenance|and will be back soon|will be back soon|we'll be back|whoops|oops|sorry|something went wrong|on our end|our team of|is on it|incident|error establishing a database connection|the connection has timed out|the server at|is taking too long to respond|backend did not answer in time|upstream|no healthy upstream|api rate limit exceeded|api rate limit exceeded for this address|for this address|see the limits page|request id|request|node|ray|ray id|reference|your ip|blocked|cloud|edge|cache miss|traceback|templateerror while rendering block|while rendering|body|of page|status|detail|documentation|message|code|data|null|center|title|at|mirror|server
your session has ended|your session has expired|your session timed out|session expired|sign in again|log in again|please sign in|please log in|login required|authentication required|to go on|to continue|go on|the page you are looking for may have been moved|the page you are looking for|may have been moved or never existed|may have been moved or deleted|may have been moved|may have been removed|or never existed|never existed|no longer available|is no longer available|back to start page|back to the start page|back to home page|back to the home page|back to home|go back|return to the home page|home page|start page|check the address|check the url|and try again|reload this page|refresh the page|retry|an error occurred|an unexpected error occurred|an error has occurred|unexpected error|internal error|application error|a server error|bad response|invalid response|invalid response from the upstream server|upstream server|upstream request timeout|upstream connect error|no server is available to handle this request|is currently unavailable|is currently overloaded|overloaded|at capacity|our servers are|currently unable to handle the request|unable to handle|not implemented|payload too large|request entity too large|precondition failed|conflict|length required|unprocessable entity|proxy error|proxy authentication required|dns error|host not found|this site can't be reached|took too long to respond|connection timed out|ssl handshake failed|origin is unreachable|quota exceeded|limit exceeded|try again in|minutes|the operator|the administrator|has been notified|we have been notified|our engineers|support team|resource|to view this resource|you do not have permission to view this resource|exception|stack trace|fatal error|undefined variable|on line|segmentation fault
sitzung abgelaufen|ihre sitzung ist abgelaufen|bitte melden sie sich erneut an|erneut anmelden|die angeforderte seite gibt es nicht|gibt es nicht mehr|gibt es nicht|zurück zur startseite|startseite|ein fehler ist aufgetreten|es ist ein fehler aufgetreten|bitte warten|votre session a expiré|reconnectez-vous|veuillez vous reconnecter|retour à l'accueil|une erreur est survenue|su sesión ha caducado|su sesión ha expirado|vuelva a iniciar sesión|inicie sesión|volver al inicio|会话已过期|登录已过期|请重新登录|返回首页|页面出错|出错了|发生错误
interner serverfehler|serverfehler|seite nicht gefunden|die seite wurde nicht gefunden|nicht gefunden|zugriff verweigert|der dienst ist derzeit nicht erreichbar|dienst nicht verfügbar|der server ist derzeit nicht erreichbar|bitte versuchen sie es später erneut|bitte versuchen sie es später noch einmal|versuchen sie es später|später erneut|fehler|wartungsarbeiten|zu viele anfragen|die angeforderte seite|existiert nicht
erreur|une erreur interne est survenue|erreur interne du serveur|réessayez plus tard|veuillez réessayer plus tard|le service est momentanément indisponible|service indisponible|page introuvable|page non trouvée|accès refusé|accès interdit|trop de requêtes|la page demandée|n'existe pas|est introuvable|en maintenance
error interno del servidor|error interno|página no encontrada|no se encontró la página|no encontrada|acceso denegado|servicio no disponible|el servicio no está disponible|inténtelo de nuevo más tarde|inténtalo más tarde|inténtelo más tarde|demasiadas solicitudes|vuelva a intentarlo|la página solicitada|no existe|se ha producido un error|ha ocurrido un error|temporalmente
errore interno del server|pagina non trovata|erro interno do servidor|página não encontrada|ошибка|внутренняя ошибка сервера|страница не найдена|доступ запрещён|доступ запрещен|сервис временно недоступен|попробуйте позже|повторите попытку позже
内部服务器错误|服务器内部错误|服务器错误|服务器|页面不存在|页面未找到|找不到页面|找不到该页面|您访问的页面不存在|访问被拒绝|拒绝访问|服务暂时不可用|服务不可用|服务暂不可用|请稍后再试|请稍后重试|请求过于频繁|请求过多|错误代码|错误|网关超时|网关错误|抱歉|系统维护中|维护中
"""
SCRIPT = """
javascript|java script|scripts|scripting|cookies|javascript and cookies|scripts and cookies|a modern browser with scripts|modern browser|noscript|browser|your browser|in your browser|this browser|browser settings|an extension|by an extension in your browser|it seems|is disabled or blocked|disabled or blocked|is disabled|are disabled|is blocked|blocks scripts|blocked|must be enabled|must be enabled for this|for this tracker|tracker|is required|are required|required|needed|is needed|are needed|you need to enable|need to enable|to use the tracker|please enable|please turn on|turn on|please activate|please allow|enable|allow|to continue using this application|to continue|this application|using|to view this page|to view this content|to see this page|this site|this page|this website|this app|does not work properly without|does not work without|works best with|does not support|does not run|did not run|without|and|or|you are seeing this since|you are seeing this because|since|because|reload or switch browser|reload|switch browser|reload the page|refresh|loading|if nothing happens|we could not load the discussion without it|could not load|cannot be shown|so the conversation cannot be shown|the conversation|the discussion
checking your browser before you proceed|checking your browser before accessing|checking your browser|checking if the site connection is secure|before you proceed|this takes|this may take|seconds|this process is automatic|verify that you are human|verify you are human|please verify|confirm that you are not a robot|you are not a robot|i am not a robot|i'm not a robot|complete the challenge|solve the puzzle|complete the security check|security check|captcha|unusual traffic|one moment|just a moment|please wait|please stand by|by completing|the action below|before you continue|accept cookies|we use cookies|ray|ray id|performance and security by|ddos protection
bitte aktivieren sie|aktivieren sie|um den inhalt anzuzeigen|um diese seite anzuzeigen|um fortzufahren|um diese seite zu nutzen|ihr browser unterstützt kein|ihr browser unterstützt keine|in ihrem browser|ihrem browser|ihr browser|für diese seite wird|für diese anwendung wird|wird benötigt|benötigt|erforderlich|ist deaktiviert|deaktiviert|diese seite funktioniert nicht ohne|diese seite|ohne|und|bestätigen sie, dass sie ein mensch sind|sie ein mensch sind|kein roboter|ihr browser wird geprüft|browser wird überprüft|wird geprüft|einen moment
vous devez activer|veuillez activer|activer|activez|dans votre navigateur|votre navigateur|pour afficher cette page|pour afficher ce contenu|pour continuer|afin de continuer|cette page requiert|cette page nécessite|requiert|nécessite|ce site|cette page|ne fonctionne pas sans|est désactivé|et les cookies|et|vérification de votre navigateur|vérifiez que vous êtes humain|vous êtes humain|vous n'êtes pas un robot|un instant
es necesario activar|debe activar|debes activar|necesitas|necesita|activar|active|habilite|habilitar|habilita|por favor|para ver este contenido|para ver esta página|para continuar|en su navegador|en tu navegador|su navegador|tu navegador|no es compatible|esta página requiere|requiere|este sitio|no funciona sin|está desactivado|código|y las cookies|verifique que es humano|verifica que eres humano|no eres un robot|comprobando su navegador|comprobando tu navegador|un momento
attivare|abilita|per continuare|il tuo browser|ative o|para continuar|seu navegador|включите|для продолжения|в вашем браузере|ваш браузер|необходимо включить|подтвердите, что вы человек|проверка браузера
请启用|请开启|启用|开启|需要启用|才能继续|以继续|浏览器|您的浏览器|你的浏览器|您的浏览器不支持|不支持|已禁用|本页面需要|此页面需要|本站|脚本|查看此页面|查看内容|以查看|请验证您是真人|验证您是真人|确认您不是机器人|正在检查您的浏览器|安全检查|请稍候|需要
"""
FILLER = """
lorem|ipsum|dolor|sit|amet|consectetur|consetetur|sadipscing|adipiscing|adipisicing|elit|elitr|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|aliquyam|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum|diam|nonumy|eirmod|invidunt|erat|voluptua|vero|eos|accusam|justo|duo|dolores|rebum|stet|clita|kasd|gubergren|takimata|sanctus|at|no
test|testing|test test|text|text text|text goes here|your text here|insert text here|some text|sample text|dummy text|dummy|sample paragraph|replace this|with your own text|with your own|your own text|your text|this sample|sample|edit this text|click here to edit|write something here|lorem text|filler|filler text|placeholder|placeholder text|this is a placeholder|this is a test|please ignore|ignore|tbd|to be determined|to be done|to be written|to be filled|todo|coming soon|write a real description|write a description|write description|real description|before merging|before merge|before submitting|before you submit|add a description|add description here|delete this line|remove this line|change me|changeme|fill me in|to come|more to come|no description|no description provided|no message|empty|untitled|wip|content goes here|description goes here|foo|bar|foo bar|baz|qux|asdf|asdfgh|asdfghjkl|asdasd|qwerty|qwertz|qwe|xxx|xxxx|yyyy|zzzz|blah|bla|blah blah|abc|n/a|none|hello world|fixes|see|nnn
beispieltext|blindtext|platzhalter|platzhaltertext|mustertext|hier steht später der text|hier steht der text|hier kommt der text|text folgt|beispiel|texto de ejemplo|texto de relleno|texto de prueba|texto de muestra|aquí va el texto|su texto aquí|texte d'exemple|texte de remplissage|texte factice|votre texte ici|texte à venir|faux texte|exemple de texte|testo segnaposto|testo di esempio|texto de exemplo|пример текста|текст заполнитель|здесь будет текст|рыба текст
占位文本|占位符|示例文本|示例文字|此处填写|此处输入|这里是文本|测试测试|测试|填充文本|样例文本|待补充|在此输入|文字
"""
FORM = """
what does this pr do|expected|actual|expected outcome|actual outcome|expectation|observed|impact|solution|problem|proposal|please fill in this form|please fill in below|fill in below|fill out|please fill out|replace this line|delete if not needed|delete as needed|optional|if applicable|yes|no|os|browser|what does this change do|what does this do|what changed|what|why|how|how was this tested|how has this been tested|how to test|testing|checklist|tests|docs|documentation|changelog|description|summary|motivation|motivation and context|context|related issue|related issues|related|issue|screenshots|type of change|steps to reproduce|expected behaviour|expected behavior|actual behaviour|actual behavior|expected result|actual result|environment|additional context|one or two sentences|link the issue|link to the issue|describe your changes|please describe|please fill in|fill in|breaking change|bug fix|new feature|version|was ist passiert|warum|beschreibung|zusammenfassung|description du changement|pourquoi|descripción|por qué|lista de control|notes|reviewers|risk|rollback
"""
# Phrases that only go with others, so a message of nothing else is no case.
FRAGMENTS = frozenset("before merging|before merge|before submitting|before you submit|see|fixes|at|no|is|do|in|id|and|or|since|because|seconds|minutes|request|node|body|status|detail|documentation|message|code|data|title|mirror|server|cloud|edge|resource|conflict|incident|upstream|reference|using|reload|refresh|loading|to continue|para continuar|pour continuer|um fortzufahren|empty|ignore|abc".split("|"))
CLASSES = {"error": ERROR, "script": SCRIPT, "filler": FILLER}

# Names that stand for a value in a form, and variables of the environment.
VALUE = r"(?:first ?name|last ?name|full ?name|user ?name|name|vorname|nachname|nombre|nom|user|author|reviewer|assignee|recipient|customer|component|module|project(?: title)?|title|subject|summary|description|body|message|reason|ticket|issue(?: (?:number|id))?|number|link|url|branch(?: name)?|target branch|source branch|version|(?:from|to|old|new) version|dep(?:endency)? name|package|release(?: notes)?|notes|changelog|scope|date|steps to reproduce|expected|actual|compiler|platform|commit(?: (?:message|body|title))?|email|company|team|text|value|placeholder)"
ENVIRONMENT = r"(?:HOME|PATH|USER|USERNAME|VAR|PWD|SHELL|TMP|TEMP|TMPDIR|LANG|APPDATA|USERPROFILE|PREFIX|DESTDIR|CC|CXX|CFLAGS|CXXFLAGS|LDFLAGS|LD_LIBRARY_PATH|SRCDIR|BUILDDIR|PYTHONPATH|JAVA_HOME|NAME)"
HOLDERS = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]+%\}|<%[=#-]?[^%\n]+%>|[$#]\{[A-Za-z_][\w. -]{0,40}\}|%[A-Za-z][A-Za-z_]{1,40}%|%\([a-z_]{1,40}\)s|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)|@@[A-Za-z_]{2,40}@@"
    r"|(?<![\w.@])@[a-z_]{2,40}@(?![\w.])|\[\[[A-Za-z_ ]{2,40}\]\]|\[(?:your|insert|enter|add|describe|explain|write|fill|provide|list|replace|please|put|type|give|state|summari[sz]e|ihr|hier|votre|décrire|décrivez|describa|su|escriba) [^\]\n]+\]|<(?:insert|your|enter|add|describe|explain|write|fill|provide|list|replace|please|put|type|give|state) [^>\n]+>|\[[a-z_ ]{2,40}\](?!\()|<[a-z][a-z_ -]{1,40}>|\$[A-Z][A-Z]*_[A-Z_]+\b|\bX{4}\b.*\bY{4}\b|\{\d\}[^\n]{0,60}\{\d\}",
    re.I,
)
SPOKEN = re.compile(
    r"\b(?:escap\w*|quot(?:e|ed|es|ing)|expand(?:s|ed|ing)?|expansion|render(?:s|ed|ing)? .*\b(?:lazily|engine|once|template)|template engine|templates? (?:engine|syntax|language)|leaves? .* alone|left alone|literally|verbatim|instead of|placeholders?|interpolat\w*|substitut\w*|unescaped|variables?|parsed by|brackets?|docs?:|usage line|syntax|regex|string literal|printf|format string|spell\w*|rename[ds]?|replaced? by real)\b",
    re.I,
)
TAG = re.compile(r"<!doctype[^>]*>|</?(?:html|head|body|title|h[1-6]|p|hr|br|center|div|span|noscript|meta|script|style|pre|a|b|i|ul|li|strong|em)\b[^>]{0,200}>", re.I)
IDS = re.compile(r"\b(?:[\w-]+\.)+(?:example|test|invalid|com|org|net|io|dev)\b|\b[a-z]+/\d[\w.]*|\bhttp/\d\.\d|\b(?=[a-z-]*\d)[0-9a-z-]{2,}\b|\b\d+\b", re.I)
MAYBE_ID = re.compile(r"[\d.]")
CODE_NAME = re.compile(r"\b[a-z0-9]+_[a-z0-9_]+\b|\b[a-z]+[A-Z]\w+\b|\b[\w-]+/[\w./-]+\.(?:c|h|cc|cpp|js|py|go|rs|java)\b")
MARK = re.compile(r"[{%<@\[$]|__[A-Z]|XXXX")
HINT = re.compile(r"<!--.*?-->", re.S)
#: Words of a phrase that suffices by itself, and the share from which little else need be said.
FULL_WORDS, NEARLY_ALL = 3, 0.95
STATUS, LATIN, HAN = re.compile(r"\b[45]\d\d\b"), re.compile(r"\b(?:lorem|ipsum)\b"), re.compile(r"[一-鿿]")
# Words of one who speaks of work on such a text.
WORK = re.compile(r"\b(?:fix(?:e[sd]|ing)?|add(?:s|ed|ing)?|handl(?:e[sdr]?|ing)|retr(?:y|ies|ied|ying)|remov(?:e[sd]?|ing)|support(?:s|ed|ing)?|improv(?:e[sd]?|ing)|updat(?:e[sd]?|ing)|drop(?:s|ped)?|avoid(?:s|ed)?|catch(?:es)?|return(?:s|ed)?|show(?:s|n)?|map(?:s|ped)?|treat(?:s|ed)?|raise[sd]?|throw[sn]?|report(?:s|ed)?|swallow(?:s|ed)?|refactor|rework|unit|parse[sdr]?|render(?:s|ed)?|emit(?:s|ted)?)\b")


def words_in(phrase: str) -> float:
    """Words of a phrase; two characters of a script without blanks count as one and a half."""
    return len(phrase.split()) if not HAN.search(phrase) else max(len(phrase.split()), 0.75 * len(HAN.findall(phrase)) + 0.75)



def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, text in [*CLASSES.items(), ("form", FORM)]:
        for phrase in filter(None, re.split(r"[|\n]", text)):
            kinds = a.get(phrase, (len(phrase), frozenset()))[1]
            a.add_word(phrase, (len(phrase), kinds | {kind}))
    a.make_automaton()
    return a


def _wordlike(c: str) -> bool:
    return c.isalnum() and c < "⺀"


def hits(auto: ahocorasick.Automaton, low: str) -> list[tuple[int, int, frozenset]]:
    """(start, size, classes) of the phrases in the text, at word boundaries."""
    out, n = [], len(low)
    for end, (size, kinds) in auto.iter(low):
        start = end - size + 1
        if (start and _wordlike(low[start - 1]) and _wordlike(low[start])) or (end + 1 < n and _wordlike(low[end + 1]) and _wordlike(low[end])):
            continue
        out.append((start, size, kinds))
    return out


def covered(found: list[tuple[int, int, frozenset]], n: int) -> dict[str, bytearray]:
    """For each class which of the n characters its phrases cover."""
    out: dict[str, bytearray] = {}
    for start, size, kinds in found:
        for k in kinds:
            mask = out.get(k)
            if mask is None:
                mask = out[k] = bytearray(n)
            mask[start : start + size] = b"\x01" * size
    return out


def unfilled(text: str) -> bool:
    """Whether a placeholder stands where a value belongs."""
    for m in HOLDERS.finditer(text):
        h = m.group()
        a = max(text.rfind("\n", 0, m.start()), text.rfind(". ", 0, m.start())) + 1
        b = min([x for x in (text.find("\n", m.end()), text.find(". ", m.end())) if x >= 0], default=len(text))
        sentence = text[a:b]
        if SPOKEN.search(sentence):
            continue
        inner = re.search(r"[A-Za-z][\w. -]*", h)
        name = re.sub(r"[_.\s]+", " ", inner.group()).strip().lower() if inner else ""
        if h[0] == "<" and f"</{name}" in text.lower():
            continue
        if h[0] in "[<" and not h.startswith(("[[", "<%")):
            known = re.fullmatch(rf"(?:your|insert|enter|add|describe|explain|write|fill|provide|list|replace|please|put|type|give|state|summari[sz]e|ihr|hier|votre|décrire|décrivez|describa|su|escriba) .*|(?:{VALUE}|[a-z]+ name|[a-z]+ number)", name)
            if not known or (h[0] == "<" and CODE_NAME.search(sentence) and " " not in name and not re.fullmatch(VALUE, name)):
                continue
            return True
        if re.fullmatch(ENVIRONMENT, h.strip("${}%#")):
            continue
        if h.startswith("%(") or h[0] in "$#%" or h.startswith("@") and not h.startswith("@@"):
            last = name.removesuffix(" s").split(" ")
            if re.fullmatch(VALUE, " ".join(last)) or re.fullmatch(VALUE, last[-1]) or h.startswith(("${", "#{")):
                return True
            continue
        return True
    return False


def kind_of(auto: ahocorasick.Automaton, message: str | None, coverage: float = COVERAGE) -> str | None:
    """error, script, filler, template, or None for a message that somebody wrote."""
    if not message or not message.strip():
        return None
    text = message.replace("﻿", "").strip()
    if MARK.search(text) and unfilled(text):
        return "template"
    low = re.sub(r"\s+", " ", text).lower()
    markup = text[:1] in "{<" or "</" in text
    found = hits(auto, low)
    form = "##" in text or "- [ ]" in text or "<!--" in text
    said = sum(size for _, size, _ in found)
    if not form and "<" not in low and said < coverage * sum(sum(map(str.isalpha, w)) for w in low.split() if not MAYBE_ID.search(w)):
        return None  # the letters outside of ids, hosts and tags are at least those
    masks = covered(found, len(low))
    hidden = bytearray(len(low))
    for m in IDS.finditer(low):
        hidden[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    for m in TAG.finditer(low):
        hidden[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    quoted = [] if markup else [(m.start(), m.end()) for m in re.finditer(r"[\"“„«][^\"”“»\n]{3,80}[\"”“»]", low)]
    letters = [i for i, c in enumerate(low) if c.isalpha() and not hidden[i]]
    if not letters:
        return "error" if TAG.search(low) and re.search(r"\b[45]\d\d\b", low) else None
    if form:
        bare = re.sub(r"\s+", " ", HINT.sub(" ", text)).lower()
        known = covered(hits(auto, bare), len(bare)).get("form", bytearray(len(bare)))
        left = [c for c, k in zip(bare, known) if c.isalpha() and not k]
        if len(left) <= 0.15 * max(1, sum(c.isalpha() for c in bare)) and "[x]" not in bare:
            return "template"
    names = sum(m.end() - m.start() for m in CODE_NAME.finditer(text))
    best, top = None, 0.0
    weight: dict[str, float] = {}
    for a, size, kinds in found:
        if low[a : a + size] not in FRAGMENTS:
            for k in kinds:
                weight[k] = max(weight.get(k, 0), words_in(low[a : a + size]))
    for kind in CLASSES:
        mask = masks.get(kind)
        if mask is None or kind not in weight:
            continue
        for a, b in quoted:
            mask[a:b] = bytes(b - a)
        share = sum(mask[i] for i in letters) / (len(letters) + (names if names > 0.1 * len(letters) else 0))
        if share <= top:
            continue
        code = kind == "error" and STATUS.search(low) is not None
        rest = "".join(" " if mask[i] else c for i, c in enumerate(low))
        if share >= NEARLY_ALL:
            enough = kind != "script" or markup or weight[kind] >= 2 or words_in(low) >= 4
        else:
            enough = markup or ((code or weight[kind] >= FULL_WORDS or (kind == "filler" and (LATIN.search(low) or len(low.split()) - len(rest.split()) > FULL_WORDS))) and not (WORK.search(rest) and share < 0.85))
        if enough:
            best, top = kind, share
    return best if top >= coverage else None


def residue(messages: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(id, kind) of the rows whose message is no message; one row an id and kind."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _automaton()
        for p in parts:
            kinds = [kind_of(auto, m, coverage) for m in p["message"]]
            yield pd.DataFrame({"id": p["id"], "kind": kinds}).dropna(subset=["kind"])

    held = messages.select("id", "message").where("id is not null and trim(message) <> ''")
    return held.mapInPandas(run, "id string, kind string").distinct()
