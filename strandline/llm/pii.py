"""Problem 2: personal information inside free text.

A text is first normalised by a chain of small transducers: compatibility forms, dashes, blanks and invisible characters;
letters of another script inside a Latin word; spelled digits; disguised @ and dots. Each keeps, for every character it
writes, the span of source characters it came from, so what is detected in the normal form is replaced in the source
and all else stays as it was. E-mail addresses are found first, then identity numbers, phone numbers, street addresses
and names; characters that belong to one find are hidden from the next, so a name that is part of an address isn't one.

The work is one pass in Arrow batches without a shuffle; found kinds are made distinct by (id, field, kind), partially
before the shuffle.

Defined cases: null and empty texts have no finds and come out unchanged; repeated rows count once in ``found`` and each
come out redacted; very long texts are read whole; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

# Look-alikes of Latin letters, spelled digits.
LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅανορτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSavoptukABEZHIKMNOPTYX"))
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
INVISIBLE = "­​‌‍‎‏⁠﻿"
DASHES = "‐‑‒–—−－﹣"

_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:{_digit}|\d)(?:[ ,.-]{{1,3}}(?:{_digit}|\d)){{6,15}}(?!\w)", re.I)
WORD, FOLD = re.compile(r"\w+"), str.maketrans("İıſ", "iis")
MIXED = re.compile(r"[A-Za-z][\w.@+-]*[Ͱ-ӿ]|[Ͱ-ӿ][\w.@+-]*[A-Za-z]")
AT = r"(?:[ \t]*[\[({<][ \t]*(?:at|@|arroba|ät)[ \t]*[\])}>][ \t]*|[ \t]+(?:at|AT|At|arroba|@)[ \t]+)"
DOT = r"(?:[ \t]*[\[({<][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[\])}>][ \t]*|[ \t]+(?:dot|DOT|Dot|punkt|punto)[ \t]+|\.)"
DISGUISED = re.compile(rf"(?<![\w./@+-])([A-Za-z][\w.+-]*)({AT})((?:[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)(?:{DOT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)+)(?![\w/@(-])", re.I)
HINT_AT = re.compile(r"(?i)[ \t\[({<](?:at|@|arroba|ät)[ \t\])}>]")
_A = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"  # letters of scripts that put blanks between words
EMAIL = re.compile(rf"(?<![\w./@+-])(?:[{_A}0-9][\w.+%'-]*)@(?:[{_A}0-9](?:[{_A}0-9-]*[{_A}0-9])?\.)+([{_A}]{{2,24}})(?![\w@-])(?!\.\w)(?!:[\w~/.-]*[/.]\w)(?!/[\w~])")
FILE_ENDS = frozenset("c h cc cpp cxx hpp hxx hh js ts py go rs java rb php sh txt md rst html htm xml json yaml yml toml csv log cfg conf ini lock png jpg gif svg o so a obj exe dll git".split())
REACH = re.compile(r"(?i)(?:write to|mail(?:ed)?(?: to)?|e-?mail(?:s|ed)?:?|contact:?|reach(?:ed)?(?: me| us| them)? (?:at|under|via)|ask|address(?:ed)? (?:is|to)|forwarded by|questions (?:go )?to|rückfragen an|from:?|cc:?|by:?)\s*$")

PHONE = re.compile(
    r"(?<![\w+./:#@-])(?:tel:)?(?:"
    r"\+\d{1,3}[ .-]?(?:\(0?\d{0,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{1,5}){1,6}"
    r"|00[1-9]\d{9,13}|00[1-9]\d{0,2}[ .-]\d{1,5}(?:[ ./-]\d{1,5}){1,5}"
    r"|\(0?\d{2,5}\)[ .-]?\d{3,5}(?:[ .-]?\d{2,5}){0,3}"
    r"|[2-9]\d{2}([-. ])[2-9]\d{2}\1\d{4}|1[-. ][2-9]\d{2}([-. ])[2-9]\d{2}\2\d{4}"
    r"|0\d{1,4}[/ ]\d{3,8}(?:[ -]?\d{2,5}){0,3}|0\d{2,4}-\d{6,8}|0\d(?:[ .]\d{2}){4}"
    r")(?:,? ?(?:ext|x|Durchwahl|extn)\.? ?\d{1,5})?(?![\w%]|[-/:]\d|\.\d)",
)
PHONE_WORD = re.compile(r"(?i)(?:\b(?:phone|tel|telephone|telefon|teléfono|téléphone|mobile|mobil|móvil|portable|cell|fax|call(?:ed)?|ring|hotline|whatsapp|sms)|电话|手机|тел)\s*(?:no\.?|number|nr\.?|:|\.|=|at|is|：)*\s*[\"']?(\+?\(?\d[\d ()./-]{5,18}\d)(?![\w-])")

ID_CONTEXT = re.compile(
    r"(?i)\b(?:passport|passeport|pasaporte|reisepass|pass(?:nummer|-nr)|passaporto|ssn|social security|social insurance|sozialversicherung\w*|sécurité sociale|seguridad social|national id(?:entity)?|national insurance|nin|nino|identity card|id card|identity (?:number|no)|identification (?:number|no)|personalausweis\w*|ausweis\w*|carte d'identité|documento de identidad|dni|nie|nif|cpf|steuer-?(?:id|nummer|identifikationsnummer)|tax(?:payer)? (?:id|identification|number|no|file)\w*|tin|itin|driver'?s? licen[cs]e|driving licen[cs]e|führerschein\w*|codice fiscale|bsn|pesel|personnummer|паспорт\w*|инн|снилс)\b"
    r"|护照|身份证|社会保障|社保|税号|纳税"
)
ID_VALUE = re.compile(r"(?<![\w.-])(?=[A-Z0-9 .-]*\d[A-Z0-9 .-]*\d[A-Z0-9 .-]*\d[A-Z0-9 .-]*\d[A-Z0-9 .-]*\d)[A-Z]{0,3}[ -]?\d[\dA-Z]*(?:[ .-]?(?:\d[\dA-Z]{0,5}|[A-Z]\b)){0,6}(?![\w-])")
ID_BETWEEN = re.compile(r"(?i)[\s:#=.,'\"()№]*(?:(?:card|number|numbers|no|nr|num|numero|número|id|code|is|was|of|holder|reads|given|as|with|the|my|his|her|their|follows|n[º°o])\b[\s:#=.,'\"()]*|号码?[:：]?\s*|[:：]\s*)*")
SSN = re.compile(r"(?<![\w.:/-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|\.\d)")

_U = "A-ZÀ-ÖØ-ÞŠŽČĆĐŁŚŻŹĚŘŇŤĎŮŐŰĂĄĘĞİŞĀĒĪŪ"
_l = "[a-zß-öø-ÿĀ-ɏḀ-ỿ]"
_W = rf"[{_U}](?:{_l}|['’](?=\w))+(?:-[{_U}]{_l}+)*"
CITY = rf"(?:(?:Saint|San|Santa|St\.?|Sankt|Bad|Port|New|Neu|Old|Le|La|Los|El)[ -])?[{_U}]{_l}+(?:-[{_U}]{_l}+)*"
ADDRESS = re.compile(
    rf"(?<![\w.])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\d+\w?,\s(?:{_W}\s(?:House|Court|Building|Tower|Hall),\s)?)?(?:"
    rf"\d{{1,5}}[a-zA-Z]?,?\s(?:(?:North|South|East|West|Upper|Lower|Old|New|Great|Little|[NSEW]\.?)\s)?(?:{_W}\s){{1,3}}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Court|Ct\.?|Close|Place|Pl\.?|Boulevard|Blvd\.?|Terrace|Crescent|Square|Sq\.?|Hill|Row|Walk|Gardens|Grove|Parkway|Pkwy\.?|Highway|Hwy\.?|Mews|Quay|Rise|Green)(?![\w(])"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter|[a-d]))?,?\s(?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]oulevard|[Bb]d\.?|[Cc]hemin|[Pp]lace|[Ii]mpasse|[Aa]llée|[Qq]uai|[Cc]ours|[Rr]oute|[Ss]entier)\s(?:de\s(?:la\s|l['’])?|du\s|des\s|d['’])?{_W}(?:[ -]{_W})?"
    rf"|(?:[Cc]alle|C/|Cl\.|Avenida|Avda\.?|Plaza|Pza\.?|Paseo|Camino|Ronda|Carrer|Via|Viale|Piazza|Corso|Rua|Travessa|Praça)\s(?:de(?:l|\sla|\slos|\slas)?\s|do\s|da\s|dos\s)?{_W}(?:\s{_W})?,?\s(?:n\.?[º°]?\s?|núm\.?\s?)?\d{{1,4}}[a-zA-Z]?(?:,\s\d{{1,2}}\.?[º°ªo]\.?\s?[A-Z]?(?!\w))?"
    rf"|[{_U}][\w'-]*?(?:straße|strasse|str\.|weg|allee|platz|gasse|damm|ufer|steig|chaussee|ring|hof)\s\d{{1,4}}\s?[a-z]?(?!\w)|(?:{_W}(?:er|-))?\s?(?:Straße|Allee|Platz|Weg|Gasse)\s\d{{1,4}}\s?[a-z]?(?!\w)"
    rf"|(?:Am|An\s(?:der|den|dem)|Auf\s(?:der|dem|den)|Im|In\s(?:der|den)|Zum|Zur|Unter\sden|Hinter\s(?:der|dem)|Beim|Bei\sder)\s{_W}\s\d{{1,4}}\s?[a-z]?(?=,\s(?:\d{{4,5}}\s)?[{_U}]|\s*$|[.;)\"'])"
    r"|(?:ул(?:ица|\.)|пр(?:оспект|-т|\.)|пер(?:еулок|\.)|наб(?:ережная|\.)|бульвар|площадь)\s?[А-ЯЁ][а-яё-]+(?:\s[А-ЯЁ][а-яё-]+)?,?\s(?:д(?:ом|\.)\s?)?\d{1,4}"
    r"|(?:[一-鿿]{1,6}(?:省|市|区|县))*[一-鿿]{1,6}(?:路|街|大道|巷|弄|胡同)\s?\d{1,5}\s?号(?:\s?\d{1,4}\s?(?:室|楼|栋|单元))*"
    rf")(?:,\s(?:Apt\.?|Flat|Unit|Suite|Apartment|Bldg\.?|Floor|#)\s?\d+\w?)?(?:,?\s(?:\d{{4,6}}\s{CITY}|(?<=,\s){CITY}(?:,?\s(?:[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}}|[A-Z]{{2}}\s\d{{5}}|\d{{4,6}}))?(?![\w'’]| {_W})))?",
)
# What is tried before the patterns behind it. Each is a part that every match of those has, so it rejects none of them.
DIGIT, SOME_DIGITS, MANY_DIGITS = re.compile(r"\d"), re.compile(r"\d(?:[A-Z .-]*+\d){4}"), re.compile(r"\d(?:[ ()./,xDurchwalent-]*+\d){6}")
MAYBE_LIST = re.compile(rf",\s[{_U}]")
MAYBE_INITIAL = re.compile(rf"[{_U}]\.[ -]?[{_U}abdeiltvz]")
MAYBE_FULL = re.compile(rf"(?:{_l}|['’])[ \t\n]+(?:[{_U}]|al-|el-|(?:van|von|de|di|da|do|du|le|la|el|al|bin|ibn|ben|ter|ten|zu|af|av))")
SPOKEN_WORDS = [f"{w}{c}" for w in "patch patched report reported suggest suggested found fix fixed review reviewed written spotted diagnosed noticed idea hint test tests tested debugged contributed submitted credit credits thanks thx kudos props tip h/t author name oncall on-call assigned contact ask".split() for c in (" this", " by", " to", " from", " go", " is", ":", "-by:")] + ["cc ", "cc: "]


# Words in capitals that aren't parts of a person's name.
NO_NAME = frozenset(
    """
    a an the this that these those it its we you they he she i my your our their his her and or but nor so yet for if then else when while where which who whom whose what why how not no yes also only even just still again already
    as at by from in into of off on onto out over to up upon with within without under after before since until during about above below between among through against per via than like unlike because although though however therefore hence instead
    is are was were be been being has have had do does did can could may might must shall should will would let lets get got make made see seen use used add added fix fixed fixes remove removed drop dropped keep kept move moved split check checks test tests tested reject allow avoid handle guard limit stop plug rework refactor revert update updated upgrade merge merged bump release released resolve resolves close closes closed reopen follow split show tell write read retry replace escape quote map render answer call return returns running setting reading
    reported reporter suggested signed reviewed acked approved tested co developed authored helped requested thanks thank thx merci gracias danke grazie obrigado dank cc author authors committer contact contacts date subject hello hi dear hallo bonjour hola best regards cheers note notes docs doc documentation log logs debug info warning error errors fatal trace steps step highlights maintenance todo fixme xxx hat tip tips delivery patch patches pairing sample row first last name names surname nachname vorname familienname nombre apellido apellidos nom prénom telefon teléfono
    team teams group groups crew squad bot bots robot robots service services system systems server servers build builds builder ci cd job jobs runner runners pipeline pipelines release releases platform platforms infrastructure infra tooling tools tool security secure response responders maintainers maintainer contributors contributor developers developer engineering engineers core community project projects foundation committee council board office department division lab labs institute university company corporation inc ltd gmbh llc
    static analysis analyser analyzer analyzers address sanitizer sanitizers sanitiser memory thread undefined behavior behaviour leak leaks continuous integration fuzzing fuzzer fuzzers fuzz nightly weekly daily hourly run runs triage automation automated automatic auto lint linter format formatter dependency dependencies updater update updates coverage scanner scan scans mirror mirroring sync import importer export quality assurance qa support help desk helpdesk admin administrator administrators root user users guest anonymous unknown nobody everyone anybody someone somebody
    main loop loops worker workers pool pools thread threads queue queues event events handler handlers manager managers controller controllers factory factories module modules component components library libraries package packages version versions feature features option options parser parsers lexer compiler linker loader reader writer buffer buffers cache caches table tables index list lists map maps tree trees node nodes key keys value values string strings array arrays object objects class classes method methods function functions interface interfaces header headers file files path paths folder directory windows linux mac macos ios android unix posix
    internal external gateway bad unavailable service request requests response responses not found forbidden unauthorized unauthorised denied access too many temporarily timeout time-out timed gone moved permanently permanent content type length http https html json xml yaml toml csv utf ascii unicode api url uri id ids ok get post put delete head web page pages site sites browser javascript cookies script scripts java python rust go ruby perl swift kotlin node git docker kubernetes
    view views tile tiles book books street address calendar clock time zone zones mode dark light night screen screens window windows button buttons bar toolbar sidebar panel dialog dialogs tab tabs card cards search settings preferences account accounts profile profiles session sessions dashboard report reports editor viewer player recorder browser explorer navigator wizard assistant monitor center centre studio suite hub store market cloud sky net web app apps application applications client clients peer peers stream streams channel channels frame frames packet packets buffer ring timer wheel stack heap graph model models engine engines driver drivers device devices port ports socket sockets protocol protocols format formats codec codecs image images video audio font fonts text line lines word words letter letters number numbers date dates code codes data base database databases record records field fields column columns row rows cell cells sheet sheets chart charts shared share shares big small large little great good best first second third last next previous upper lower old new young high low left right front back red green blue black white grey gray yellow bronze silver gold
    generic default template templates title summary description checklist change changes changed changelog expected actual result results question answer issue issues ticket tickets bug bugs crash crashes regression performance improvement improvements january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec spring summer autumn winter meeting
    open source free software public licence license copyright rights reserved insert into values select where order apartment flat unit suite house street road avenue lane way drive court close place north south east west port saint city town county state country tel telefon phone mobile fax mail email
    der die das den dem des ein eine einer und oder nicht ist war im am an auf bei mit von vom zu zum zur nach vor für über gemeldet bitte rückfragen betroffen datensatz siehe danke herr frau le la les un une des du et ou pour par avec dans sur signalé el los las un una y o por para con del aviso pasaporte domicilio afectado reported data record core dump look lookup lorem ipsum dolor sit amet
    сообщил сообщила спасибо автор от для см лог проверил проверила исправил исправила благодарим контакт подпись господин госпожа
    """.split()
)
# Companies, products and places, which begin no person's name, and pairs of surnames that name a method.
NO_NAME |= frozenset(
    """
    uses used calls takes makes gives needs runs builds ships supports requires replaces targets follows matches
    apple microsoft google mozilla amazon adobe oracle intel nvidia samsung huawei qualcomm cisco siemens facebook netflix twitter github gitlab bitbucket atlassian jetbrains
    visual basic azure firefox chrome chromium safari opera outlook office excel photoshop silicon debian ubuntu fedora gentoo suse centos alpine freebsd openbsd netbsd solaris kde gnome
    san santa los las saint united states kingdom zealand america africa asia europe european american british german french spanish italian chinese japanese russian
    new york london berlin paris madrid tokyo beijing shanghai moscow francisco diego angeles
    """.split()
)
METHODS = frozenset("boyer moore|diffie hellman|rabin karp|knuth morris|needleman wunsch|smith waterman|floyd warshall|bellman ford|reed solomon|levenshtein damerau|damerau levenshtein|runge kutta|gauss newton|monte carlo|edwards curve|merkle damgard|merkle tree|huffman coding|fisher yates|lempel ziv|aho corasick|bloom filter|montgomery ladder|galois counter|miller rabin|hamming distance".split("|"))
TITLE_WORDS = r"(?:Dr|Prof|Mr|Mrs|Ms|Mx|Miss|Sir|Herr|Frau|Mme|Mlle|M|Sr|Sra|Srta|Dipl|Ing)\.?"
PARTICLE = r"(?:van\sder|van\sden|van\sde|van|von\sder|von|de\sla|de\slos|de|del|della|dalla|di|da|dos|du|le|la|el|al|bin|ibn|ben|ter|ten|zu|af|av)"
SURNAME = rf"(?:al-|el-|O['’]|D['’]|L['’]|Mac|Mc|Fitz|De|Di|Van|Le|La)?{_W}"
GIVEN = rf"[{_U}](?:{_l}|['’](?=\w))+(?:-[{_U}]{_l}+)*"
SEP = r"[ \t]*\n?[ \t]+"
FULL = re.compile(rf"(?<![\w@/:#.$%-])({GIVEN})((?:{SEP}[{_U}]\.)*(?:{SEP}{PARTICLE})?{SEP})({SURNAME})(?![\w(@/]|[-.]\w)")
INITIAL = re.compile(rf"(?<![\w@/:#.$%-])((?:[{_U}]\.[ -]?){{1,3}})((?:{PARTICLE}\s)?)({SURNAME})(?![\w(@/]|[-.]\w)")
SURNAME_FIRST = re.compile(rf"(?<![\w@/.])((?:{PARTICLE}\s)?)({SURNAME}),\s({GIVEN}(?:\s[{_U}]\.)*|[{_U}]\.)(?![\w(@/]|[-.]\w)")
LIST_PLACE = re.compile(r"(?:^|[\"';|\t\n<(:=]\s*|[-_][Bb][Yy]:\s*)$")
CYRILLIC = re.compile(r"(?<!\w)([А-ЯЁІЇЄҐ][а-яёіїєґ'’]+(?:-[А-ЯЁ][а-яё]+)?)((?:\s[А-ЯЁ]\.)*\s)([А-ЯЁІЇЄҐ][а-яёіїєґ'’]+(?:-[А-ЯЁ][а-яё]+)?)(?!\w)|(?<!\w)(?:[А-ЯЁ]\.\s?){1,2}[А-ЯЁ][а-яё]{2,}|(?<!\w)[А-ЯЁ][а-яё]{2,}\s(?:[А-ЯЁ]\.\s?){1,2}")
GREEK = re.compile(r"(?<!\w)[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+\s[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+(?!\w)")
CJK = re.compile(r"(?:报告人|报告者|作者|联系人|提交人|提交者|审核人|审阅人|经办人|负责人|姓名|感谢|鸣谢|致谢|由|請聯絡|联系|報告者|担当|担当者|보고자|작성자)\s*[:：为是]?\s*([一-鿿·]{2,5}?|[가-힣]{2,4}|[ァ-ヶー一-龯]{2,8})(?=[，,。、；;（(\s]|先生|女士|老师|提供|报告|提交|发现|的|$)")
SPOKEN_BY = re.compile(r"(?i)\b(?:cc:?\s+|(?:patch(?:ed)?|report(?:ed)?|suggest(?:ed)?|found|fix(?:ed)?|review(?:ed)?|written|spotted|diagnosed|noticed|idea|hint|tests?|tested|debugged|contributed|submitted|credit(?:s)?|thanks|thx|kudos|props|hat tip|h/t|author|name|on-?call|assigned|contact|ask)(?:\s(?:this week|by|to|from|go to|goes to)|:|-by:|\sis)+\s+)((?:[^\W\d_]\.\s)?[^\W\d_]{3,}(?:-[^\W\d_]+)?(?:\s[^\W\d_]\.)?\s(?:(?:van der|van|von|de la|de|del|di|al)\s)?[^\W\d_]{3,}(?:-[^\W\d_]+)?)(?=\s*(?:$|[,.;:()<\"\n]|and\s(?:to|by|for|the|others|team)\b|for\s(?:the|a|his|her|their|spotting|reporting|finding)\b))")


def may_spell(text: str) -> bool:
    """Whether seven words of the text are digits, one of them spelled."""
    words = WORD.findall(text.translate(FOLD).lower())
    if DIGIT_WORDS.keys().isdisjoint(words):
        return False
    spelled = sum(w in DIGIT_WORDS for w in words)
    return spelled + sum(len(w) == 1 and w.isdecimal() for w in words) >= 7


def may_speak(text: str) -> bool:
    """Whether a word that a name can follow is in the text, with what joins them."""
    low = " ".join(text.translate(FOLD).lower().split()) + " "
    return any(w in low for w in SPOKEN_WORDS)


class Normal:
    """A text in normal form with, for each character, where its source begins and ends."""

    __slots__ = ("text", "start", "end")

    def __init__(self, source: str):
        self.text, self.start, self.end = source, None, None
        if not source.isascii():
            self._characters(source)
            if MIXED.search(self.text):
                self.rewrite(re.compile(r"[\w.@+-]+"), self._latin)
        if may_spell(self.text) and SPELLED.search(self.text):
            self.rewrite(SPELLED, self._digits)
        if HINT_AT.search(self.text):
            self.rewrite(DISGUISED, self._address)

    def _offsets(self) -> None:
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))

    def _characters(self, source: str) -> None:
        out, start, end = [], [], []
        for i, c in enumerate(source):
            if c in INVISIBLE:
                continue
            n = c if c < "\x80" else "-" if c in DASHES else " " if unicodedata.category(c) == "Zs" else c if c.isalpha() and c < "＀" else unicodedata.normalize("NFKC", c) if c not in "º°ª…：，" else c
            out.append(n)
            start += [i] * len(n)
            end += [i + 1] * len(n)
        self.text, self.start, self.end = "".join(out), start, end

    def rewrite(self, pattern: re.Pattern, make) -> None:
        """Replaces the matches for which make gives [(text, from, to)] pieces, from and to within the match."""
        self._offsets()
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            pieces = make(m)
            if not pieces:
                continue
            a = m.start()
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            for text, lo, hi in pieces:
                same = len(text) == hi - lo
                for k, _ in enumerate(text):
                    start.append(self.start[a + lo + k] if same else self.start[a + lo])
                    end.append(self.end[a + lo + k] if same else self.end[a + hi - 1])
                out.append(text)
            at = m.end()
        out.append(self.text[at:])
        self.text, self.start, self.end = "".join(out), start + self.start[at:], end + self.end[at:]

    @staticmethod
    def _latin(m: re.Match) -> list:
        w = m.group()
        if not MIXED.search(w) or sum(c < "ɐ" for c in w) * 2 < len(w):
            return []
        return [("".join(LOOKALIKE.get(c, c) for c in w), 0, len(w))]

    @staticmethod
    def _digits(m: re.Match) -> list:
        if not re.search(rf"(?i)(?:{_digit})", m.group()):
            return []
        parts = list(re.finditer(r"\w+|\W+", m.group()))
        digits = [(DIGIT_WORDS.get(p.group().lower(), p.group()), p.start(), p.end()) for p in parts if p.group()[0].isalnum()]
        return digits if sum(len(d) for d, _, _ in digits) >= 7 else []

    @staticmethod
    def _address(m: re.Match) -> list:
        local, at, domain = m.groups()
        labels = re.split(DOT, domain, flags=re.I)
        plain = re.fullmatch(r"[ \t]+at[ \t]+", at) is not None
        dotted = len(re.findall(r"\.", domain)) == len(labels) - 1 and " " not in domain and "[" not in domain and "(" not in domain
        if labels[-1].lower() in FILE_ENDS or not labels[-1].isalpha() or len(labels[-1]) < 2:
            return []
        if plain and dotted and not re.search(r"[._+-]|\d", local) and not REACH.search(m.string[max(0, m.start() - 40) : m.start()]) and m.group() != m.string.strip():
            return []
        pieces, k = [(local, 0, len(local)), ("@", len(local), len(local) + len(at))], len(local) + len(at)
        for n, lab in enumerate(labels):
            a = m.group().index(lab, k)
            if n:
                pieces.append((".", k, a))
            pieces.append((lab, a, a + len(lab)))
            k = a + len(lab)
        return pieces

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _named(*words: str) -> bool:
    return all(w.lower().strip(".'’") not in NO_NAME and not any(p in NO_NAME for p in w.lower().split("-") if len(p) > 3) for w in words)


def _phone(m: re.Match, text: str) -> bool:
    n = sum(c.isdigit() for c in m.group().split("ext")[0])
    return 7 <= n <= 15 and not (n < 9 and m.group()[0] not in "+(" and "/" not in m.group())


def finds(norm: Normal, field: str = "message") -> list[tuple[str, int, int]]:
    """(kind, start, end) in the normal form, in the order of detection, without overlaps."""
    text, out = norm.text, []

    def take(kind: str, a: int, b: int) -> None:
        nonlocal text
        out.append((kind, a, b))
        text = f"{text[:a]}{chr(1) * (b - a)}{text[b:]}"

    if "@" in text:
        for m in EMAIL.finditer(text):
            before = text[max(0, m.start() - 3) : m.start()]
            if before == "://" or m.group().startswith("git@") or m.group(1).lower() in FILE_ENDS:
                continue
            take("email", *m.span())
    many = MANY_DIGITS.search(text)
    if many:
        for m in SSN.finditer(text):
            take("id_number", *m.span())
    if many or SOME_DIGITS.search(text):
        for c in ID_CONTEXT.finditer(text):
            # a value stands right behind what may lie between it and its cue, however long that is
            for at in range(c.end(), ID_BETWEEN.match(text, c.end()).end() + 1):
                m = ID_VALUE.match(text, at)
                if m and sum(x.isdigit() for x in m.group()) >= 5 and ID_BETWEEN.fullmatch(text, c.end(), at):
                    take("id_number", *m.span())
                    break
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            take("street_address", *m.span())
    if many:
        for m in PHONE.finditer(text):
            if _phone(m, text):
                take("phone", *m.span())
        for m in PHONE_WORD.finditer(text):
            if chr(1) not in m.group(1) and 7 <= sum(c.isdigit() for c in m.group(1)) <= 15:
                take("phone", *m.span(1))
    _names(text, field, take)
    return out


def _names(text: str, field: str, take) -> None:
    spans: list[tuple[int, int]] = []
    if MAYBE_FULL.search(text):
        at = 0
        while m := FULL.search(text, at):
            at = m.start() + len(m.group(1))
            if f"{m.group(1)} {m.group(3)}".lower() in METHODS:
                at = m.end()
            elif _named(m.group(1), m.group(3)):
                spans.append(m.span())
                at = m.end()
    if MAYBE_INITIAL.search(text):
        for m in INITIAL.finditer(text):
            if _named(m.group(3)) and (not m.start() or text[m.start() - 1] != "\x01"):
                spans.append(m.span())
    if MAYBE_LIST.search(text):
        for m in SURNAME_FIRST.finditer(text):
            after, whole = text[m.end() : m.end() + 2], field == "author"
            if _named(m.group(2), m.group(3)) and (whole or (LIST_PLACE.search(text[max(0, m.start() - 12) : m.start()]) and (not after.strip() or after.strip()[0] in "\"';|<(,\x01.\t\n"))):
                spans.append(m.span())
    if not text.isascii():
        for m in CYRILLIC.finditer(text):
            if not m.group(1) or _named(m.group(1), m.group(3)):
                spans.append(m.span())
            elif _named(m.group(3)):
                rest = re.compile(r"\s([А-ЯЁІЇЄҐ][а-яёіїєґ'’-]+)(?!\w)").match(text, m.end())
                if rest and _named(rest.group(1)):
                    spans.append((m.start(3), rest.end()))
        spans += [m.span() for m in GREEK.finditer(text)]
        for m in CJK.finditer(text):
            spans.append(m.span(1))
        if field == "author" and re.fullmatch(r"\s*[一-鿿가-힣·]{2,5}\s*", text.split("\x01")[0].strip(" <(，,（") or " "):
            a = len(text) - len(text.lstrip())
            spans.append((a, a + len(text.split("\x01")[0].strip(" <(，,（"))))
    for m in SPOKEN_BY.finditer(text) if may_speak(text) else ():
        words = re.findall(r"[^\W\d_]{3,}", m.group(1))
        if len(words) >= 2 and _named(*words):
            spans.append(m.span(1))
    if field == "author" and not spans:
        head = re.split(r"[<(,\x01;/|]", text)[0].strip(" .")
        words = head.split()
        if 2 <= len(words) <= 5 and all(re.fullmatch(r"[^\W\d_]+(?:['’.-][^\W\d_]*)*", w) for w in words) and _named(*words):
            a = text.index(head)
            spans.append((a, a + len(head)))
    last = -1
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= last:
            take("person_name", a, b)
            last = b


def redacted(text: str | None, field: str = "message") -> str | None:
    """The text with a typed placeholder for each find and all else unchanged."""
    if not text:
        return text
    norm = Normal(text)
    out, at = [], 0
    for kind, a, b in sorted(finds(norm, field), key=lambda f: f[1]):
        lo, hi = norm.source(a, b)
        if lo < at:
            continue
        out += [text[at:lo], PLACEHOLDER[kind]]
        at = hi
    return "".join([*out, text[at:]]) if out else text


def kinds_in(text: str | None, field: str = "message") -> set[str]:
    return {k for k, _, _ in finds(Normal(text), field)} if text else set()


def found(rows: DataFrame, fields: tuple[str, ...] = ("message", "author")) -> DataFrame:
    """(id, field, kind): one row when a field of an id's rows holds at least one of the kind."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(i, f, k) for f in fields for i, t in zip(p["id"], p[f]) if isinstance(t, str) for k in kinds_in(t, f)]
            yield pd.DataFrame(out, columns=["id", "field", "kind"]).drop_duplicates()

    return rows.where("id is not null").select("id", *fields).mapInPandas(run, "id string, field string, kind string").distinct()


def with_placeholders(rows: DataFrame, fields: tuple[str, ...] = ("message", "author")) -> DataFrame:
    """The rows with the fields redacted; other columns stay."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{f: [redacted(t if isinstance(t, str) else None, f) for t in p[f]] for f in fields})

    return rows.mapInPandas(run, rows.schema)
