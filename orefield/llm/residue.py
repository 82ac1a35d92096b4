"""Template residue, filler, error pages and notices asking for scripts, told apart from texts that merely mention them.

The texts are read once (``scan``); everything else works on the small table that leaves.

1. Lines are normalised (case, digits, tags, list marks, blanks) and counted by host: in how many of its distinct texts a line occurs.
   Documents with the same normalised lines are one text and have one vote, so copies of an error page make nothing boilerplate.
2. Lines that are in significantly more than ``boilerplate_share`` of a host's texts are its boilerplate and are subtracted: what a site
   repeats everywhere, a cookie banner for instance, is not a fault of the single document. A document of boilerplate alone keeps its
   lines: there the notice stands in the place of content.
3. A document is excluded if a line of its residual holds evidence. The patterns want the form of a notice (a status code with its
   phrase, an imperative before "JavaScript") or a grammar (marks around a name, words in a row), not single words.
4. Two word lists come from the corpus itself. *Field names* are the names found in marks that are never prose (``{{ name }}``,
   ``##NAME##``); they decide about marks that may be prose (``[name]``, ``<name>``, ``|name|``). *Filler words* are those that stand in
   runs with "lorem" or "ipsum"; runs of them are filler although neither word is in them. A name or word must occur in two texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.operators.hotkeys import bounded_broadcast
from orefield.session import cut_lineage

#: Names of fields known without a corpus.
FIELDS = frozenset("address city company customer date email firstname fullname lastname name phone price title url".split())
#: Words that open the usual filler text.
SEEDS = frozenset("lorem ipsum dolor amet consectetur adipiscing".split())
#: Function words of English, Spanish, French and German. A run without one is hardly a sentence.
FUNCTION = frozenset(
    "a about after all also always an and any anyone are as at be been but by can could did do does during for from had has have he her here his how i if in is it its just me more my never no not now of off on once one or our out over she so some still than that the their them then there "
    "they this to too twice up us very was we were what when where whether which who will with would you your "
    "al como con de del desde el en es esta estaba está este fue fueron ha hasta la las le les lo los me mi muy más nos o para pero por que se sin su sus un una y "
    "au aux avec ce cette chez dans des du elle est et il ils je leur mais ne ni nous on ont où par pas pour qui sa sans ses son sont sur très une vous à était "
    "aber am an auf aus bei bis das dem den der die ein eine einem einen einer er es für haben hat ich ihr ihre im ist kaum mit nach nicht noch nur oder sehr sie sind um und uns unser von vor war waren wir wird zu zum zur über".split()
)
#: Reason phrases of status codes.
REASONS = (
    "bad gateway|bad request|conflict|forbidden|gateway time-?out|gone|internal server error|method not allowed|not acceptable|not found|payment required|"
    "request time-?out|service (?:temporarily )?unavailable|too many requests|unauthorized|unavailable for legal reasons"
)
#: Words before a quotation; what follows them is told, not shown.
_TOLD = r"(?<!\b(?:wants|wanted|says|said|asks|asked|reads|printed|called|labelled|listed|shows|showed|wrote|like|was)\s)"
#: One word of each reason phrase.
REASON_WORDS = "bad gateway;bad request;conflict;forbidden;time-out;timeout;gone;internal server;method not;not acceptable;not found;payment required;unavailable;too many;unauthorized"
#: Elements of HTML, which are no placeholders.
TAGS = "a|abbr|address|article|aside|audio|b|base|blockquote|body|br|button|canvas|caption|code|col|dd|del|details|div|dl|dt|em|embed|fieldset|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|label|legend|li|link|main|meta|nav|noscript|object|ol|option|p|param|pre|q|script|section|select|small|span|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|thead|title|tr|u|ul|var|video"
_START = r"(?:^|[.!?>:;|]\s+|[.!?>]|\s[-*•]\s)\s*"
_SCRIPT = r"(?:java\s?scripts?|js|scripts?|scripting|cookies|skripte?n?)"
_RUNS = "asdf|sdfg|dfgh|fghj|ghjk|hjkl|qwer|wert|erty|rtyu|tyui|yuio|uiop|zxcv|xcvb|cvbn|vbnm"
#: A name: up to four words, joined by blanks, dots, dashes or underscores.
_NAME = r"(\p{L}\w*(?:[ ._-]\w+){0,3})"
_BLOCKS = "heading|subheading|headline|title|subtitle|paragraph|button|caption|image|body text|body|text|link"

#: Per kind: (literals, separated by semicolons, and pattern) over lower-case lines. A match of the pattern contains at least one of the
#: literals, so the pattern is only tried on lines that have one. What a group of a pattern holds must be a field name.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "placeholder": [
        ("{{", r"\{\{[^{}]*\}\}"),
        ("${;#{;%{;@{;!{;&{;^{;*{", r"[$#%@!&^*]\{[^{}]*\}"),
        ("{!;{$;{#;{%;{@;{&;{^;{*;{?;{=;{:;{/;{~;{|;{-;{+", r"\{[!$#%@&^*?=:/~|+-][^{}]*\}"),
        ("<%;<?;<#;<$;<@;<!;<=;<&", r"<[%?#$@=&][^<>]*>|<![^<>-]+>"),
        ("<<", r"<<[^<>]+>>"),
        ("((", r"\(\(\p{L}\w*(?:[ ._-]\w+){0,3}\)\)"),
        ("[[", r"\[\[[^\[\]]+\]\]"),
        ("[%;[$;[#;[@;[*;[!;[&;[=;[~;[|", r"\[(?P<mark>[%$#@*!&=~|])\s?\p{L}[^\[\]]*?(?P=mark)\]|\[[%$]\p{L}[^\[\]]*\]"),
        ("$(;%(;$[", r"\$\(\p{L}[\w .-]*\)|%\(\p{L}[\w .-]*\)[sdf]|\$\[\p{L}[\w .-]*\]"),
        ("[object", r"\[object object\]"),
        ("__", r"(?<![\w])__\p{L}\w*?__(?!\w)"),
        ("____", _TOLD + r"(?<!_)_{4,}(?!\s+where\b)"),
        ("##;@@;%%;$$;^^;&&;||;¤¤;§§", r"(?P<mark>[#@%$^&|¤§])(?P=mark)\s?\p{L}[\w .-]*?(?P=mark)(?P=mark)"),
        ("*|", r"\*\|\p{L}[\w :.-]*\|\*"),
        ("%", r"(?<![\w%])%\p{L}[\w.-]+%(?!\w)|(?<![0-9a-z%])%(?:[sd]\b|\d\$s)"),
        ("[insert;[enter;[add;[your;[type;{insert;{enter;{add;{your;<insert;<enter;<add;<your;(insert;(enter", r"[\[{<(](?:insert|enter|type) [^\[\]{}<>()]+[\]}>)]|[\[{<](?:your|add) [^\[\]{}<>]+[\]}>]"),
        ("your_;_here", r"\byour_\p{L}\w*|(?<![\p{L}_])<?\p{L}\w*_(?:goes_)?here\b"),
        ("undefined;null;nan", r"(?<![\"“'<\p{L}\d])(?:undefined|null|nan)(?![\"”'>\p{L}\d])(?! and void)"),
        ("xxxx", r"(?<![\p{L}])x{4,}(?![\p{L}])"),
        ("{", rf"{_TOLD}(?<![{{$#%@!&^*])\{{(?:\d{{1,2}}|{_NAME})\}}"),
        ("<", rf"{_TOLD}(?<!<)<(?!/?(?:{TAGS})\b){_NAME}/?>"),
        ("«;‹", rf"{_TOLD}[«‹]{_NAME}[»›]"),
        ("[", rf"{_TOLD}(?<!\[)\[{_NAME}\]"),
        ("(your", rf"{_TOLD}\(your {_NAME}\)"),
        (";".join(mark + c for mark in "$~^|!#@=" for c in "abcdefghijklmnopqrstuvwxyzäöüéáíóúñç"), rf"(?<![\p{{L}}\d\p{{S}}\p{{Po}}])(?P<mark>[$~^|!#@=]){_NAME}(?P=mark)(?![\p{{L}}\d])"),
    ],
    "filler": [
        (_RUNS.replace("|", ";"), rf"(?:\b\p{{L}}*(?:{_RUNS})\p{{L}}*\b[\s,.;]*){{2,}}"),
        (";".join(f"{w} here" for w in "goes text copy name title description address logo photo image content message".split()), _START + r"(?:your )?(?:text|copy|name|title|description|address|logo|photo|image|content|message|headline|paragraph|caption)(?: \p{L}+)? goes here\b|" + _START + r"your (?:\p{L}+ )?(?:text|copy|name|title|description|address|logo|photo|image|content|message) here\b"),
        ("enter a short", r"enter a short description"),
        ("ihr text;texte ici;su texto;aqu", r"hier (?:steht|kommt) ihr text|votre texte ici|(?:escriba|inserte) aqu[íi] su texto|aqu[íi] va (?:la|el|su)\b"),
        ("ins;sie hier", r"\bins[ée]rez (?:la|le|votre|une) (?:description|texte)|f[üu]gen sie hier"),
        ("placeholder;dummy;sample;filler", r"\b(?:this is |is )(?:a )?(?:placeholder|dummy|sample|filler)(?: copy| text)|" + _START + r"(?:placeholder|dummy|filler) (?:copy|text)\b|" + _START + rf"sample (?:{_BLOCKS})\b\s*(?:[.!]|$)"),
        ("text;platzhalter", r"\b(?:muster|blind|beispiel)text\b|texte (?:provisoire|d'exemple|factice)|texto (?:de ejemplo|de relleno|provisional)|" + _START + r"platzhalter"),
        ("heading;headline;title", rf"\b(?:{_BLOCKS})(?: \d+)?(?:\s*[/|>;-]\s*(?:{_BLOCKS})(?: \d+)?\b){{2,}}"),
        ("foo;bar;baz;dummy;copy;sample;filler;placeholder", r"(?:\b(?:foo|bar|baz|qux|dummy|copy|text|sample|words?|content|placeholder|filler)\b[\s,.]*+){4,}"),
        ("replace this", r"replace this (?:paragraph|text|sentence|copy|image|title|line)"),
        ("add your;add a;add an", _START + r"add (?:your|an?) \p{L}+(?: \p{L}+)?\s*[.!]\s*add (?:your|an?)\b|^\W*add your \p{L}+(?: \p{L}+)?\W*$|" + _START + r"add (?:your (?:opening hours|address|logo|text|description|phone)|a photo)\b"),
        ("todo;tbd;fixme", _START + r"(?:(?:todo|fixme)\b\s*:|tbd\b(?!\s+\p{L}))"),
    ],
    "error": [
        (REASON_WORDS, rf"(?<![\p{{L}}\d])[45]\d\d\s*[,:\-–(]*\s*(?:{REASONS})\b|" + _START + rf"(?:{REASONS})\s*(?:[.:(<]|$)"),
        ("error;fehler;erreur;code;http", r"\b(?:(?:error|fehler|erreur)(?: code)?|(?:status|response|error) code|http(?:/\d(?:\.\d)?)?)\s*:?\s+[45]\d\d\b"),
        ("::", r"\be[45]\d\d\s*::"),
        ("\"error\"", r"\"error\"\s*:"),
        ("serverfehler;erreur interne;error interno", _START + r"(?:interner serverfehler|erreur interne|error interno)"),
        ("status=;status:", r"\bstatus[=:]\s?[45]\d\d\b"),
        ("access denied;acceso denegado;accès;acces refus;zugriff verweigert", _START + r"(?:access denied|acceso denegado|acc[èe]s refus[ée]|zugriff verweigert)\b"),
        ("unavailable;not found;page has;page was;this page;page is;site is", _START + r"(?:page|site|service) (?:unavailable|not found)\b|" + _START + r"page (?:has|was) (?:moved|removed)|this page (?:has moved|is no longer available|does not exist|cannot be)|(?:site|page) is (?:down|under) (?:for )?maintenance"),
        ("unexpected error", r"unexpected error occurred|" + _START + r"(?:an )?unexpected error"),
        ("page you;t find the", r"page you (?:requested|are looking for) (?:does not exist|could not be found|cannot be found)|can['’]t find the (?:page|business|listing|place) you"),
        ("nicht gefunden;no encontrada;introuvable", r"seite nicht gefunden|p[áa]gina no encontrada|page introuvable"),
        ("your request;server is not;server antwortet;servidor no;serveur ne", r"could not complete your request|server (?:is not responding|antwortet nicht)|servidor no responde|serveur ne r[ée]pond pas"),
        ("oops;something went;ha ocurrido;ein fehler;une erreur", _START + r"(?:oops|something went wrong)\b|ha ocurrido un error|ein fehler ist aufgetreten|une erreur (?:est survenue|s'est produite)"),
        ("traceback", r"traceback \(most recent call last\)"),
        ("error:;exception", r"\b[a-z]{2,40}(?:error|exception):\s|\bfatal error:|\buncaught exception\b"),
        ("certificate;this site", r"certificate not valid|connection to this site is not (?:private|secure)"),
        ("connection", r"\bconnection: close\b|\bconnection (?:failed|refused|timed out)\b"),
        ("in your;permission;authorized", r"content is not available in your (?:region|country)|do not have permission to|not authorized to (?:view|access)"),
        ("session;sitzung;sesi;sign in", r"\byour session (?:has |is )?(?:expired|ended|timed out)|sitzung ist abgelaufen|sesi[óo]n ha (?:caducado|expirado)|session a expir[ée]|sign in again to continue"),
        ("versuchen;try again;ntelo;veuillez", r"(?:versuchen sie es|try again) (?:sp[äa]ter|later)|int[ée]ntelo (?:de nuevo|m[áa]s tarde)|veuillez r[ée]essayer"),
        ("cannot be", _START + r"(?:reviews|comments|results|menu) cannot be (?:shown|loaded|displayed)"),
        ("request id;reference:", r"\brequest id\s+[0-9a-f]{4,}|\breference: [0-9a-f]{4,}\b"),
        ("maintenance", r"scheduled maintenance (?:until|from)"),
    ],
    "script": [
        ("script;js;cookies;skript", rf"\b(?:re-?)?(?:enable|activate|switch on|turn on|allow|accept|need|needs|requires?)\s+(?:[\p{{L}}-]+\s+){{0,3}}?{_SCRIPT}\b"),
        ("script;js;cookies", rf"\b{_SCRIPT} (?:is|are) (?:disabled|not enabled|turned off|switched off|blocked|required to|needed to)"),
        ("browser", r"\bbrowser (?:is not|isn't|is no longer) supported|\bbrowser is (?:out of date|too old|outdated)|\bbrowser (?:does not|doesn't|cannot|can't) (?:support|run|show|display)|\b(?:checking|verifying) your browser\b"),
        ("noscript", r"\bnoscript\s*:"),
        ("robot;human", r"\b(?:confirm|verify|prove|check)(?:ing)? (?:that |if )?you are (?:not a robot|a? ?human)"),
        ("blocker", r"\b(?:turn|switch) off your ad ?blocker|\bdisable your ad ?blocker"),
        ("cessite;activ;habilite;permita;acepte;autorisez;acceptez;aktivieren;erlauben;akzeptieren", rf"\bn[ée]cessite (?:[\p{{L}}-]+\s+){{0,2}}?{_SCRIPT}\b|\b(?:active[rz]?|habilite|permita|acepte|autorisez|acceptez) (?:los |las |les |le )?{_SCRIPT}\b|\b(?:aktivieren|erlauben|akzeptieren) sie {_SCRIPT}\b"),
        ("scripts;skripte", r"\bno admite scripts|\bne prend pas en charge (?:les )?scripts|\bunterst[üu]tzt keine skripte"),
    ],
}

_WORDS = re.compile(r"[^\s\d,.;:!?()\[\]{}\"“”«»*•|/][^\s,.;:!?()\[\]{}\"“”«»*•|/]*")
#: Words and the marks that end a phrase.
_TOKENS = re.compile(_WORDS.pattern + r"|[.!?:;\"“”«»()\[\]|]")
_ENDS = frozenset('.!?:;"“”«»()[]|')
_STOPS = FUNCTION | _ENDS
#: Words in a row of which no one is a function word: a run at least so long may be filler.
RUN = 5
_CHUNKS = re.compile(r"[.!?:;\"“”«»()\[\]|]|\s[-–•*]\s")
_BREAKS = re.compile("\r\n|[\n\r\u2028]")
_TAG, _MARK, _DIGIT, _BLANK = re.compile("</?[a-z][a-z0-9]*>"), re.compile(r"^\s*[-*•]+\s+"), re.compile("[0-9]"), re.compile(r"\s+")
#: Marks that are never prose, around a name: where field names are learned.
_SURE = regex.compile(
    r"\{\{[\s#/^&>!]*([\p{L}][\w .-]*?)\s*\}\}|[$#%@!]\{\s*([\p{L}][\w .-]*?)\s*\}|\{[!$#%@]\s*([\p{L}][\w .-]*?)\s*%?\}|<<\s*([\p{L}][\w .-]*?)\s*>>|<%=?\s*([\p{L}][\w .-]*?)\s*%>|"
    r"\[\[\s*([\p{L}][\w .-]*?)\s*\]\]|([#@])\7\s*([\p{L}][\w .-]*?)\s*\7\7|\*\|([\p{L}][\w .-]*?)\|\*|(?<!\w)__([\p{L}][\w .-]*?)__(?!\w)|%\(([\p{L}][\w .-]*?)\)s|(?<![\w%])%([\p{L}][\w.-]*?)%(?!\w)|\[insert ([\p{L}][\w .-]*?)(?: here)?\]"
)


def field_name(name: str) -> str:
    """A name as it is compared: lower case, letters and digits only, without "your" and "here" around it."""
    return re.sub(r"[\W_]+", "", re.sub(r"^(?:your|insert|enter)[ _.-]+|[ _.-]+(?:goes[ _.-]+)?here$", "", name.lower()))


def _repeated(words: list[str]) -> bool:
    """Whether a word of 2 to 12 letters stands four times in a row, or six words in a row are but two: filler by repetition."""
    places = [i for i, same in enumerate(map(eq, words, words[1:])) if same]
    for i in places:
        if len(set(words[i : i + 4])) == 1 and len(words) >= i + 4 and 2 <= len(words[i]) <= 12 and words[i].isalpha():
            return True
        around = words[max(0, i - 4) : i + 6]
        for k in range(len(around) - 5):
            part = around[k : k + 6]
            if len(set(part)) <= 2 and all(w.isalpha() and len(w) > 2 and w not in FUNCTION for w in part):
                return True
    return False


@lru_cache(maxsize=1)
def _compiled() -> tuple[list[tuple[str, object]], object | None, dict[str, list[int]]]:
    """Patterns in order (kind, compiled), the automaton of all literals, and the patterns of each literal."""
    patterns, literals = [], {}
    for kind, listed in PATTERNS.items():
        for words, pattern in listed:
            for word in words.split(";"):
                literals.setdefault(word, []).append(len(patterns))
            patterns.append((kind, regex.compile(pattern)))
    try:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, places in literals.items():
            automaton.add_word(word, places)
        automaton.make_automaton()
    except ImportError:
        automaton = None
    return patterns, automaton, literals


def _tried(text: str) -> set[int]:
    """The patterns one of whose literals is in a lower-case text."""
    _, automaton, literals = _compiled()
    tried: set[int] = set()
    if automaton is not None:
        for _, places in automaton.iter(text):
            tried.update(places)
    else:
        for word, places in literals.items():
            if word in text:
                tried.update(places)
    return tried


def _needed(match) -> str:
    """The field name that a match depends on, empty if on none."""
    return field_name(next((g for k, g in enumerate(match.groups(), 1) if g and k != match.re.groupindex.get("mark")), ""))


def _marked(line: str, tried: set[int]) -> list[tuple[str, str]]:
    """(kind, field name or empty) of a lower-case line: the first kind that depends on no name, else all names it may depend on."""
    patterns = _compiled()[0]
    open_ = []
    for place in sorted(tried):
        kind, pattern = patterns[place]
        for match in pattern.finditer(line):
            need = _needed(match)
            if not need or need in FIELDS:
                return [(kind, "")]
            open_.append((kind, need))
    return list(dict.fromkeys(open_))


def _runs(line: str) -> list[list[str]]:
    """Runs of words without a function word, inside one phrase of a lower-case line."""
    out = []
    for chunk in _CHUNKS.split(line):
        words = _WORDS.findall(chunk)
        if len(words) < 4:
            continue
        held: list[str] = []
        for word in [*words, "the"]:
            if word in FUNCTION:
                if len(held) >= 4:
                    out.append(held)
                held = []
            elif word.isalpha():
                held.append(word)
    return out


def evidence_of(line: str | None) -> str | None:
    """The kind of evidence that a line holds by itself, without what a corpus teaches; None if there is none."""
    if not line:
        return None
    line = line.lower()
    found = _marked(line, _tried(line))
    if found and not found[0][1]:
        return found[0][0]
    if any(SEEDS.intersection(run) for run in _runs(line)) or _repeated(_WORDS.findall(line)):
        return "filler"
    return None


def normal_line(line: str) -> str:
    """Of a lower-case line: tags and list marks removed, digits as 0, blanks collapsed."""
    if "<" in line:
        line = _TAG.sub(" ", line)
    return " ".join(_DIGIT.sub("0", _MARK.sub("", line)).split())


def _hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line)


_FOUND = pa.list_(pa.struct([("line", pa.string()), ("h", pa.binary()), ("kind", pa.string()), ("need", pa.string()), ("run", pa.list_(pa.string()))]))
_SCAN = pa.schema([("hs", pa.list_(pa.binary())), ("found", _FOUND), ("fields", pa.list_(pa.string())), ("filler", pa.list_(pa.string()))])


def scan_text(text: str) -> tuple[list[bytes], list[dict], list[str], list[str]]:
    """What one text gives: sorted hashes of its distinct normalised lines, findings, field names and filler words it teaches.

    A finding is (line, hash of the line, kind, need, run): it holds if ``need`` is empty or a learned field name, and if ``run`` is empty
    or made of learned filler words.
    """
    lower = text.lower()
    tried = _tried(lower)
    tokens = _TOKENS.findall(lower)
    words = [t for t in tokens if t not in _ENDS]
    doubled = any(map(eq, words, words[1:]))
    naked = bytes(4 if any(seed in lower for seed in SEEDS) else RUN) in bytes(map(_STOPS.__contains__, tokens))
    found: list[dict] = []
    fields: set[str] = set()
    filler: set[str] = set()
    hs: set[bytes] = set()
    for line in _BREAKS.split(text):
        low = line.lower()
        normal = normal_line(low)
        if not normal:
            continue
        h = _hash(normal)
        if any(map(str.isalpha, normal)):
            hs.add(h)
        if not (tried or doubled or naked):
            continue
        holds = [(kind, need, []) for kind, need in (_marked(low, _tried(low)) if tried else [])]
        if naked:
            for run in _runs(low):
                if SEEDS.intersection(run):
                    filler.update(run)
                    holds.append(("filler", "", []))
                elif len(run) >= RUN:
                    holds.append(("filler", "", run))
        if doubled and _repeated(_WORDS.findall(low)):
            holds.append(("filler", "", []))
        if tried:
            fields.update(field_name(next(g for g in m.groups() if g and g not in "#@")) for m in _SURE.finditer(low))
        sure = [x for x in holds if not x[1] and not x[2]]
        found += [{"line": line, "h": h, "kind": kind, "need": need, "run": run} for kind, need, run in (sure[:1] or holds)]
    return sorted(hs), found, sorted(fields - {""}), sorted(filler)


def scan(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """(doc_id, host, hs, found, fields, filler) of each document with a text, written: the only pass over the texts."""
    base = documents.select(F.struct(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).alias("who"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    kind = base.schema["who"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scan_text(t) for t in batch.column(1).to_pylist()]
            columns = zip(*parts) if parts else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(columns, _SCAN)]], names=["who", *_SCAN.names])

    ddl = f"who {kind}, hs array<binary>, found array<struct<line: string, h: binary, kind: string, need: string, run: array<string>>>, fields array<string>, filler array<string>"
    return cut_lineage(base.mapInArrow(run, ddl).select("who.*", "hs", "found", "fields", "filler"))


def boilerplate_lines(scanned: DataFrame, share: float, least_texts: int = 3, z: float = 2.58) -> DataFrame:
    """(host, h): the lines in significantly more than ``share`` of the distinct texts of a host, and in at least ``least_texts``.

    Significantly: the lower end of the Wilson interval of the observed share, ``z`` standard deviations wide, is above ``share``. Copies
    merge before the exchange, then the counts by (host, line).
    """
    texts = scanned.select("host", "hs").distinct()
    # the null entry of each text counts the texts of its host
    votes = texts.select("host", F.explode(F.concat("hs", F.array(F.lit(None).cast("binary")))).alias("h"))
    counts = votes.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_texts) | F.col("h").isNull())
    counts = cut_lineage(counts)
    all_texts = counts.where("h IS NULL").select("host", F.col("n").alias("all_texts"))
    p, n = F.col("n") / F.col("all_texts"), F.col("all_texts")
    lower = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return counts.where("h IS NOT NULL").join(all_texts, "host").where(lower > share).select("host", "h")


def _taught(scanned: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(word): what at least ``least`` distinct texts teach."""
    told = scanned.where(F.size(column) > 0).select("hs", column).distinct()
    return told.select(F.explode(column).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def residue_lines(documents: DataFrame, doc_id: str, text: str, host: str, boilerplate_share: float = 0.2, run_share: float = 0.8, max_broadcast: int = 100_000) -> DataFrame:
    """Lines with evidence in the residual of each document: (doc_id, line, kind).

    A line is boilerplate as in ``boilerplate_lines``. From a document that would be left without a line with a letter nothing is
    subtracted. Null hosts form one host. Null and empty texts have no lines; a text without line breaks is one line. A run of words is
    filler if at least ``run_share`` of them are learned filler words. Learned words and boilerplate are broadcast up to
    ``max_broadcast`` rows (counted) and joined by shuffle beyond.
    """
    scanned = scan(documents, doc_id, text, host)
    found = scanned.where(F.size("found") > 0).select("doc_id", "host", "hs", F.posexplode("found").alias("place", "f")).select("doc_id", "host", "hs", "place", "f.*")
    sure = found.where("need = '' AND size(run) = 0").select("doc_id", "host", "hs", "line", "h", "kind")
    fields = bounded_broadcast(_taught(scanned, "fields").withColumnRenamed("word", "need"), max_broadcast)
    named = found.where("need <> ''").join(fields, "need", "left_semi").select(*sure.columns)
    filler = bounded_broadcast(_taught(scanned, "filler").withColumn("known", F.lit(1)), max_broadcast)
    runs = found.where("size(run) > 0").withColumn("run_id", F.struct("doc_id", "place", F.xxhash64("hs", "line")))
    matched = runs.select("run_id", F.explode("run").alias("word")).join(filler, "word", "left").groupBy("run_id").agg(F.count("known").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("k") >= F.col("n") * run_share)
    filled = runs.join(matched.select("run_id"), "run_id", "left_semi").select(*sure.columns)
    held = cut_lineage(sure.unionByName(named).unionByName(filled))

    boilerplate = bounded_broadcast(cut_lineage(boilerplate_lines(scanned, boilerplate_share)), max_broadcast)
    own = held.join(boilerplate, ["host", "h"], "left_anti")
    # documents all of whose evidence is boilerplate: they keep it if they are boilerplate alone
    repeated = held.join(boilerplate, ["host", "h"], "left_semi")
    rest = repeated.select("host", "hs").distinct().select("host", "hs", F.explode("hs").alias("h")).join(boilerplate, ["host", "h"], "left_anti").select("host", "hs").distinct()
    bare = repeated.join(rest, ["host", "hs"], "left_anti")
    return own.unionByName(bare.select(*own.columns)).select("doc_id", "line", "kind").distinct()


def residue_documents(documents: DataFrame, doc_id: str, text: str, host: str, **options) -> DataFrame:
    """Ids of the documents to leave out, each once, with the kinds of evidence found (sorted)."""
    return residue_lines(documents, doc_id, text, host, **options).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def clean_documents(documents: DataFrame, doc_id: str, text: str, host: str, **options) -> DataFrame:
    """The documents without those of ``residue_documents``, all columns kept."""
    out = residue_documents(documents, doc_id, text, host, **options).select(F.col("doc_id").alias("__residue_id"))
    return documents.join(out, documents[doc_id] == out["__residue_id"], "left_anti")
