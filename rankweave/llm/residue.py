"""Problem 2: unfilled placeholders, filler, error messages and demands for scripts.

Method: lines are normalised (digits masked) and the distinct pages with each line are counted by host,
over all rows (captures of one page count once, else its own text would recur); a page's recurrent lines
without evidence are subtracted as boilerplate; a page is excluded if what remains holds an
unfilled placeholder, or is mostly an error, a demand for scripts or filler. Titles do not count as
content. A text that only quotes such things has prose besides, or quotes them as code.

Defined results: NULL and blank texts are no case, whatever the hint columns say; rows without host
form one host; a key is reported once, however often its row is repeated; the hints ``contentError`` and ``js_render_suspected``
are reported, never decisive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.lines import WORD, is_latin, is_prose, title_like
from rankweave.llm.mincut import furniture_lines
from rankweave.llm.screen import Screen
from rankweave.session import written

RECURRENT = 3  # pages of a host from which a line is boilerplate
SALTS = 16  # parts of a line that many pages have
PROSE_LEFT = 120  # characters of other prose that a message may have beside it

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|\{#[^#{}\n]+#?\}|[$#]\{[^{}\n]+\}|<%[^%\n]*%>|%%[^%\s]{2,}%%|@@[^@\s]{2,}@@|__[A-Za-z][A-Za-z0-9_.-]+__|<<[^<>\n]{2,}>>"
    r"|\[\[[^\[\]\n]{2,}\]\]|%\([a-z_.-]+\)[sd]|(?<![\w$])\$[A-Z][A-Z_.-]{2,}\$|(?<![\w%])%[A-Za-z][A-Za-z]*[_.-][A-Za-z_.-]+%|(?<![\w%])%[A-Z]{3,30}%|(?<![\w{])\{[A-Za-z]+(?:[_.-][A-Za-z]+)*\}(?!\})"
    r"|<(?!/?(?:p|b|i|u|a|br|hr|em|li|ul|ol|div|span|strong|code|pre|table|tr|td|th|h\d|img)\b)[A-Za-z]+(?:[_.-][A-Za-z]+)*>|&lt;[A-Za-z][^&\n]+&gt;|<(?:your|insert|add|enter)\b[^<>\n]+>|\[object Object\]"
    r"|(?i:\[(?:insert|your|add|enter|replace|put|please|name of|company|product|city|date|author|price|image|photo|hier|aquí|insérer|ici)\b[^\[\]\n]*\](?!\()|\[[^\[\]\n]{2,} (?:missing|here|goes here|tbd|fehlt|falta|manquant)\](?!\())|\[[A-Z]{2,}(?:[ _-][A-Z]+)+\](?!\()"
    r"|(?<!\w)(?:TODO|FIXME|TBD|XXX)(?!\w)[:.]|\bTODO\b(?=: )",
)
_QUOTED = re.compile(r"`[^`\n]*`|(?<!\w)[\"“„«'‘]\s?[{\[<$%@#_][^\"”“»'’\n]*[}\]>$%@_]\s?[\"”“»'’]")
_BROKEN = re.compile(r"^(?:null|undefined|NaN|None):(?=\s|$)|\bxxx [a-z ]{2,40} xxx\b", re.M)
FILLER = re.compile(
    r"\b(?:goes here|placeholder (?:text|copy)|replace it with your|your own (?:text|copy) (?:here|before)|click here to edit|edit this (?:text|paragraph|section)|write your [\w ]{2,30} in this|insert [\w ]{2,30} here\b|type your (?:text|copy)|to be replaced\b|(?:sample|example) page\b|edit me\b|in this box\b|your [\w ]{3,30} here\b|(?:image|photo) caption\b|button text\b|dummy (?:text|entry)|please ignore\b|\basdf\b|sample text|filler text|your text here|not for publication"
    r"|describe (?:your|the) \w+ (?:here|in this)|put your [\w ]{2,30} (?:here|in this)|add your [\w ]{2,30} (?:here|in this)|hier steht (?:ihr|dein|später)|blindtext|platzhalter(?:text)?|mustertext|texto de (?:relleno|ejemplo|muestra)|escriba aquí|texte (?:factice|d'exemple|provisoire)|écrivez ici|votre texte ici|su texto aquí|ihr text hier)"
    r"|(?:^|[\s:])tbd(?:\.|\s|$)|\bcoming soon: ",
    re.I,
)
MESSAGE = re.compile(
    r"\b(?:enable|allow|activate|activating|turn(?:ing)? on|switch on|requires?|needs?|without|support)\b.{0,30}\b(?:java ?script|scripts|scripting)\b|\b(?:java ?script|scripts|scripting)\b.{0,40}\b(?:disabled|enabled|required|needed|switched off|turned off|blocked|is off|not supported|must be on|on and reload)\b"
    r"|(?:doesn't|does not|cannot|can't) run scripts|blocking scripts|java ?script needed|with scripting|allow scripts|built in the browser|this page is rendered|\b(?:aktivieren|einschalten|erlauben|zulassen)\b.{0,30}java ?script|java ?script.{0,30}\b(?:aktivieren|einschalten|erforderlich|benötigt|deaktiviert)|\b(?:active|habilite|permita|activar|habilitar)\b.{0,30}java ?script|java ?script.{0,30}\b(?:desactivado|necesario|requiere|activado)|\b(?:activer|activez|autoriser|autorisez)\b.{0,30}java ?script|java ?script.{0,30}\b(?:désactivé|nécessaire|requis)"
    r"|\bHTTP \d{3}\b|\bpage not found\b|^not found\b|\bpage unavailable\b|\baccess (?:denied|to this page)|\bforbidden\b|\bbad gateway\b|\bgateway time-?out\b|\bservice (?:temporarily )?unavailable\b|\binternal (?:server )?(?:error|fault)\b|\bfatal error\b|\btraceback\b|\bstack trace\b|\buncaught \w*error\b|\bexception in\b|\bwarning: \w+\(\)|establishing a database|database (?:connection )?error"
    r"|\b(?:something|that) went wrong\b|\ban error (?:has )?occurred\b|\bchecking your browser\b|\bverify (?:that )?you are (?:a )?human|\byou are human\b|\bunusual traffic\b|\btoo many requests\b|\brate limit\b|\bcaptcha\b|\bfirewall\b|\bsecurity (?:rule|check)\b|\bare you a robot|\bnot a robot\b|\bdown for maintenance\b|\bbeing repaired\b|\bunder maintenance\b|\bplease come back later\b|\btry again (?:later|in \d+)|\btimed? ?out\b|\bno longer (?:here|available)\b"
    r"|\bcan't seem to find|\bcould(?:n't| not) (?:be (?:loaded|found|reached)|find|load)|\bgave no answer\b|\binvalid answer\b|\bupstream\b|\berror code\b|\bincident [0-9a-f]|\brequest id\b|\breference [0-9a-f]{5,}|\bsession (?:has )?expired\b|\bdon't have permission|\bmay be mistyped\b|\bdoes not exist\b|\bno such (?:page|file)\b|\bconnection (?:refused|reset|was reset|closed)|\bssl\b.{0,30}\b(?:error|certificate)|\bcertificate\b.{0,30}\b(?:error|expired|invalid)|\bgo to the start page\b|^gone\b"
    r"|\b(?:eingeschaltete[nr]?|aktivierte[nr]?)\b.{0,20}skript|\bskripte?n?\b.{0,30}(?:aktiv|einschalt|erlaub|zulass)|\bsans (?:les )?scripts?\b|\bscripts? (?:du navigateur|del navegador|activados?|activés?)|\b(?:sin|con) (?:los )?scripts?\b|\bscripts are\b|not available in your (?:region|country|area)|no funciona si|desactivados los scripts|scripts están|account has been suspended|hosting provider|bandwidth limit|domain (?:is|may be) for sale|^index of /|default web (?:page|site)|internal fault|fault stopped|^whoops|^oops|\bhit a snag|that didn't work|slow down and retry|no page at this address"
    r"|seite (?:wurde )?nicht gefunden|zugriff (?:verweigert|nicht)|fehler ist aufgetreten|ein fehler\b.{0,30}aufgetreten|nicht (?:verfügbar|erreichbar)\b|wartungsarbeiten|versuchen sie es (?:später|in|erneut|noch)|página no encontrada|no se ha encontrado|no encontrada|acceso denegado|ha producido un error|inténtelo (?:de nuevo|más tarde)|en mantenimiento|servicio no disponible|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|erreur (?:est survenue|s'est produite|interne)|réessayez|en maintenance|service indisponible|n'avez pas l'autorisation|no tiene permiso|keine berechtigung",
    re.I,
)


_OPENERS = ("{", "[", "<", "%", "@@", "__", "$", "&lt;", "TODO", "FIXME", "TBD", "XXX", "null:", "undefined:", "NaN:", "None:", "xxx ")


def placeholders(text: str) -> bool:
    """Whether a text has an unfilled placeholder that is not quoted as code."""
    if not any(c in text for c in _OPENERS):
        return False
    bare = _QUOTED.sub(" ", text)
    return bool(PLACEHOLDER.search(bare) or _BROKEN.search(bare))


_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_STATUS = re.compile(r"\s*(?:error )?[45]\d\d\b(?! [a-zé]+ (?:best|tips|ways))", re.I)
_COUNTED = re.compile(r"\b(\w+ \d+)\. ")
MESSAGE_MARK, FILLER_MARK, PLACE_MARK = 1, 2, 4


# Stems of which a line of dummy Latin has at least one.
_LATIN_STEMS = ("lorem", "ipsum", "consec", "adipis", "mauris", "integ", "donec", "nulla", "sodal", "vestib", "tincid", "egest", "praes", "luct", "fusc", "quam", "dolor", "elit")
_SCREEN = Screen([MESSAGE, FILLER], {2: _LATIN_STEMS, 3: tuple(x.lower() for x in _OPENERS), 4: tuple("0123456789")})


def _stutters(low: str) -> bool:
    """One word four times in a row."""
    w = low.split()
    return len(set(w)) + 3 <= len(w) and any(a == b == c == d and len(a) > 2 for a, b, c, d in zip(w, w[1:], w[2:], w[3:]))


@lru_cache(1 << 17)
def line_marks(line: str) -> int:
    """Which evidence a line has: bits of MESSAGE_MARK, FILLER_MARK, PLACE_MARK."""
    low = line.lower()
    may = _SCREEN.mask(low)
    marks = PLACE_MARK if may & 8 and placeholders(line) else 0
    if _STATUS.match(line) or may & 1 and MESSAGE.search(line):
        marks |= MESSAGE_MARK
    if may & 2 and FILLER.search(line) or may & 4 and is_latin(line):
        marks |= FILLER_MARK
    elif (may & 16 and len(counted := _COUNTED.findall(line)) > 1 and 2 * len(set(counted)) <= len(counted) or _stutters(low)):
        marks |= FILLER_MARK
    return marks


def message_parts(lines: list[str]) -> tuple[int, int, int]:
    """(characters of messages, of filler, of other prose) of lines without furniture."""
    message = filler = prose = 0
    for x in lines:
        marks = line_marks(x)
        if not marks & (MESSAGE_MARK | FILLER_MARK):
            if not title_like(x) and (is_prose(x) or len(WORD.findall(x)) >= 8):
                prose += len(x)
            continue
        hit = False
        for s in _SENTENCES.split(x):
            if is_latin(s) or (marks & FILLER_MARK and (line_marks(s) & FILLER_MARK or not is_prose(s))):
                filler += len(s)
            elif marks & MESSAGE_MARK and (_STATUS.match(s) or MESSAGE.search(s)):
                message, hit = message + len(s), True
            elif hit and len(s) < 90:
                message += len(s)  # what a message goes on to say
            elif is_prose(s) or len(WORD.findall(s)) >= 8:
                prose += len(s)
    return message, filler, prose


def no_body(lines: list[str]) -> bool:
    """Lines (without furniture) that are an error message, a demand for scripts or filler."""
    if not any(line_marks(x) & (MESSAGE_MARK | FILLER_MARK) for x in lines):
        return False
    message, filler, prose = message_parts(lines)
    return (message > 0 and prose <= PROSE_LEFT and prose <= 2 * message) or (filler > 0 and prose <= filler + PROSE_LEFT // 2 and filler >= 0.3 * sum(len(x) for x in lines if not title_like(x)))


def judge(lines: list[str], recurrent: list[bool]) -> tuple[bool, bool]:
    """(unfilled placeholder, no body) of a page from its lines and which of them recur on its host."""
    furniture = set(furniture_lines(["\n".join(lines)])[0])
    rest = []
    for i, (x, often) in enumerate(zip(lines, recurrent), 1):
        x = x.strip()
        marks = line_marks(x) if x else 0
        if x and (marks & (MESSAGE_MARK | FILLER_MARK) or not (often or i in furniture)):
            rest.append(x)
    return any(line_marks(x.strip()) & PLACE_MARK for x in lines), bool(rest) and no_body(rest)


def masked(line: Column) -> Column:
    """A line without regard to case, digits and blanks."""
    return F.translate(F.lower(line), "0123456789 \t\r", "")


def _host(host: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(host)), F.lit(0)).alias("_host")


def _page(page: Column | None, text: str) -> Column:
    """A number for the page of a row: of its name, or of its text where it has none."""
    return F.xxhash64(F.col(text) if page is None else F.coalesce(page, F.col(text)))


def line_counts(rows: DataFrame, host: str, text: str, page: Column | None = None) -> DataFrame:
    """``_host``, ``_line`` (hashes) and ``n_pages``: distinct pages of a host with the line, over all rows; blank lines are left out."""
    own = F.array_distinct(F.transform(F.split("_text", "\n"), lambda x: F.xxhash64(masked(x))))
    each = rows.select(_host(host), _page(page, text).alias("_page"), F.col(text).alias("_text"))  # once a row, before there is a row a line
    lines = each.select("_host", "_page", F.explode(own).alias("_line")).filter(F.col("_line") != F.xxhash64(F.lit("")))
    return lines.distinct().groupBy("_host", "_line").agg(F.count("*").alias("n_pages"))


def residue_pages(rows: DataFrame, key: str, host: str, text: str, page: Column | None = None) -> DataFrame:
    """``key``, ``placeholder``, ``no_body`` of the pages to exclude; ``page`` names the page of a row."""
    some = rows.select(F.col(key).alias("_key"), _host(host), F.col(text).alias("_text"))
    suspects = _suspects(some)
    parts = suspects.select("_key", "_host", F.posexplode(F.split("_text", "\n")).alias("_no", "_raw")).withColumn("_line", F.xxhash64(masked(F.col("_raw"))))
    parts = written(parts.filter(F.col("_raw").rlike(r"\S")), "residue-lines")  # read twice: for the lines to count, and for the pages
    keys = parts.select("_host", "_line").distinct()
    often = line_counts(rows, host, text, page).filter(F.col("n_pages") >= RECURRENT).join(keys, ["_host", "_line"], "left_semi")
    # a line that a third of all pages have is spread over parts, with the note that it recurs beside each
    often = often.select("_host", "_line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_often"))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    lines = salted.join(often, ["_host", "_line", "_salt"], "left").withColumn("_often", F.coalesce("_often", F.lit(False)))
    pages = lines.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("_no", "_raw", "_often"))).alias("_lines"))
    key_type = pages.schema["_key"].dataType.simpleString()
    pages = pages.select("_key", F.col("_lines._raw").alias("_raws"), F.col("_lines._often").alias("_often"), F.col("_lines._no").alias("_nos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (raws, often, nos) in enumerate(zip(*[b.column(c).to_pylist() for c in (1, 2, 3)])):
                lines, recurs = [""] * (nos[-1] + 1), [False] * (nos[-1] + 1)  # blank lines back in their places
                for n, x, o in zip(nos, raws, often):
                    lines[n], recurs[n] = x, o
                got = judge(lines, recurs)
                if any(got):
                    at.append(i)
                    out.append(got)
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.bool_()) for c in cols]], names=["_key", "placeholder", "no_body"])

    return pages.mapInArrow(run, f"_key {key_type}, placeholder boolean, no_body boolean").withColumnRenamed("_key", key)


def _suspects(some: DataFrame) -> DataFrame:
    """Pages with any evidence at all, over their whole texts; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [i for i, t in enumerate(b.column(2).to_pylist()) if t and not t.isspace() and suspect(t)]
            yield b.take(pa.array(at, pa.int64()))

    types = {f.name: f.dataType.simpleString() for f in some.schema}
    return some.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in types.items()))


def suspect(text: str) -> bool:
    return any(line_marks(x) for x in map(str.strip, text.split("\n")) if x)
