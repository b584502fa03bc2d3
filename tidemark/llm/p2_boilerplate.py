"""Problem 2: the main body of web pages given as lines of text.

Pages come without tags, so a line's container is told by its place: the line that heads it, its
indent and its shape. Each page judges its lines on its own first. Votes are then counted in
Spark. On each host: on lines (what many pages of a host repeat is no article) and on generalised
paths of indent and shape (what is hardly ever body on a host is not body on its odd pages either). Over all hosts: on the lines that head containers and on the words before a colon, as
labels, buttons, prompts and notices are the same on many sites whose articles differ; whether
long lines or short ones follow such a line tells containers of prose from columns of other
stories. The winning votes are joined back to the pages, which are judged again with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.web import host
from tidemark.session import materialize, ship_package

#: A line is the host's own if pages of so many titles, and this share of the host's, hold it;
#: sentences and headlines, which copies of an article share too, need the larger share.
PAGES, SHARE, SHARE_OF_TEXT = 3, 0.03, 0.1
#: A path is not body if the host has at least this many lines on it and at most this share judged body.
PATH_LINES, PATH_SHARE = 12, 0.15
#: A line, or the words before its colon, is furniture of many sites if so many hosts and titles have it, unless long
#: lines follow it in this share; it heads a column if short lines follow it in this share.
HOSTS, TITLES, LONG_AFTER, SHORT_AFTER = 5, 5, 0.3, 0.6

#: A line is the heading if it begins as the title does for this share of the title.
TITLE_SHARE = 0.6

BLANK, MENU, NOTICE, SHORT, LABEL, AD, FOOT, HEADLINE, TEXT, ITEM, HEADING, INLINE, BUTTON, LONG = range(14)

# Labels of columns with other stories.
_LABELS = "more from this section,popular now,related stories,related articles,related,latest,latest news,latest stories,elsewhere on the site,elsewhere,most read,most popular,you may also like,you might also like,read more,read next,read also,more stories,more news,top stories,trending,trending now,recommended,recommended for you,editor's picks,editors' picks,in other news,also in the news,see also,don't miss,what others read,artículos relacionados,relacionado,relacionados,última hora,lo más leído,le puede interesar,también le puede interesar,más noticias,lea también,te puede interesar,neueste meldungen,mehr zum thema,meistgelesen,das könnte sie auch interessieren,auch interessant,lesen sie auch,weitere meldungen,weitere artikel,aktuell,aktuelles,à lire aussi,lire aussi,les plus lus,dernière minute,sur le même sujet,articles liés,plus d'articles,à la une,en continu"
LABELS = frozenset(_LABELS.split(","))
# Marks of advertising, and prompts to share or subscribe.
ADS = re.compile(
    r"""^(?:advertisement|advert|advertising|ad|sponsored(?:\s(?:content|post|by\b.*))?|paid\s(?:content|post)|promoted|promotion|continue\sreading(?:\sbelow)?|(?:story|article)\scontinues\b.*|scroll\sto\scontinue|anzeige|werbung|gesponsert|weiterlesen\b.*|publicidad|patrocinado|contenido\spatrocinado|publicit[ée]|sponsoris[ée]|contenu\ssponsoris[ée]|lire\sla\ssuite
    |sign\sup\s(?:for|to)\s(?:our|the|a)\b.*|subscribe(?:\s(?:now|today|to\s(?:our|the)\b.*|for\b.*))?|get\s(?:our|the)\s.*(?:newsletter|letter|inbox).*|join\s(?:our|the)\s.*(?:list|newsletter|letter)|newsletter(?:\sbestellen)?|follow\sus\b.*|share(?:\s(?:this|on)\b.*)?|print(?:\sthis.*)?|(?:e-?)?mail\sthis.*|tweet|like\sus\b.*|leave\sa\scomment|comments?|inscrivez-vous\b.*|abonnez-vous\b.*|partager.*|suscr[íi]base\b.*|suscr[íi]bete\b.*|compartir.*|abonnieren\b.*|jetzt\sabonnieren.*|teilen.*|melden\ssie\ssich\b.*an)$""",
    re.IGNORECASE | re.VERBOSE,
)
# How cookie notices begin, and what they are about.
_NOTICE_BEGIN = re.compile(
    r"^(?:we\b|we and\b|our\b|this (?:site|website|page)\b|cookies?\b|by (?:using|continuing|going)|to (?:give|offer|improve)|your privacy|wir\b|diese (?:seite|website|webseite)\b|unsere\b|mit der nutzung|nous\b|ce site\b|nos\b|en poursuivant|guardamos\b|usamos\b|utilizamos\b|este sitio\b|esta (?:página|web)\b|nosotros\b|nuestros\b|si continúa)",
    re.IGNORECASE,
)
_NOTICE_ABOUT = re.compile(r"cookie|tracker|traceur|trazador|on your device|your (?:device|settings)|auf ihrem gerät|en su dispositivo|sur votre appareil|small files|kleine dateien|fichiers|consent|einwillig|consentement|privacy (?:notice|policy)|datenschutz", re.IGNORECASE)
# Buttons, and words of menus and footers.
_BUTTONS = "accept all,accept,reject,reject all,allow,allow all,deny,decline,ok,ok, got it,got it,more information,manage settings,settings,cookie settings,preferences,learn more,close,continue,agree,i agree,configurar,rechazar,rechazar todo,aceptar,aceptar todo,más información,ablehnen,alle annehmen,alle ablehnen,annehmen,akzeptieren,alle akzeptieren,einstellungen,mehr erfahren,refuser,tout refuser,tout accepter,accepter,paramétrer,en savoir plus"
BUTTONS = frozenset(_BUTTONS.split(","))
_WORDS = "accessibility,imprint,privacy,site map,sitemap,rss,careers,terms of use,terms,advertise,contact,about us,home,register,login,log in,search,archive,help,video,photos,opinion,sport,sports,weather,news,forum,markets,jobs,legal,cookies,datenschutz,impressum,mediadaten,agb,kontakt,hilfe,suche,archiv,startseite,anmelden,meinung,wetter,stellen,nachrichten,märkte,videos,aviso legal,privacidad,mapa del sitio,publicidad,contacto,inicio,buscar,ayuda,archivo,entrar,opinión,tiempo,mercados,noticias,empleo,vídeos,mentions légales,vie privée,plan du site,publicité,accueil,recherche,aide,archives,connexion,opinions,météo,marchés,actualités,emploi,vidéos"
WORDS = frozenset(_WORDS.split(","))
FOOTER = re.compile(r"^(?:©|\(c\)|copyright\b|&copy;).{0,90}$|^.{0,60}\ball rights reserved\.?$|^.{0,60}\balle rechte vorbehalten\.?$|^.{0,60}\btous droits réservés\.?$|^.{0,60}\btodos los derechos reservados\.?$", re.IGNORECASE)
_SEPARATED = re.compile(r"\s*[|·•»›→]\s*|\s+[>/]\s+|\s{2,}|\t+")
_HINT = re.compile(r"[|·•»›→\t]|  | [>/] |\s{2}")
_TERMINAL = re.compile(r"[.!?…:][\"'»”’)\]]*$")
_BULLET = re.compile(r"^(?:[-*•–—‣▪·]\s+|\d{1,2}[.)]\s+|[a-z]\)\s+)")
_TWO_SENTENCES = re.compile(r"[.!?…][\"'»”’)]*\s+[\"'«“‘(]?\w")


def indent_of(line: str) -> int:
    """0 none, 1 tab, 2 blanks, 3 other white space."""
    if not line or not line[0].isspace():
        return 0
    return {"\t": 1, " ": 2}.get(line[0], 3)


def _plain(line: str) -> str:
    return " ".join(line.split()).casefold()


def shapes(text: str, title: str | None) -> list[tuple[int, int, int, str]]:
    """(number, shape, indent, plain text) of each line that isn't blank, and of blank ones with shape BLANK."""
    lines = text.split("\n")
    head = _plain(title or "")
    if head in ("n/a", "untitled", "none", "null"):
        head = ""
    out = []
    stripped = [x.strip() for x in lines]
    for i, s in enumerate(stripped):
        if not s:
            out.append((i + 1, BLANK, 0, ""))
            continue
        low = _plain(s)
        bare = low.strip(" :›»>|-–—*·")
        count = len(low.split())
        parts = [p for p in _SEPARATED.split(s.strip("|·•»›→ ")) if p] if _HINT.search(s) else [s]
        ended = bool(_TERMINAL.search(s))
        if head and (low == head or (len(head) > 30 and count <= len(head.split()) and len(commonprefix((low, head))) >= TITLE_SHARE * len(head))):
            shape = HEADING
        elif bare in LABELS:
            shape = LABEL
        elif ":" in low and low.split(":", 1)[0].strip() in LABELS:
            shape = INLINE
        elif len(s) < 160 and FOOTER.match(s):
            shape = FOOT
        elif count <= 9 and ADS.match(low.rstrip(".!:")):
            shape = AD
        elif bare in BUTTONS or len(parts) > 1 and all(p.casefold() in BUTTONS for p in parts):
            shape = BUTTON
        elif bare in WORDS or len(parts) > 1 and all(p.casefold() in WORDS for p in parts):
            shape = MENU
        elif _NOTICE_BEGIN.match(s) and _NOTICE_ABOUT.search(s):
            shape = NOTICE
        elif _BULLET.match(s):
            shape = ITEM
        elif len(parts) > 1 and not ended and sum(len(p.split()) <= 3 for p in parts) >= 2 and all(len(p.split()) <= 9 for p in parts):
            shape = MENU
        elif len(parts) > 1 and not ended and len(parts[0].split()) <= 3 and re.search(r"[›»>/|→·]", s) and count <= 14:
            shape = MENU
        elif ended:
            shape = LONG if _TWO_SENTENCES.search(s) or count > 24 else TEXT
        elif count <= 4:
            shape = SHORT
        else:
            shape = HEADLINE
        out.append((i + 1, shape, indent_of(lines[i]), low))
    # Wrapped paragraphs: unfinished lines of about the page's width that go on in the next.
    width = sorted((len(s) for s, o in zip(stripped, out) if o[1] == HEADLINE and len(s) > 40), reverse=True)
    wide = width[len(width) // 10] if width else 0
    running = [s for s, o in zip(stripped, out) if o[1] in (HEADLINE, SHORT, TEXT, LONG)]
    if sum(s[0].islower() for s in running) < 0.15 * len(running):
        wide = 0  # lists of headlines have lines of like width too, but none that goes on in lower case
    for i, (no, shape, ind, low) in enumerate(out):
        if shape in (HEADLINE, SHORT, ITEM, MENU) and i + 1 < len(out) and out[i + 1][1] != BLANK:
            follows = stripped[i + 1]
            goes_on = follows[:1].islower() or (out[i + 1][1] in (TEXT, LONG, HEADLINE, SHORT) and wide >= 55 and len(stripped[i]) + 1 + len(follows.split()[0]) > wide - 4)
            if goes_on and shape in (HEADLINE, SHORT) and out[i + 1][2] == ind:
                out[i] = (no, LONG, ind, low)
        if shape in (SHORT, HEADLINE) and i and out[i - 1][1] == LONG and not _TERMINAL.search(stripped[i - 1]) and out[i - 1][2] == ind:
            out[i] = (no, LONG, ind, low)
    return out


_OFF = frozenset((MENU, NOTICE, LABEL, AD, FOOT, INLINE, BUTTON))


def path_of(line: tuple[int, int, int]) -> int:
    """The generalised path of a line, indent and shape; 0 for lines without indent, whose containers are told by the line that heads them."""
    return line[2] * 16 + line[1] if line[2] else 0


def body(lines: list[tuple[int, int, int]], own: frozenset[int] = frozenset(), bad: frozenset[int] = frozenset(), heads: frozenset[int] = frozenset()) -> list[int]:
    """Numbers of the lines of the main body.

    ``lines``: (number, shape, indent); ``own``: numbers of lines that are the host's or of many
    sites; ``bad``: numbers of lines on paths that are not body on this host; ``heads``: numbers of lines that head
    columns of other stories. The body runs from the heading to the first column of other
    stories or footer; a page that only lists stories has none.
    """
    full = [(x[0], LABEL if x[0] in heads else x[1], x[2]) for x in lines if x[1] != BLANK]
    shift = [0]
    off = lambda x: x[1] in _OFF or x[0] in own or x[0] in bad or (x[2] not in shift and x[1] not in (ITEM, HEADING))
    start = next((i for i, x in enumerate(full) if x[1] == HEADING and x[0] not in own and x[0] not in bad), None)
    titled = start is not None
    if start is None:
        shift.append(1), shift.append(2), shift.append(3)
        start = next((i for i, x in enumerate(full) if x[1] in (HEADLINE, TEXT, LONG) and not off(x)), None)
        if start is None:
            return []
    shift[:] = [full[start][2]]  # the body stands where its heading stands
    end = len(full)
    last_long = max((i for i, x in enumerate(full) if x[1] == LONG and not off(x)), default=-1)
    for i in range(start + 1, len(full)):
        no, shape, _ = full[i]
        if shape == LABEL or shape == FOOT:
            end = i
            break
        if no in own and shape in (SHORT, HEADLINE) and i + 1 < len(full) and full[i + 1][1] in (HEADLINE, ITEM) and last_long < i + 4:
            end = i
            break
    while end > start + 1 and (off(full[end - 1]) or full[end - 1][1] == SHORT):
        end -= 1
    kept = [x for x in full[start:end] if not off(x)]
    texts = [x for x in kept if x[1] in (LONG, TEXT, ITEM)]
    if not titled:
        headlines = sum(x[1] == HEADLINE for x in kept)
        if headlines >= 3 and not any(x[1] == LONG for x in kept) or not texts:
            return []
    if titled and not texts and sum(x[1] == HEADLINE for x in kept) >= 3:
        return []
    return [x[0] for x in kept]


def _key(plain: str) -> int:
    return xxhash.xxh64_intdigest(plain) - 2**63


def _prefix(plain: str) -> int:
    """A key of the words before a line's colon, 0 if there are none or more than four."""
    words, colon, rest = plain.partition(":")
    return _key(words.strip()) if colon and rest.strip() and 0 < len(words.split()) <= 4 else 0


_FIELDS = (("numbers", pa.int32()), ("shapes", pa.int8()), ("indents", pa.int8()), ("keys", pa.int64()), ("prefixes", pa.int64()), ("paths", pa.int32()), ("local", pa.bool_()), ("after", pa.int8()), ("tails", pa.bool_()))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, host, title's key, and of each line number, shape, indent, keys, path, own judgement, next shape): what the second pass needs of a page, without its text."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(3 + len(_FIELDS))]
        for page, site, title, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            lines = shapes(text, title)
            local = set(body([x[:3] for x in lines]))
            lines = [x for x in lines if x[1] != BLANK]
            after = [*(x[1] for x in lines[1:]), BLANK] if lines else []
            values = (page, site, _key(_plain(title or "") or str(page)), [x[0] for x in lines], [x[1] for x in lines], [x[2] for x in lines], [_key(x[3]) for x in lines], [_prefix(x[3]) for x in lines], [path_of(x[:3]) for x in lines], [x[0] in local for x in lines], after, [bool(_TERMINAL.search(x[3])) and len(x[3].split()) <= 3 for x in lines])
            for col, value in zip(cols, values):
                col.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), *(pa.list_(t) for _, t in _FIELDS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "host", "head", *(n for n, _ in _FIELDS)])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, numbers = [], []
        for page, nos, kinds, indents, own, bad, heads in zip(*(batch.column(c).to_pylist() for c in range(7))):
            found = body(list(zip(nos, kinds, indents)), frozenset(own or ()), frozenset(bad or ()), frozenset(heads or ()))
            pages += [page] * len(found)
            numbers += found
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(numbers, pa.int64())], names=["page_id", "line_no"])


def main_body(pages: DataFrame, key: str = "page_id", url: str = "url", title: str = "title", text: str = "text") -> DataFrame:
    """(page_id, line_no) of the non-blank lines of each page's main body.

    Rows delivered twice count once, in the votes too. Pages of null, empty or blank text have
    no lines; a null address has no host, and such pages and those of hosts with few pages are
    judged on their own; null titles are looked past; null ids are left out; an empty table
    gives no rows; other columns are not read.

    The first pass leaves a few bytes for each line, so the texts are read once and never
    shuffled; votes are counted in the tasks before they are shuffled by host and line. Lines
    that most pages of the collection have meet only the few that won over all hosts.
    """
    ship_package(pages.sparkSession)
    site = F.regexp_replace(host(url), r"^www\.", "")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), site.alias("host"), F.col(title).alias("title"), F.col(text).alias("text"))
    rows = rows.filter("page_id is not null and text is not null")
    made = rows.mapInArrow(_first_pass, "page_id long, host string, head long, numbers array<int>, shapes array<tinyint>, indents array<tinyint>, keys array<long>, prefixes array<long>, paths array<int>, local array<boolean>, after array<tinyint>, tails array<boolean>")
    once = materialize(made.dropDuplicates(["page_id"]))
    line = once.filter("host is not null").select("page_id", "host", "head", F.explode(F.arrays_zip("numbers", "shapes", "keys", "prefixes", "paths", "local", "after", "tails")).alias("x"))
    line = line.select("page_id", "host", "head", F.col("x.numbers").alias("no"), F.col("x.shapes").alias("shape"), F.col("x.keys").alias("k"), F.col("x.prefixes").alias("p"), F.col("x.paths").alias("path"), F.col("x.local").cast("int").alias("b"), F.col("x.after").alias("after"), F.col("x.tails").alias("tail"))
    # Copies of one article under several addresses share its title and vote once.
    long, short = (F.max(F.col("after").isin(*kinds).cast("int")).alias(name) for kinds, name in (((LONG,), "long"), ((HEADLINE, ITEM, SHORT), "short")))
    by_title = line.groupBy("host", "k", "head").agg(F.min("shape").alias("shape"), long, short, F.max("tail").alias("tail"))
    votes = by_title.groupBy("host", "k").agg(F.count(F.lit(1)).alias("n"), F.min("shape").alias("shape"), F.sum("long").alias("long"), F.sum("short").alias("short"), F.max("tail").alias("tail"))
    sizes = once.filter("host is not null").select("host", "head").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    share = F.when(F.col("shape").isin(HEADLINE, TEXT, ITEM, LONG), SHARE_OF_TEXT).otherwise(SHARE)
    votes = materialize(votes)
    won = materialize(votes.filter(F.col("n") >= PAGES).join(sizes, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "k", F.lit(True).alias("of_host")))
    # Over all hosts: the few lines, and words before a colon, that many of them have; the last words of a wrapped paragraph tell nothing.
    wide = votes.filter("not tail").groupBy("k").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.min("shape").alias("shape"), F.sum("long").alias("long"), F.sum("short").alias("short"))
    wide = wide.filter((F.col("hosts") >= HOSTS) & (F.col("n") >= TITLES) & (F.col("long") < LONG_AFTER * F.col("n")))
    heads = (F.col("short") > SHORT_AFTER * F.col("n")) & F.col("shape").isin(SHORT, HEADLINE, LABEL)
    wide = materialize(wide.select("k", heads.alias("heads")))
    inline = line.filter((F.col("p") != 0) & F.col("shape").isin(HEADLINE, INLINE, MENU)).select("host", "p", "head").distinct().groupBy("host", "p").agg(F.count(F.lit(1)).alias("n"))
    inline = materialize(inline.groupBy("p").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n")).filter((F.col("hosts") >= HOSTS) & (F.col("n") >= TITLES)).select("p"))
    # Paths of a host that hardly ever are body.
    paths = line.filter("path != 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    lost = materialize(paths.filter((F.col("n") >= PATH_LINES) & (F.col("b") <= PATH_SHARE * F.col("n"))).select("host", "path", F.lit(True).alias("bad")))
    # The winners are few and written, so the planner knows whether they can be broadcast to the lines.
    told = line.select("page_id", "host", "no", "k", "path", F.when(F.col("shape").isin(HEADLINE, INLINE, MENU), F.col("p")).alias("p"))
    told = told.join(won, ["host", "k"], "left").join(wide, "k", "left").join(lost, ["host", "path"], "left").join(inline.withColumn("label", F.lit(True)), "p", "left")
    told = told.filter("of_host or label or heads is not null or bad")
    own = F.col("of_host") | F.col("label") | F.col("heads").isNotNull()
    flags = told.groupBy("page_id").agg(*(F.collect_set(F.when(c, F.col("no"))).alias(name) for c, name in ((own, "own"), (F.col("bad"), "bad"), (F.col("heads"), "heads"))))  # lines of one page
    full = once.join(flags, "page_id", "left")
    return full.select("page_id", "numbers", "shapes", "indents", "own", "bad", "heads").mapInArrow(_second_pass, "page_id long, line_no long")
