"""Problem 9: template residue and error-page text.

Texts are read for trusted marks first: a placeholder left where a value should stand, or filler,
an error page, a program's dump or a script notice with next to nothing beside it. Short bodies that
come from many origins are trusted as well, whatever they say. Near-duplicates of the trusted texts
are looked up in partitioned SimHash tables, verified by Hamming distance and by the similarity of
the texts, and the label passes through the connected components of these links. A placeholder must
stand in a document's own text, so that label is checked there and not passed on.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import mixed, shingles, word_hashes, words
from tidemark.session import materialize, ship_package

SIMILARITY = 0.8
SHINGLE = 5
#: Bits of 256 in which near-duplicates differ at most; those of 12 to 25 words differ in 21 on average.
HAMMING = 56
#: Trusted texts under one key of a table that are met in one part.
BLOCK = 1000
#: A short body from so many origins and sources is a machine's.
ORIGINS, SOURCES = 5, 2
# Forms of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"""\{\{[#/^&>!]?\s*[\w .|:'"()-]{1,60}\s*\}\} | \{%\s*[\w .|:'"=-]{1,60}\s*%\} | \[%\s*[\w .|-]{1,40}\s*%\] | \{\$\s*[\w.]{1,40}\} | %\(\w{1,40}\)[sd] | <%=?\s*[\w .-]{1,40}\s*%> | [$#]\{\s*[\w .-]{1,40}\s*\}
    | (?<![\w{])\{(?:\d{1,2}|[A-Za-z]\w*(?:[ _]\w+){0,3})\}(?!\}) | %%[A-Za-z][A-Za-z_ ]*%% | (?<![%\w])%[A-Z][A-Z_]{2,}%(?![%\w]) | (?<![\w%])%[sd](?![\w%])
    | __[A-Z][A-Z_]*[A-Z]__ | \bXX_[A-Z_]+_XX\b | \*\|[^|\n]{1,40}\|\* | (?<![\w$])\$[A-Z][A-Z_]{2,}\$ | <<\s*[A-Za-z][\w ]{0,40}>> | &lt;\s*[A-Za-z_][\w ]{0,40}&gt;
    | <[A-Z]+(?:_[A-Z]+)+> | @@[A-Za-z_]+@@ | «[a-z]+(?:_[a-z]+)*» | \[(?:INSERT|YOUR|ENTER|ADD)\s[^\]\n]{1,40}\] | \[(?:your|insert|enter|add)\s[^\]\n]{1,40}\]
    | \[(?:(?:First|Last|Full|Company|Order|Your)[ _]?)?(?:Name|Title|Date|City|Company|Port|Vessel|Amount|Sender|Arrival|Address|Phone|Email|Order[ _]I[dD]|Number|Recipient|Subject|Location|Time)\]
    | \[(?:[A-ZÄÖÜ][a-zäöüß]*)?(?:[Nn]ame|[Nn]ummer|[Dd]atum|[Aa]dresse|Anrede|Vorname|Nachname|Ort)\] | \[(?:Nombre|Apellidos?|Fecha|Ciudad|Empresa|Pr[ée]nom|Nom|Ville|Soci[ée]t[ée])\]
    | \[\[\s*[a-zA-Z_][\w ]{0,30}\]\]""",
    re.VERBOSE,
)
# Wording of sentences that write about such marks.
ABOUT = re.compile(
    r"explain|\bmarks? (?:the |a )?fields?\b|\bfills? (?:it|them|in|out)\b|placeholder|template (?:syntax|language|engine)|syntax|\b(?:marked|labelled)\b|(?:never|not) filled|\b(?:was|were) read\b|\bread (?:out )?as\b|\b(?:sign|board|screen|label|page) (?:said|read|showed)|said ['\"“]|the words?\b|variable|the manual|export \w+=|written as|is written|stands? for|notation|docs? (?:say|show)|documentation|for example|such as|code sample|tutorial|quoted|quotes",
    re.IGNORECASE,
)
# Pseudo-Latin, keyboard and skeleton filler.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vero caro fames sagit velum urna mollis porta dictum".split())
KEYS = frozenset("asdf asd qwer qwerty sdfg jkl lkj hjkl test testing xxx yyy zzz foo bar baz aaa bbb abc abcd".split())
SKELETON = frozenset("lead text,caption,heading,heading 1,heading 2,heading 3,author name,subtitle,title,image description,image caption,paragraph,coming soon,tbd,tba,tbc,todo,body text,quote,byline,headline,summary,teaser,sample text,your text,footer text,content,section,item,list item,button,label,name,description,date".split(","))
FILLER_SENTENCE = re.compile(
    r"your (?:text|content|headline|copy) (?:goes )?here|text goes here|content goes here|(?:dummy|sample|filler|placeholder|example) (?:text|copy|paragraph|content)|body copy to follow|copy to follow|type something|replace (?:this|before|me)|write (?:something|your)|add your|click (?:here )?to (?:edit|add)|edit this|this is (?:a|some) (?:sample|dummy|test|placeholder)|coming soon|to be (?:added|written|supplied|done)|lorem ipsum",
    re.IGNORECASE,
)
# How error, outage, access, robot-check and empty-result messages begin.
ERROR = re.compile(
    r"""(?:https?\s|http\s|error\s|code\s|status\s|erreur\s|fehler\s)*[45]\d\d\b | (?:http\s)?error\b | (?:the\s)?(?:requested\s)?(?:page|file|address|document|url|resource)\s(?:was\s|is\s|could\s)?(?:not\s(?:be\s)?(?:found|available)|no\slonger|missing|gone) | not\sfound | nothing\sat\sthis | (?:we|i)\s(?:could\snot|couldn.t|can.t|cannot|were\sunable) | (?:oops|whoops|uh[\s-]oh)\b
    | (?:internal\s)?server\s(?:error|too\sbusy|is\s(?:too\s)?busy|unavailable|not\sresponding|overloaded) | application\serror | (?:the\s|this\s)?(?:service|site|server|system|page)\s(?:is\s)?(?:temporarily\s|currently\s)?(?:unavailable|down|offline|closed|out\sof) | bad\s(?:gateway|request) | gateway\stime | (?:request|connection)\s(?:timed?\sout|time-?out|refused|reset) | too\smany\srequests
    | forbidden | (?:access|permission)\s(?:denied|refused) | you\s(?:are\snot\s(?:allowed|authori[sz]ed|permitted)|do\snot\shave|don.t\shave|have\sbeen\sblocked|need\sto\s(?:log|sign)|must\s(?:log|sign)) | (?:log[\s-]?in|sign[\s-]?in|authentication|authori[sz]ation)\s(?:is\s)?required | unauthori[sz]ed | please\s(?:log|sign)\s?in | your\s(?:session|login|account|ip|address)\s(?:has|is|was) | session\sexpired | this\s(?:account|site|domain|content|list|page|folder|section|table|feed)\s(?:has\sbeen|is\s(?:empty|not|no|currently|temporarily|down|suspended)|does\snot|could\snot) | account\ssuspended
    | sorry\b | something\swent\swrong | an?\s(?:unexpected\s)?error\s | unexpected\serror | (?:down|closed)\s(?:for|due)\b | (?:scheduled|planned|under|undergoing|routine)\smaintenance | we.(?:ll|re)\s(?:be\sback|down) | back\ssoon | unusual\s(?:traffic|activity) | are\syou\s(?:a\s|an?\s)?(?:robot|human|real) | (?:please\s)?(?:verify|confirm|prove)\s(?:that\s)?you | checking\s(?:your|that|the)\s?(?:browser|connection|you) | one\smore\sstep | (?:security|human|browser|bot)\s(?:check|verification) | please\s(?:wait|stand\sby) | tick\sthe\sbox | (?:please\s)?(?:complete|solve)\s(?:the|this)\s | i.?\s?a?m\snot\sa\srobot | just\sa\smoment | one\smoment | type\sthe\s(?:letters|characters)
    | your\ssearch\s | (?:no|zero|0)\s(?:results?|hits?|match(?:es)?|entries|items?|records?|pages?|documents?|articles?|posts?)\b | nothing\s(?:to|was|matched|found|here) | there\s(?:are|is)\s(?:no|nothing) | gone\b | attention\srequired
    | (?:this|the)\s(?:web)?(?:page|site)\s(?:isn.t|is\snot|can.t|cannot|could\snot)\s(?:working|available|be\s(?:reached|found|displayed|loaded)) | (?:the|this)\slink\s(?:you\s)?(?:followed|is|may|might|has) | (?:unable|failed)\sto\s(?:connect|load|reach|open|process|complete|display) | (?:data)?base\s(?:error|connection)
    | pagina\snon\s | p[aá]gina\sn[aã]o\s | errore?\s\d | erro\s\d
    | seite\s(?:nicht|wurde\snicht) | (?:interner\s)?server-?fehler | fehler\b | zugriff\s(?:verweigert|gesperrt|nicht) | kein(?:e|en)?\s(?:treffer|ergebnis|zugriff|berechtigung|eintr) | dienst\s(?:nicht|derzeit) | wartung | nicht\sgefunden | sitzung\s
    | page\s(?:introuvable|non\strouv|inexistante) | erreur\b | service\s(?:indisponible|temporairement) | acc[eè]s\s(?:refus|interdit|non) | aucune?\sr[eé]sultat | site\sen\smaintenance | introuvable
    | p[aá]gina\sno\s | error\sinterno | acceso\s(?:denegado|prohibido) | servicio\s(?:no|temporalmente) | (?:sin|ning[uú]n|no\shay)\sresultados? | no\sse\s(?:ha\s)?encontr | no\sencontrad | en\smantenimiento""",
    re.IGNORECASE | re.VERBOSE,
)
# Lines of program dumps.
DUMP = re.compile(
    r"""^\s*(?:traceback\s\(most | panic:\s | (?:\w+\s)?fatal(?:\serror)?:?\s | (?:uncaught\s|unhandled\s)?(?:\w+\.)*\w*(?:exception|error)\b.{0,20}[:\s(] | (?:warning|notice|deprecated|parse\serror|strict\sstandards):\s | sql\s?state | ora-\d | mysql | segmentation\sfault | (?:core\sdumped|stack\s?trace) | caused\sby: | at\s[\w.$<>]+\( | file\s"[^"]+",\sline | (?:go)?routine\s\d | \w+\.\w+\(.{0,40}\)$ | could\snot\s(?:select|connect|open|load|execute)\b | (?:key|value|type|index|name|attribute|runtime|null\w*)error | \#\d+\s | \.\.\.\s\d+\smore | 0x[0-9a-f]+ | exit\s(?:code|status) | aborted)""",
    re.IGNORECASE | re.VERBOSE,
)
SCRIPT = re.compile(r"java\s?script|\bjs\b|\bscript(?:s|ing)?\b|client-side code", re.IGNORECASE)
# How script notices ask or tell.
BEGINS = re.compile(
    r"(?:please|kindly|you|your|this|the|to|loading|we|java\s?script|js|script|scripts|scripting|client-side|turn|enable|activate|allow|switch|sorry|for|our|it|if|without|bitte|diese|dieser|aktivieren|schalten|sie|um|ihr|ohne|ce|cette|veuillez|activez|pour|votre|le|sans|esta|este|active|habilite|por|su|para|necesita|sin)\b",
    re.IGNORECASE,
)
ASKS = re.compile(
    r"enabl|activ|turn\b|turned|allow|switch|need|requir|support|will not work|not work|without|disabled|blocked|depends|\boff\b|benötig|aktivier|ausgeschalt|deaktiviert|ohne|sans|nécess|fonction|necesit|requier|funciona|habilit|désactiv|desactiv",
    re.IGNORECASE,
)
# Wording of reports, which no notice has.
REPORTED = re.compile(r"\b(?:announced|said|told|traced|heard|wrote|reported)\b", re.IGNORECASE)
# What commonly stands beside such messages.
BESIDE = re.compile(
    r"""^(?:(?:please\s)?(?:try|come|check|go|return|visit|contact|reload|refresh|reset|turn|switch|update|use|type|click|press|see|ask|wait|clear|search|log|sign|tick|then|and)\b | this\s(?:takes|may\stake|should\stake|process) | thank | thanks | need\shelp | our\s | some\scontent | it\s(?:may|might|could|was|is) | the\s(?:link|requested|server|upstream|page|address|site|request|system|administrator|file|resource|connection|service|url|limit) | (?:request|ref|reference|code|error|incident|ray|trace|event|support|session|ticket)\b.{0,20}[\w-]+ | \(?code\s | [a-z]+x?/\d | [a-z]+/\d[\d.]*\sat\s | \[?(?:back|home)\]? | if\s | you\s | your\s | we\s | /\S+ | bitte\s | die\s(?:adresse|seite) | veuillez | l.adresse | l.url | int[eé]ntelo | vuelva | la\s(?:direcci[oó]n|p[aá]gina) | por\sfavor | le\s(?:lien|serveur) | el\s(?:enlace|servidor) | der\s(?:link|server) | contactez | p[oó]ngase | \d+$)""",
    re.IGNORECASE | re.VERBOSE,
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MENU = re.compile(r"\s*[|·•»›]\s*")
_PATH = re.compile(r"/\S+")


_ODDITIES = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]|<\\|[a-z]+\\|>")
_FOREIGN = re.compile("[^\x00-\u024f\u2010-\u203a\\n]+")
_BLANKS = re.compile("[ \t\xa0\u2000-\u200a]+")


def _readable(text: str, latin: bool = True) -> str:
    """Text without marks of no width, of broken encodings put right where they can be, and, with ``latin``, without other scripts."""
    if not text.isascii():
        if "Ã" in text or "â€" in text:
            try:
                text = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        text = unicodedata.normalize("NFC", _ODDITIES.sub("", text))
        if latin:
            text = _FOREIGN.sub(" ", text)
    elif "<|" in text:
        text = _ODDITIES.sub("", text)
    return "\n".join(_BLANKS.sub(" ", x).strip() for x in text.splitlines())


def _menu_line(line: str) -> bool:
    parts = [p for p in _MENU.split(line.strip()) if p]
    return len(parts) > 1 and all(len(p.split()) <= 3 for p in parts)


def _chunks(text: str) -> list[str]:
    """Lines without menus, cut at sentence ends and dashes."""
    out = []
    for line in text.splitlines():
        if line.strip() and not _menu_line(line):
            out += [c.strip(" \t.·-–—") for c in re.split(r"(?<=[.!?…])\s+|\s[-–—]\s|\.\.\s", line)]
    return [c for c in out if any(x.isalpha() for x in c) or c.isdigit()]


#: Every placeholder holds one of these.
_SIGN = re.compile(r"[{%<@«\[]|\$[A-Z]|__[A-Z]|XX_|\*\||&lt;")


def has_placeholder(text: str) -> bool:
    """A placeholder outside sentences that write about such marks."""
    if not _SIGN.search(text):
        return False
    if not text.isascii():
        text = _ODDITIES.sub("", text)
    for m in PLACEHOLDER.finditer(text):
        begin = max(text.rfind(x, 0, m.start()) for x in ("\n", ". ", "! ", "? ")) + 1
        ends = [e for x in ("\n", ". ", "! ", "? ") if (e := text.find(x, m.end())) >= 0]
        if not ABOUT.search(text[begin : min(ends, default=len(text))].replace("&lt;", "<").replace("&gt;", ">")):
            return True
    return False


def is_filler(text: str, tokens: list[str] | None = None) -> bool:
    """Pseudo-Latin, one or two words or one sentence over and over, key mashing, or a skeleton of labels."""
    kinds = set(words(text) if tokens is None else tokens)
    # Cheap signs first: real content has many words that are neither Latin filler nor repeated.
    latin, keys = len(kinds & LATIN), len(kinds & KEYS)
    if len(kinds) > 30 and latin < 0.2 * len(kinds) and keys < 0.2 * len(kinds):
        return False
    text = _readable(text)
    lines = [x.strip().lower().strip(".:") for x in text.splitlines() if x.strip() and not _menu_line(x)]
    found = [w for line in lines for w in re.findall(r"[^\W\d_]+", line)]
    if not found:
        return False
    n, kinds = len(found), set(found)
    if n >= 5 and sum(w in LATIN for w in found) >= 0.6 * n and len(kinds & LATIN) > 2:
        return True
    if n >= 4 and sum(w in KEYS for w in found) >= 0.7 * n:
        return True
    if n >= 8 and len(kinds) <= max(2, n // 60):
        return True
    if len(lines) >= 3 and sum(x in SKELETON for x in lines) >= 0.8 * len(lines):
        return True
    sentences = [s.lower() for s in _chunks(text)]
    counts = Counter(sentences)
    met = sum(c for s, c in counts.items() if FILLER_SENTENCE.search(s) and len(s.split()) <= 12)
    if met and met >= 0.6 * len(sentences):
        return True
    return len(sentences) >= 4 and len(counts) <= max(1, len(sentences) // 4) and n >= 12


_FRAME = re.compile(r"^\s*file \"[^\"]+\", line", re.IGNORECASE)
_DIVIDED = re.compile(r"[|·•»›]")
#: Words of a notice, menus aside; it has to begin within so many sentences of the text's begin.
NOTICE_WORDS, NOTICE_BEGIN = 60, 3


def is_dump(lines: list[str]) -> bool:
    """A program's dump, of any length: it begins with a line of one, and most lines are such or the code that a frame shows."""
    dump = [bool(DUMP.match(x)) for x in lines]
    shown = [i > 0 and bool(_FRAME.match(lines[i - 1])) for i in range(len(lines))]
    told = [d or c for d, c in zip(dump, shown)]
    rest = sum(len(x.split()) for x, d in zip(lines, told) if not d)
    return 2 * sum(told) >= len(lines) and rest <= max(12, sum(told)) or len(lines) <= 3 and rest <= 12


def is_notice(text: str, tokens: list[str] | None = None) -> bool:
    """An error page, dump or script notice with next to nothing beside it."""
    first = next((x for x in text.split("\n", 4) if x.strip() and not _menu_line(x)), "")
    dumped = DUMP.match(first.lstrip("\ufeff\u200b"))
    # A text of many words beside its menus is no notice, and is not read any further.
    if not dumped and len(words(text) if tokens is None else tokens) > 2 * NOTICE_WORDS and sum(len(x.split()) for x in text.splitlines() if not (_DIVIDED.search(x) and _menu_line(x))) > 2 * NOTICE_WORDS:
        return False
    text = _readable(text)
    lines = [x for x in text.splitlines() if x.strip() and not _menu_line(x)]
    if not lines:
        return False
    if DUMP.match(lines[0]) and is_dump(lines):
        return True
    total = beside = 0
    strong = False
    for i, chunk in enumerate(_chunks(text)):
        size = len(chunk.split())
        total += size
        if total > NOTICE_WORDS:
            return False
        script = size <= 18 and bool(SCRIPT.search(chunk) and BEGINS.match(chunk) and ASKS.search(chunk)) and not REPORTED.search(chunk)
        if i < NOTICE_BEGIN and size <= 22 and (script or ERROR.match(chunk)):
            strong = True
        elif not (script or (BESIDE.match(chunk) and size <= 16) or ERROR.match(chunk) and size <= 16 or chunk.lower().startswith("loading")):
            beside += size
    return strong and beside <= max(3, total // 6)


def masked_words(text: str) -> list[str]:
    """Words with paths and everything that holds digits as one mark."""
    found = words(_PATH.sub(" 0 ", text) if "/" in text else text)
    return [w if w.isalpha() else "0" for w in found]


def simhash(tokens: list[str]) -> list[int]:
    """256 bits in four signed longs, from the words and pairs of words.

    Each of these votes on the 64 bits of one of the four, told by its hash, so that an edit
    leaves most bits alone.
    """
    h = word_hashes(tokens)
    with np.errstate(over="ignore"):
        features = np.concatenate([mixed(h), mixed(h[:-1] * _ODD + h[1:])]) if len(h) > 1 else mixed(h)
    place = (features & np.uint64(3)).astype(np.int8)
    features = mixed(features)
    votes = np.zeros((4, 64))
    for at in range(0, len(features), 50_000):
        bits = np.unpackbits(features[at : at + 50_000].view(np.uint8)).reshape(-1, 64).astype(np.float32)
        votes += (place[at : at + 50_000] == _FOUR).astype(np.float32) @ bits
    most = 2 * votes > np.bincount(place, minlength=4)[:, None]
    return np.packbits(most, axis=1).view(np.int64)[:, 0].tolist()


_FOUR = np.arange(4, dtype=np.int8)[:, None]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What later steps need of a text: digests of its words and of its body without menus, SimHash, number of words, marks."""
    import xxhash

    for batch in batches:
        ids, keys, bodies, signs, sizes, placeholders, residues = [], [], [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = masked_words(text)
            ids.append(i)
            placeholders.append(has_placeholder(text))
            residues.append(is_filler(text, tokens) or is_notice(text, tokens))
            keys.append(xxhash.xxh128_digest(" ".join(tokens)) if tokens else None)
            signs.append(simhash(tokens))
            sizes.append(len(tokens))
            bodies.append(_body_digest(text, tokens))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(bodies, pa.int64()), *(pa.array([x[k] for x in signs], pa.int64()) for k in range(4)), pa.array(sizes, pa.int32()), pa.array(placeholders, pa.bool_()), pa.array(residues, pa.bool_())], names=["id", "words", "body", "s0", "s1", "s2", "s3", "size", "placeholder", "residue"])


def _body_digest(text: str, tokens: list[str]) -> int | None:
    """A digest of the words outside menus, numbers as one mark, of texts that are as short as notices; else null."""
    import xxhash

    if len(tokens) > 2 * NOTICE_WORDS:
        return None
    found = ["0" if w.isdigit() else w for x in text.splitlines() if not _menu_line(x) for w in words(_PATH.sub(" 0 ", x))]
    return xxhash.xxh64_intdigest(" ".join(found)) - 2**63 if SHINGLE <= len(found) <= NOTICE_WORDS else None


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sets of 5-word runs have a Jaccard similarity of at least 0.8; shorter texts are one run."""

    def runs(text: str) -> set[tuple[str, ...]]:
        w = masked_words(text)
        return shingles(w, SHINGLE) if len(w) >= SHINGLE else {tuple(w)}

    last, left = None, set()
    for batch in batches:
        out_a, out_b = [], []
        for a, ta, b, tb in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if a != last:
                last, left = a, runs(ta)
            right = runs(tb)
            both = len(left & right)
            if both >= SIMILARITY * (len(left) + len(right) - both) - 1e-9:
                out_a.append(a), out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _tables(rows: DataFrame) -> DataFrame:
    """``rows`` once in each of the 16 tables: ``key`` is the table and the 16 bits of the SimHash it is addressed by."""
    keys = [F.shiftrightunsigned(f"s{i}", 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long")) + (4 * i + j) * 65536 for i in range(4) for j in range(4)]
    return rows.withColumn("key", F.explode(F.array(*keys)))


def _split_keys(known: DataFrame, rest: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``part``: keys under which more than ``block`` trusted texts stand are cut into parts, which the other side meets one by one."""
    parts = known.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).filter("parts > 1")
    parts = materialize(parts)
    one = F.coalesce("parts", F.lit(1))
    left = known.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), one).cast("int")).drop("parts")
    right = rest.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return left, right


def near_labels(made: DataFrame, texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(words) of ``seeds`` (words) and of all texts in one component of near-duplicates with one of them.

    Only components that hold a seed matter, so the links are followed from the seeds on, round
    after round. Texts of equal words stand as one. A link: equal bits in one of the SimHash tables,
    at most HAMMING other bits in all, lengths within the similarity, and then the similarity of the texts.
    """
    sign = [f"s{i}" for i in range(4)]
    reps = materialize(made.filter("words is not null").groupBy("words").agg(F.min_by(F.struct("id", "size", *sign), "id").alias("r")).select("words", "r.*"))
    seen = materialize(seeds.select("words").distinct())
    fresh = reps.join(seen, "words", "left_semi")
    while True:
        rest = _tables(reps.join(seen, "words", "left_anti").select(F.col("id").alias("b"), F.col("size").alias("n"), *sign))
        left, right = _split_keys(_tables(fresh.select("id", F.col("size").alias("m"), *sign)), rest)
        left = left.select("key", "part", F.col("id").alias("a"), "m", *(F.col(c).alias(f"t{c}") for c in sign))
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"t{c}"))) for c in sign[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col("ts0"))))
        # A run is cut by an edit, so lengths in words may differ by a little more than runs do.
        sized = (F.col("n") + 4 >= SIMILARITY * F.col("m")) & (F.col("m") + 4 >= SIMILARITY * F.col("n"))
        near = materialize(right.join(left, ["key", "part"]).filter(sized & (apart <= HAMMING)).select("a", "b").distinct())
        ends = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
        held = materialize(texts.join(ends, "id", "left_semi").dropDuplicates(["id"]))
        full = near.join(held.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        links = full.select("a", "ta", "b", "tb").mapInArrow(_similar, "a long, b long")
        fresh = materialize(reps.join(links.select(F.col("b").alias("id")), "id", "left_semi"))
        if fresh.isEmpty():
            return seen
        seen = materialize(seen.union(fresh.select("words")))


def repeated_bodies(made: DataFrame) -> DataFrame:
    """(words) of short texts whose body, menus and numbers aside, comes from many origins and several sources: only machines say the same everywhere."""
    counted = made.filter("body is not null").select("body", "origin", "source").distinct()
    wide = counted.groupBy("body").agg(F.count_distinct("origin").alias("o"), F.count_distinct("source").alias("s")).filter((F.col("o") >= ORIGINS) & (F.col("s") >= SOURCES))
    return made.join(wide.select("body"), "body", "left_semi").select("words").distinct()


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", origin: str | None = None, source: str | None = None) -> DataFrame:
    """(id, placeholder, residue) of the documents that should be left out.

    ``placeholder``: one was left unfilled in the document's own text. ``residue``: filler, an error
    page, a dump or a script notice stands in place of the content, told by its wording or, where
    ``origin`` and ``source`` columns are named, by its repetition over both; or the document is in one
    near-duplicate component with such a text. A placeholder must stand in a document's own
    text, so that label is not spread. Null, empty and blank texts and null ids are left
    out; repeated rows count once; texts without words are in no component; an empty table gives
    no rows; other columns are not read.
    """
    ship_package(documents.sparkSession)
    told = lambda c: (F.xxhash64(F.lower(F.trim(c))) if c else F.lit(None).cast("long"))
    named = lambda c: F.when(F.col(c).isNotNull(), told(c)) if c else told(None)
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), named(origin).alias("origin"), named(source).alias("source")).filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    made = materialize(rows.mapInArrow(_with_columns(_reader), "id long, words binary, body long, s0 long, s1 long, s2 long, s3 long, size int, placeholder boolean, residue boolean, origin long, source long"))
    trusted = made.filter("residue and words is not null").select("words")
    if origin and source:
        trusted = trusted.unionByName(repeated_bodies(made))
    held = near_labels(made, rows.select("id", "text"), trusted).select("words", F.lit(True).alias("spread"))
    out = made.select("id", "words", "placeholder", "residue").join(held, "words", "left").withColumn("residue", F.coalesce("spread", "residue"))
    return out.filter("placeholder or residue").groupBy("id").agg(F.max("placeholder").alias("placeholder"), F.max("residue").alias("residue"))


def _with_columns(reader):
    """What ``reader`` gives, and the columns after the text as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in reader(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2), batch.column(3)], names=[*out.schema.names, "origin", "source"])

    return run
