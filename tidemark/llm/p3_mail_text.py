"""Problem 3: the text newly written by the sender of an e-mail.

Marks tell most of it: quote signs and their lead-ins, header blocks, closings, signatures,
disclaimers and list footers. What carries no marks is found in the corpus: the lines that mails
claim as their own are winnowed into fingerprints, and an inverted index of these tells the mails
that share text with an earlier mail of another sender, whatever their subjects and threads. The shared stretches are
then verified run by run and are quotation, line by line.
Lines that one sender ends mail after mail with are closings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import one_row_each, prefix_sums, run_hashes, stretch_hashes, winnowed, word_hashes, words
from tidemark.session import materialize, ship_package

#: Fingerprints are the least of so many successive hashes of runs of so many words: a stretch of 18 words that two mails share gives a shared one.
GRAM, WINDOW = 15, 4
#: Words of a run that is quotation by itself. Unrelated mails of one style share up to 17.
SPAN_WORDS = 18
#: Share of a line's words that must lie in such runs.
LINE_SHARE = 0.8
#: Words of a paragraph that is quotation by itself; shorter ones of at least LEAST_WORDS are only beside other text of the same ancestor.
PARAGRAPH_WORDS, LEAST_WORDS = 12, 4
#: Mails of one sender that must end with a line before it counts as a closing.
RECURRING = 3

QUOTE = re.compile(r"^\s*(?:>|[A-Z][A-Za-z]{0,3}>|[|¦](?!.*[|¦]\s*$)\s?(?=\S))")
_SIGN = re.compile(r"^\s*([»:|#%}¦+~=!])(?:\s|$|[>»:|A-Z])")
_INITIALS = re.compile(r"^\s*[A-Z][A-Za-z]{0,3}>")
# How lead-ins to a quotation end.
LEAD = re.compile(
    r"""(?:\b(?:wrote|writes|said|schrieb|schreibt|a\s[ée]crit|[ée]crit|escribi[óo]|ha\sescrito|ha\sscritto|scrive|schreef)\b[^.!?]{0,60}:|<[^<>\s]+@[^<>\s]+>\s*:|\bye?ou\swrote:|\d{1,2}:\d{2}\b.{0,80}(?:wrote|schrieb|[ée]crit|escribi[óo])\s*:)\s*$""",
    re.IGNORECASE | re.VERBOSE,
)
_LEAD_BEGIN = re.compile(r"^\s*(?:on|am|le|el|at|den|em|il|op|in|---|\d{4}-\d\d-\d\d|\d{1,2}[./]\d|[A-Z][\w'’.-]+(?:\s+[A-Z][\w'’.-]+){0,3}\s*(?:<|$|said|writes|wrote|schrieb))", re.IGNORECASE)
_LEAD_TAIL = re.compile(r"^\s*(?:<[^<>\s]+@[^<>\s]+>|wrote|writes|schrieb|a\s[ée]crit|escribi[óo]|said\b|[A-Z][\w.'-]*\s+(?:<[^<>\s]+>\s*)?(?:wrote|writes|schrieb)|[\w.+-]+@[\w.-]+>?)", re.IGNORECASE)
# Header fields of quoted and forwarded messages.
FIELD = re.compile(r"^\s*\*?(?:from|sent|date|to|cc|bcc|subject|reply-to|von|gesendet|datum|an|betreff|de|envoy[ée]|date|[àa]|objet|enviado(?:\sel)?|fecha|para|asunto|da|inviato|data|oggetto)\s?:\*?(?:\s|$)", re.IGNORECASE)
_FROM = re.compile(r"^\s*\*?(?:from|von|de|da)\s?:\*?\s", re.IGNORECASE)
# Lines that begin an unmarked quoted or forwarded message.
ORIGINAL = re.compile(
    r"^\s*(?:[-_=*]{2,}\s*(?:original\s+message|original\s+e-?mail|forwarded\s+(?:message|by\b.*)|urspr[üu]ngliche\s+nachricht|weitergeleitete\s+nachricht|message\s+(?:d.origine|original|transf[ée]r[ée]|reenviado)|mensaje\s+(?:original|reenviado)|messaggio\s+originale)\s*[-_=*]*|begin\s+forwarded\s+message\s*:|anfang\s+der\s+weitergeleiteten\s+(?:nachricht|e-?mail)\s*:|d[ée]but\s+du\s+message\s+(?:r[ée]exp[ée]di[ée]|transf[ée]r[ée])\s*:|inicio\s+del\s+mensaje\s+reenviado\s*:)\s*$",
    re.IGNORECASE,
)
# Closing formulas, the whole of a line.
CLOSING = re.compile(
    r"""^\s*(?:(?:with\s+)?(?:my\s+|our\s+)?(?:very\s+)?(?:kind(?:est)?|best|warm(?:est)?|many|sincere)\s+(?:regards|wishes|greetings|thanks)|regards|best|all\s+(?:the\s+)?best|cheers|thanks(?:\s+(?:again|a\s+lot|so\s+much|very\s+much|in\s+advance|and\s+regards))?|many\s+thanks|thank\s+you(?:\s+(?:again|very\s+much|so\s+much|in\s+advance))?|thx|(?:yours|your)\s+(?:sincerely|faithfully|truly)|yours|sincerely(?:\s+yours)?|respectfully|cordially|take\s+care|talk\s+soon|see\s+you(?:\s+soon)?|greetings|love|rgds|br
    |mit\s+(?:freundlichen|besten|herzlichen|vielen)\s+gr[üu](?:ß|ss)en|(?:viele|beste|liebe|sch[öo]ne|herzliche|freundliche)\s+gr[üu](?:ß|ss)e|gr[üu](?:ß|ss)e|gru(?:ß|ss)|mfg|lg|vg|danke(?:\s+(?:sch[öo]n|nochmals|im\s+voraus))?|vielen\s+dank|besten\s+dank|hochachtungsvoll|bis\s+bald
    |cordialement|bien\s+(?:cordialement|[àa]\s+(?:vous|toi))|(?:avec\s+)?(?:mes\s+)?(?:meilleures|sinc[èe]res|cordiales|meilleurs|sinc[èe]res)\s+(?:salutations|voeux|v[œo]ux)|salutations(?:\s+distingu[ée]es)?|merci(?:\s+(?:encore|beaucoup|d.avance|bien))?|amicalement|amiti[ée]s|bonne\s+(?:journ[ée]e|soir[ée]e)|[àa]\s+bient[ôo]t|bises
    |(?:un\s+)?(?:cordial\s+|fuerte\s+)?saludos?(?:\s+cordial(?:es)?)?|saludos(?:\s+cordiales)?|(?:muchas\s+|mil\s+)?gracias(?:\s+(?:de\s+nuevo|por\s+todo|de\s+antemano))?|atentamente|cordialmente|un\s+abrazo|abrazos|hasta\s+(?:pronto|luego)|reciba\s+un\s+cordial\s+saludo)\s*[,.!]?\s*$""",
    re.IGNORECASE | re.VERBOSE,
)
RULE = re.compile(r"^\s*(?:-{2,3}|—|–|_{3,}|\*{3,}|={3,}|~{3,}|#{3,}|-{4,}|\+{3,})\s*$")
_SHORT_RULE = re.compile(r"^\s*(?:--|—|–|---|\*{3}|_{3,25}|={3,25}|~{3,25})\s*$")
# Lines that mail programs of hand-helds add.
DEVICE = re.compile(
    r"^\s*(?:sent\s+(?:from|via|by|on)\s+(?:my|the|a|your|[A-Z])\b.*|get\s+(?:the\s+)?.{2,30}\s+(?:app|for\s+(?:ios|android))|von\s+(?:meinem|unterwegs)\b.*(?:gesendet|gesandt)?|gesendet\s+(?:von|mit)\s.*|envoy[ée]\s+(?:de|depuis|par)\s.*|enviado\s+(?:desde|con|de)\s.*|inviato\s+da\s.*|verstuurd\s+vanaf\s.*|(?:please\s+)?excuse\s+(?:my\s+)?(?:typos|brevity).*)$",
    re.IGNORECASE,
)
# How disclaimers and the notes of mail systems begin.
DISCLAIMER = re.compile(
    r"""^\s*(?:confidentiality(?:\s+(?:notice|note))?\b|notice:|disclaimer\b|legal\s+notice\b|important(?:\s+notice)?:|privileged\b|this\s+(?:e-?mail|message|communication|transmission)(?:,?\s+(?:and|including|with|together)\b|\s+(?:is|may|contains|was)\s+(?:confidential|privileged|intended|meant|only|sent|for))|the\s+(?:information|contents?)\s+(?:in|of|contained\s+in)\s+(?:this|the)\s+(?:e-?mail|message)|it\s+may\s+hold\s+confidential|if\s+(?:you\s+(?:are\s+not|have\s+received)|it\s+reached\s+you\s+by\s+mistake|received\s+in\s+error)|copying\s+or\s+passing\s+on|opening\s+attachments|registered\s+office|no\s+contract\s+arises|please\s+(?:think|consider)\s+(?:of\s+)?(?:the\s+)?(?:trees|environment)|any\s+views\b.*author|.{0,40}accepts\s+no\s+(?:liability|responsibility)
    |este\s+(?:mensaje|correo)\s+(?:es\s+confidencial|y\b|contiene|va\s+dirigido)|esta\s+comunicaci[óo]n|aviso\s+(?:legal|de\s+confidencialidad)|si\s+(?:usted\s+)?(?:lo|ha)\s+recibi|antes\s+de\s+imprimir
    |diese\s+(?:e-?mail|nachricht|mail)\s+(?:ist|kann|enth[äa]lt|und|samt)|der\s+inhalt\s+dieser|vertraulich|en\s+cas\s+d.erreur|falls\s+sie\s+(?:nicht|diese|sie|es)|sollten\s+sie\s+(?:nicht|diese)|bitte\s+(?:denken|pr[üu]fen)\s+sie.*(?:umwelt|drucken)|sitz(?:\s+der\s+gesellschaft|:)|gesch[äa]ftsf[üu]hrer
    |ce\s+(?:message|courriel|mail)\s+(?:est|et|peut|contient)|les\s+informations\s+contenues|avis\s+de\s+confidentialit[ée]|confidentialit[ée]|si\s+vous\s+(?:n.[êe]tes\s+pas|avez\s+re[çc]u)|pensez\s+[àa]\s+l.environnement|avant\s+d.imprimer)""",
    re.IGNORECASE | re.VERBOSE,
)
_LEGAL = re.compile(r"confidential|d.erreur|privileged|liability|by\s+mistake|in\s+error|tell\s+the\s+sender|notify\s+the\s+sender|intended\s+recipient|delete\s+it|attachments|registered\s+office|no\s+contract|think\s+of\s+the\s+trees|confidencial|destinatario|vertraulich|irrt[üu]mlich|empf[äa]nger|absender|confidentiel|destinataire|par\s+erreur|b[óo]rrelo|l[öo]schen|supprim|without\s+leave", re.IGNORECASE)
# Footers of mailing lists.
LIST = re.compile(r"mailing\s+list\b|mailing-?liste\b|liste\s+de\s+diffusion|lista\s+de\s+correo|to\s+(?:leave|unsubscribe\s+from|quit)\s+(?:the|this)\s+list|^\s*(?:to\s+)?unsubscribe\b|list-?info|you\s+(?:are\s+receiving|received)\s+this\s+(?:message|e-?mail)?\s*because|abmelden|se\s+d[ée]sinscrire|darse\s+de\s+baja|-(?:leave|unsubscribe|request)@", re.IGNORECASE)
_PHONE = re.compile(r"^\s*(?:(?:t|m|f|tel|phone|fon|mobile|mob|cell|fax|t[ée]l)\b\.?:?\s*)?[+(]?\d[\d ()./-]{4,}\s*$|^\s*(?:tel|phone|fon|mobile|mob|cell|fax|t[ée]l|t|m)\b\.?:?\s*[+\d(]", re.IGNORECASE)
_LINK = re.compile(r"^\s*(?:<?https?://\S+>?|www\.\S+|<?[\w.+-]+@[\w-]+\.[\w.-]+>?)\s*$", re.IGNORECASE)
_SLOGAN = re.compile(r"^\s*[\"“”'«].{3,90}[\"“”'»]\s*$")
_NAME = re.compile(r"^\s*[-–—~]?\s*[^\W\d_][\w'’.-]*(?:\s+[^\W\d_][\w'’.-]*){0,3}\s*$")
_POST = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s\.?|nb|n\.b\.|post\s?scriptum)\s*[:.\-–—]?\s+\S|^\s*(?:ps|p\.s\.)\s*[:.]", re.IGNORECASE)
_ENDED = re.compile(r"[.!?…]\s*$")
_GREETING = re.compile(r"^\s*(?:hi|hello|dear|good\s+(?:morning|day|afternoon|evening)|hey|hallo|liebe[rs]?|guten|sehr|bonjour|bonsoir|ch[èe]re?|salut|hola|buen[oa]s|estimad[oa]|querid[oa]|to\s+whom)\b|^\s*[A-Z][\w'’-]+\s*[-–—,:!]\s*$", re.IGNORECASE)


def _header_block(lines: list[str], i: int) -> int:
    """Number of header lines from i on, 0 if no block begins there."""
    if not _FROM.match(lines[i]):
        return 0
    n = fields = 0
    for line in lines[i : i + 9]:
        if FIELD.match(line):
            fields += 1
        elif not line.strip() or (n and FIELD.match(lines[i + n - 1]) and len(line) < 60 and fields >= 2 and not line.strip().endswith(".")):
            if not line.strip():
                break
        else:
            break
        n += 1
    return n if fields >= 2 else 0


def _lead_length(lines: list[str], i: int) -> int:
    """Lines of the lead-in that ends with line i (1 or 2), 0 if it is none."""
    line = lines[i].strip()
    if not line.endswith(":") or not (LEAD.search(line) or (i and LEAD.search(lines[i - 1].strip() + " " + line))):
        return 0
    if _LEAD_TAIL.match(line) and i and lines[i - 1].strip() and not QUOTE.match(lines[i - 1]) and _LEAD_BEGIN.match(lines[i - 1]) and len(lines[i - 1]) < 100 and not re.search(r"[.!?]\s*$", lines[i - 1]):
        return 2
    return 1


def _signature_line(line: str, names: frozenset[str]) -> bool:
    s = line.strip()
    if not s or _PHONE.match(s) or _LINK.match(s) or _SLOGAN.match(s) or DEVICE.match(s) or _SHORT_RULE.match(s) or CLOSING.match(s):
        return True
    if len(s) > 60 or re.search(r"[.!?:;]$", s):
        return False
    tokens = [w.lower() for w in re.findall(r"[^\W\d_]+", s)]
    if _NAME.match(s) and s[:1].isupper() and tokens and (len(tokens) <= 2 or any(t in n or n in t for t in tokens for n in names if min(len(t), len(n)) >= 3) and len(tokens) <= 3):
        return True
    return False


def marked(text: str, sender: str | None = None) -> list[bool]:
    """For each line, whether it is new by its own marks; blank lines are not."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    n = len(lines)
    state = ["" if x.strip() else "_" for x in lines]  # "" new so far, "_" blank, others off
    # Quotation in marked lines, with the pieces that wrapping cut off them.
    quoted = [bool(QUOTE.match(x)) for x in lines]
    initials = {m.group().strip() for x in lines if (m := _INITIALS.match(x))}
    lone = {k for k in initials if sum(x.lstrip().startswith(k) for x in lines) < 2}
    leads = [_lead_length(lines, i) if x.rstrip().endswith(":") else 0 for i, x in enumerate(lines)]
    signs = {m.group(1) for i in range(n) if leads[i] for x in [next((y for y in lines[i + 1 : i + 3] if y.strip()), "")] if (m := _SIGN.match(x))}
    signs |= {c for c in "»:" if c in text and sum(x.lstrip().startswith(c) for x in lines) >= 3}
    for i, x in enumerate(lines):
        quoted[i] = quoted[i] or x.lstrip()[:1] in signs and x.strip() != "" and not re.match(r"^\s*\|.*\|\s*$", x)
    i = 0
    while i < n:  # a block of bars is a table only if each of its lines is a row of one
        j = i
        while j < n and lines[j].lstrip().startswith("|"):
            j += 1
        if j > i:
            table = all(re.match(r"^\s*\|[^|]*\S[^|]*\|.*\|\s*$", x) and not re.match(r"^\s*\|\s*\|", x) for x in lines[i:j])
            quoted[i:j] = [not table] * (j - i)
        i = max(j, i + 1)
    led = {k for i in range(n) if leads[i] for k in range(i + 1, min(n, i + 3)) if _INITIALS.match(lines[k])}
    for i, x in enumerate(lines):
        if i not in led and quoted[i] and (m := _INITIALS.match(x)) and m.group().strip() in lone and ">" not in x[len(m.group()) : len(m.group()) + 3]:
            near = any(0 <= j < n and quoted[j] and j != i for j in (i - 1, i + 1))
            quoted[i] = near
    wide = max((len(x) for x, y in zip(lines, quoted) if y), default=0)
    for i in range(n):
        if not quoted[i]:
            continue
        state[i] = "q"
        j = i + 1
        while j < n and not quoted[j] and lines[j].strip():
            j += 1
        if j == i + 1:
            continue
        # Lines that wrapping cut off a quoted one go on where it stopped.
        content, ended = lines[i].strip(), re.search(r"[.!?:;][\"'»”)]*$", lines[i].strip())
        onward = j < n and quoted[j] and j - i <= 6 and re.match(r"^[\s>|»:A-Z]*[\s>|»:]\s*[a-zà-ÿ]", lines[j])
        if len(content) >= 40 and (not ended or onward or lines[i + 1].strip()[:1].islower()) or onward and not ended:
            for k in range(i + 1, j):
                stopped = k > i + 1 and re.search(r"[.!?][\"'»”)]*$", lines[k - 1].strip()) and lines[k].strip()[:1].isupper()
                if stopped and (len(lines[k].strip()) > wide + 6 or not (j < n and quoted[j])):
                    break
                state[k] = "q"
    # Lead-ins.
    for i in range(n):
        if state[i] == "" and (length := leads[i]):
            after = next((j for j in range(i + 1, n) if lines[j].strip()), None)
            if after is not None and (state[after] == "q" or ORIGINAL.match(lines[after]) or _header_block(lines, after)) and after - i <= 3 or after is None:
                for k in range(i - length + 1, i + 1):
                    state[k] = "l"
            elif after is not None and length and re.search(r"@|\d{1,2}[:.]\d{2}|\bschrieb\b", " ".join(lines[i - length + 1 : i + 1])) and _LEAD_BEGIN.match(lines[i - length + 1]):
                for k in range(i - length + 1, n):  # what follows is quoted without marks
                    state[k] = state[k] or "q"
                for k in range(i - length + 1, i + 1):
                    state[k] = "l"
    # Unmarked originals: everything below is older.
    for i in range(n):
        block = _header_block(lines, i) if state[i] == "" else 0
        if state[i] == "" and (ORIGINAL.match(lines[i]) or block):
            begin = i
            before = next((j for j in range(i - 1, -1, -1) if lines[j].strip()), None)
            if before is not None and RULE.match(lines[before]) and state[before] == "":
                begin = before
            for k in range(begin, n):
                state[k] = state[k] or "o"
            break
    # List footers.
    for i in range(n):
        if state[i] == "" and LIST.search(lines[i]) and len(lines[i]) < 110:
            begin = i
            before = next((j for j in range(i - 1, -1, -1) if lines[j].strip()), None)
            if before is not None and RULE.match(lines[before]) and state[before] == "":
                begin = before
            rest = [k for k in range(i, n) if state[k] == ""]
            if len(rest) <= 8:
                for k in [begin, *rest]:
                    state[k] = "f"
    # Disclaimers: paragraphs, or what stands between rules.
    i = 0
    while i < n:
        if state[i] == "" and (i == 0 or state[i - 1] != "" or RULE.match(lines[i - 1])):
            j = i
            while j < n and state[j] == "":
                j += 1
            block = [k for k in range(i, j) if not RULE.match(lines[k])]
            if block:
                begin = next((k for k in block if DISCLAIMER.match(lines[k]) and _LEGAL.search(" ".join(lines[k:j]))), None)
                joined = " ".join(lines[k] for k in block)
                if begin is not None and (begin == block[0] or RULE.match(lines[begin - 1]) or len(set(m.lower() for m in _LEGAL.findall(joined))) >= 2 and _signature_line(lines[begin - 1], frozenset())):
                    if begin == block[0]:
                        begin = i
                    for k in range(begin, j):
                        state[k] = "d"
            i = j
        else:
            i += 1
    for i in range(n):  # rules around disclaimers
        if state[i] == "" and RULE.match(lines[i]) and len(lines[i].strip()) >= 10:
            near = [j for j in (next((j for j in range(i - 1, -1, -1) if lines[j].strip()), None), next((j for j in range(i + 1, n) if lines[j].strip()), None)) if j is not None]
            if any(state[j] in ("d", "f") for j in near):
                state[i] = "d"
    # Closings and signatures: of each stretch of own text, from the closing down to what follows it.
    names = frozenset(t for t in re.findall(r"[a-z]+", (sender or "").split("@")[0].lower()) if len(t) >= 3)
    i = 0
    while i < n:
        if state[i] not in ("", "_"):
            i += 1
            continue
        j = i
        while j < n and state[j] in ("", "_"):
            j += 1
        own = [k for k in range(i, j) if state[k] == ""]
        if own:
            _cut_signature(lines, state, own, names, not any(x in ("q", "o", "l") for x in state))
        i = j
    return [s == "" for s in state]


def _cut_signature(lines: list[str], state: list[str], own: list[int], names: frozenset[str], last_only: bool) -> None:
    """Mark the closing of one stretch of own text and all below it, postscripts excepted."""
    begin = None
    for p, k in enumerate(own):
        rest = own[p + 1 :]
        line = lines[k]
        if CLOSING.match(line) and len(rest) <= 9 and all(len(lines[r].strip()) <= 75 for r in rest if not _POST.match(lines[r]) and not DISCLAIMER.match(lines[r])):
            prose = [r for r in rest if len(lines[r].split()) > 7 and not _POST.match(lines[r]) and not _SLOGAN.match(lines[r]) and not DEVICE.match(lines[r])]
            if not prose:
                begin = p
                break
        if _SHORT_RULE.match(line) and rest and len(rest) <= 8:
            body = [r for r in rest if not _POST.match(lines[r])]
            if body and all(len(lines[r].strip()) <= 75 and len(lines[r].split()) <= 9 for r in body):
                begin = p
                break
        if _SHORT_RULE.match(line) and not rest:
            begin = p
            break
    if begin is None:
        p = len(own)
        while p > 0 and _signature_line(lines[own[p - 1]], names) and not _POST.match(lines[own[p - 1]]):
            p -= 1
        # Role and office lines stand between the name and the numbers.
        q = len(own)
        while q > 0 and len(lines[own[q - 1]].split()) <= 6 and len(lines[own[q - 1]].strip()) <= 60 and not re.search(r"[.!?:;,]\s*$", lines[own[q - 1]]) and not _GREETING.match(lines[own[q - 1]]) and (q == len(own) or own[q] - own[q - 1] == 1):
            q -= 1
        block = own[q:]
        strong = sum(bool(_PHONE.match(lines[k]) or _LINK.match(lines[k]) or _SLOGAN.match(lines[k]) or DEVICE.match(lines[k])) for k in block)
        apart = bool(block) and (q == 0 or own[q] - own[q - 1] > 1)
        if block and apart and q > 0 and (strong or _signature_line(lines[block[0]], names)) and lines[block[0]].strip()[:1].isupper() and not re.match(r"\s*(?:[-*•|]|\d+[.)])\s", lines[block[0]]):
            p = min(p, q)
        elif block and q == 0 and strong and len(block) > 1:
            p = min(p, q)
        if p == 0 and len(own) == 1 and _NAME.match(lines[own[0]]) and not last_only:
            begin = 0
        elif p < len(own) and (p > 0 or DEVICE.match(lines[own[p]]) or len(own) - p > 1) and (p == 0 or own[p] - own[p - 1] > 1 or DEVICE.match(lines[own[p]]) or _SHORT_RULE.match(lines[own[p]]) or len(own) - p > 1):
            begin = p
    if begin is None:
        return
    post = False
    for k in own[begin:]:
        post = (post and k - 1 in range(len(lines)) and lines[k - 1].strip() != "" and not _signature_line(lines[k], names)) or bool(_POST.match(lines[k]))
        if not post:
            state[k] = "s"


def _spans(numbers: list[int]) -> list[list[int]]:
    """Runs of successive line numbers: the paragraphs of own lines."""
    out: list[list[int]] = []
    for no in numbers:
        if out and no == out[-1][-1] + 1:
            out[-1].append(no)
        else:
            out.append([no])
    return out


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What later steps need of a mail, without its text.

    The numbers of its own lines; the winnowed fingerprints of their words; of each paragraph of own
    lines, from each of its lines to its end, the number and a digest of the words; and the last
    lines that may be closings, from the end (k) on.
    """
    part = pa.struct([("begin", pa.int32()), ("last", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_()), ("digest", pa.int64())])
    closing = pa.struct([("k", pa.int32()), ("no", pa.int32()), ("line", pa.string())])
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for i, sender, text in zip(*(batch.column(c).to_pylist() for c in ("id", "from", "text"))):
            lines = text.split("\n")
            new = [k for k, x in enumerate(marked(text, sender)) if x]
            found = [words(lines[k]) for k in new]
            starts = np.cumsum([0, *map(len, found)])  # the first word of each own line, and the end
            h = word_hashes([w for line in found for w in line])
            sums = prefix_sums(h)
            at, parts, ends = 0, [], []
            for span in _spans(new):
                end = int(starts[at + len(span)])
                for k in range(len(span)):
                    n = end - int(starts[at + k])
                    if n >= (LEAST_WORDS if k == 0 else PARAGRAPH_WORDS):
                        parts.append({"begin": span[k] + 1, "last": span[-1] + 1, "n": n, "whole": k == 0})
                        ends.append((end - n, end))
                at += len(span)
            if parts:
                for x, digest in zip(parts, stretch_hashes(sums, *np.array(ends).T).tolist()):
                    x["digest"] = digest
            grams = np.arange(max(0, len(h) - GRAM + 1))
            fingers = winnowed(stretch_hashes(sums, grams, grams + GRAM), WINDOW)
            tail = [{"k": k, "no": no + 1, "line": low} for k, no in enumerate(reversed(new[-3:])) if not _ENDED.search(lines[no]) and 2 <= len(low := " ".join(lines[no].split()).casefold()) <= 60 and len(low.split()) <= 6] if len(new) > 3 else []
            for col, value in zip(cols, (i, [k + 1 for k in new], fingers, parts, tail)):
                col.append(value)
        types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(part), pa.list_(closing)]
        kept = ["at", "sender", "named", "reply"]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), *(batch.column(c) for c in kept)], names=["id", "new", "fingers", "parts", "tail", *kept])


def _earliest(held: DataFrame, key: str) -> DataFrame:
    """(key, sender1, at1, id1): of what mails of several senders hold, the earliest holder.

    Holders are counted by sender before they are compared, so a key that a third of all mails
    hold is one row for each sender.
    """
    per = held.groupBy(key, "sender").agg(F.min(F.struct("at", "id")).alias("x"))
    first = per.groupBy(key).agg(F.min(F.struct("x", "sender")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return first.select(key, F.col("m.sender").alias("sender1"), F.col("m.x.at").alias("at1"), F.col("m.x.id").alias("id1"))


def _by_ancestor(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, id, at, sender, ...) whose key another sender's mail held first, with that ``ancestor``."""
    met = rows.join(_earliest(held, key), key).filter("sender != sender1 and (at1 < at or (at1 = at and id1 < id))")
    return met.select(*rows.columns, F.col("id1").alias("ancestor"))


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, numbers, starts, runs): own lines, the place of the first word of each, and the hashes of all runs in order."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for i, text, new in zip(*(batch.column(c).to_pylist() for c in range(3))):
            lines = text.split("\n")
            found = [words(lines[no - 1]) for no in new]
            starts = np.cumsum([0, *map(len, found)]).tolist()
            for col, value in zip(out, (i, new, starts, run_hashes([w for line in found for w in line], SPAN_WORDS))):
                col.append(value)
        types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "numbers", "starts", "runs"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, no) of the lines of whose words LINE_SHARE lie in runs of ancestors, and of those between two such lines of which half do."""
    for batch in batches:
        ids, numbers = [], []
        for i, nos, starts, places in zip(*(batch.column(c).to_pylist() for c in range(4))):
            old = np.zeros(starts[-1] + 1, dtype=np.int32)
            for p in places:
                old[p] += 1
                old[min(p + SPAN_WORDS, starts[-1])] -= 1
            inside = np.concatenate([[0], np.cumsum(np.cumsum(old)[:-1] > 0)])
            n = [b - a for a, b in zip(starts, starts[1:])]
            hit = [int(inside[b] - inside[a]) for a, b in zip(starts, starts[1:])]
            full = [m > 0 and c >= LINE_SHARE * m - 1e-9 for m, c in zip(n, hit)]
            for k, no in enumerate(nos):
                near = 0 < k < len(nos) - 1 and full[k - 1] and full[k + 1] and 2 * hit[k] >= n[k]
                if full[k] or near:
                    ids.append(i), numbers.append(no)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["id", "no"])


def quoted_lines(made: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, no) of own lines that an earlier mail of another sender has as its own.

    ``made``: the first pass with at and sender; ``rows``: (id, text). The index of winnowed
    fingerprints tells the mails that share any stretch of ``GRAM + WINDOW - 1`` words with another sender's; only
    these are read again, and each of their runs of ``SPAN_WORDS`` words looks for its own
    ancestor, so that a mail may quote several. Paragraphs are looked up whole, and from each of
    their lines on; short ones count where their holder is an ancestor of the mail already.
    Nothing is compared pair by pair, and no list of holders is formed.
    """
    who = made.select("id", "at", "sender")
    posts = made.select("id", "at", "sender", F.explode("fingers").alias("v"))
    able = materialize(posts.join(_earliest(posts, "v").select("v"), "v", "left_semi").select("id").distinct())
    own = materialize(rows.join(made.join(able, "id", "left_semi").select("id", "new"), "id").select("id", "text", "new").mapInArrow(_runs_of, "id long, numbers array<int>, starts array<int>, runs array<long>"))
    runs = own.select("id", F.posexplode("runs").alias("place", "v")).join(who, "id")
    spans = materialize(_by_ancestor(runs, runs, "v").select("id", "place", "ancestor"))
    places = spans.groupBy("id").agg(F.collect_set("place").alias("places"))  # of one mail
    stretches = own.join(places, "id").select("id", "numbers", "starts", "places").mapInArrow(_covered, "id long, no int")
    parts = made.select("id", "at", "sender", F.explode("parts").alias("p")).select("id", "at", "sender", "p.*")
    known = materialize(_by_ancestor(parts, parts.filter("whole"), "digest"))
    whole = known.filter(F.col("n") >= PARAGRAPH_WORDS)
    ancestors = spans.select("id", "ancestor").unionByName(whole.select("id", "ancestor")).distinct()
    short = parts.filter(F.col("whole") & (F.col("n") < PARAGRAPH_WORDS)).join(ancestors, "id")
    held = parts.filter(F.col("whole") & (F.col("n") < PARAGRAPH_WORDS)).select(F.col("id").alias("ancestor"), "digest").distinct()
    short = short.join(held, ["ancestor", "digest"], "left_semi")
    paragraphs = whole.select("id", "begin", "last").unionByName(short.select("id", "begin", "last"))
    return stretches.unionByName(paragraphs.select("id", F.explode(F.sequence("begin", "last")).alias("no"))).distinct()


def closing_lines(made: DataFrame) -> DataFrame:
    """(id, no) of the last own lines that mails of the same sender end with again and again."""
    ends = made.filter("named").select("id", "sender", F.explode("tail").alias("t")).select("id", "sender", "t.*")
    recurring = ends.select("id", "sender", "line").distinct().groupBy("sender", "line").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= RECURRING)
    met = ends.join(recurring, ["sender", "line"])
    held = [F.max(F.when(F.col("k") == k, F.col("no"))).alias(f"n{k}") for k in range(3)]
    flat = met.groupBy("id").agg(*held)
    # From the last line up, as far as each of them recurs.
    run = F.when(F.col("n0").isNull(), F.array().cast("array<int>")).when(F.col("n1").isNull(), F.array("n0")).when(F.col("n2").isNull(), F.array("n0", "n1")).otherwise(F.array("n0", "n1", "n2"))
    return flat.select("id", F.explode(run).alias("no"))


def new_text(mails: DataFrame, key: str = "email_id", subject: str = "subject", text: str = "text", sender: str = "from_addr", at: str = "received_at") -> DataFrame:
    """(email_id, line_no) of the non-blank lines newly written by each mail's sender.

    Rows delivered twice count once; of unlike rows of one id the greatest holds. Null and empty
    texts have no lines; null senders, subjects and times are looked past (a mail without sender
    is of a sender of its own, one without time counts as the latest); null ids are left out;
    an empty table gives no rows; other columns are not read.

    Lines without marks are quotation where a mail of another sender received earlier has them as its
    own, see :func:`quoted_lines`; no thread or subject is asked for. A mail with nothing else
    in it is one of several copies of a text and keeps its lines, unless its subject is
    marked as a reply or forward. What a sender wrote earlier and sends again is new.
    """
    ship_package(mails.sparkSession)
    i, name, subjects = F.col(key).cast("long"), F.col(sender), F.coalesce(F.col(subject), F.lit(""))
    reply = subjects.rlike(r"(?i)^\s*(?:\[[^\]]*\]\s*)?(?:re|fw|fwd|aw|wg|sv|vs|antw|antwort|r[ée]p|tr|rv|res|ref|i|enc)(?:\[\d+\])?\s*:")
    rows = mails.select(
        i.alias("id"), name.alias("from"), F.col(text).alias("text"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(2**62)).alias("at"),
        F.coalesce(F.lower(F.trim(name)), F.concat(F.lit("?"), i.cast("string"))).alias("sender"), name.isNotNull().alias("named"), reply.alias("reply"),
    )
    rows = one_row_each(rows.filter("id is not null and text is not null"), ["id"])
    read = rows.mapInArrow(_first_pass, "id long, new array<int>, fingers array<long>, parts array<struct<begin: int, last: int, n: int, whole: boolean, digest: long>>, tail array<struct<k: int, no: int, line: string>>, at long, sender string, named boolean, reply boolean")
    made = materialize(read)
    quoted = materialize(quoted_lines(made, rows.select("id", "text")))
    numbered = made.select("id", F.explode("new").alias("no"))
    counts = quoted.join(numbered, ["id", "no"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    copies = made.join(counts, "id").filter("c = size(new) and not reply").select("id")
    off = quoted.join(copies, "id", "left_anti").unionByName(closing_lines(made))
    kept = numbered.join(off, ["id", "no"], "left_anti")
    return kept.select(F.col("id").alias("email_id"), F.col("no").cast("long").alias("line_no"))
