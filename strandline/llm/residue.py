"""Template residue, filler, error pages and script notices in texts: a linear classifier on hashed n-grams.

Each text is cut into segments (lines and sentences); a segment's score is a sum of weights of its hashed byte
n-grams, its length and its being the title (first) line; a text's score is that of its worst segment. The model
is trained here, on weak labels from status lines, phrases and slot shapes (``weak_label``).
"""

from __future__ import annotations

import random
import re
import re._parser as rx
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.sizes import canon_source_name
from strandline.plans.tables import materialise

BITS = 18
GRAMS = ((4, False), (6, True), (10, True))  # length in bytes, lower case
MAX_SEGMENT = 512
OVERLAP = 128  # bytes that pieces of a longer segment share, more than any n-gram and most slots and notices
BIAS = -3.0  # fixed, so that residue needs evidence
CHUNK = 1 << 19
LENGTHS = 12
SEED_WEIGHT = 0.02  # of a segment made from a pattern; one seen once has 0.7
EXTRA = LENGTHS + 1  # length classes and the title flag

_DIGITS = bytes(0x30 if 0x30 <= i <= 0x39 else 0x0A if i == 0x0D else i for i in range(256))
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


# ---------------------------------------------------------------------------------------------------------------
# Weak labels, evaluated on the bounded training sample. Scores are the model's; of what it finds, MENTIONS alone are checked.

#: Words that ask for an entry.
_ASKED = "your|insert|enter|add|paste|fill in|type|name|hier|bitte|ins[ée]rer|indiquer|compl[ée]ter|ajouter|insertar|indicar|completar|escribir|su|votre|ihr|todo|tbd"
#: Shapes of slots that were never filled, or filled with an empty value.
SLOTS = [
    r"\{\{\s*[\w .\-]+\s*\}\}", r"\[\[\s*[\w .\-]+\s*\]\]", r"<%=?\s*[\w .\-]+\s*%>", r"[$#]\{\s*[\w .\-]+\s*\}", r"%\(\w+\)[sdf]",
    r"\{%\s*\w+[^%]*%\}", r"@@\w+@@", r"\$[A-ZÀ-Ü_]{3,}\$", r"«\s*[\w .\-]+\s*»", r"&lt;\s*[\w .\-]+\s*&gt;", r"(?<![\w(])\{\d+\}", r"(?:^|[\s(])\{[a-zà-ü][\wà-ü ]{2,30}\}(?=[\s,.;:%)]|$)", r"__[A-Z]{3,}__", r"(?<!\w)_{4,}(?!\w)", r"(?:^|\s)%[sd]\b", r"%[A-Z_]{4,}%",
    rf"<(?:{_ASKED})\b[^<>]{{0,60}}>", rf"\[(?:{_ASKED})\b[^\]\n]{{0,60}}\]",
    r"\bXX+(?:\.X+)?\b", r"\[object Object\]", r"#REF!", r"#N/A\b", r"#VALUE!", r"(?::|\bwas|\bon|\bis|\bby|\bto|\bof|\bfor|\bvon|\bde)\s(?:None|NaN|undefined|null|NULL|nil)\b", r"\b(?:None|NaN|undefined|null)-fold\b", r"<!--[^>]{0,80}-->",
]
#: Instructions to the writer.
INSTRUCTIONS = [
    r"\b(?:TODO|TBD|FIXME)\b\s*[:\-–]?", r"\bkeep it to \w+ sentences\b", r"\bdelete this (?:line|paragraph|section|text)\b", r"\breplace (?:this|the) (?:paragraph|text|line|section)\b", r"\b(?:sub)?title goes here\b", r"\btitle of your (?:report|document|page)\b",
    r"\b(?:text|content|description|summary|name) goes here\b", r"\byour (?:text|summary|title|name|content) here\b", r"\bhier (?:eintragen|einfügen|ergänzen)\b|\bhier eingeben\b", r"\bcompl[ée]ter cette section\b", r"\bcompletar esta secci[óo]n\b",
    r"\bvotre (?:résumé|texte|titre|nom) ici\b", r"\bsu (?:resumen|texto|título|nombre) aquí\b", r"\bihre? (?:text|zusammenfassung|titel|name) hier\b", r"\bwrite (?:two|one|a few|three)\b[^.]{0,40}\babout\b", r"\bfill (?:in|out) (?:the|this)\b[^.]{0,40}\b(?:before|here)\b",
    r"\bà (?:remplacer|compléter)\b", r"\b(?:wird|werden) noch (?:ergänzt|ersetzt)\b", r"\bnoch (?:auszufüllen|zu ergänzen)\b", r"\bpor completar\b|\bque será sustituido\b",
]
#: Filler.
FILLER = [
    r"\blorem[\s\-]+ipsum\b", r"\bplaceholder text\b", r"\bdummy (?:entry|text|content)\b", r"\bsample text\b", r"\bexample paragraph\b", r"\bfor layout purposes\b", r"\b(?:blindtext|mustertext|platzhaltertext|fülltext|beispieltext)\b",
    r"\btexte (?:de remplissage|d'exemple|factice|fictif)\b", r"\btexto de (?:ejemplo|relleno|muestra)\b", r"\bthe quick (?:sample|brown)\b", r"\b(?:asdf|qwerty|jkl|foo bar|blah blah)\b", r"\btest test\b", r"(?:n/a[ \-]+){3,}",
]
#: Notices that scripts, cookies or another browser are needed.
_SCRIPT = r"(?:java ?script|scripts?|cookies?|skripte?)"
NOTICES = [
    rf"\b(?:enable|turn on|switch on|activate|allow|need|requires?)\b[^.]{{0,30}}\b{_SCRIPT}\b", rf"\b{_SCRIPT}\b[^.]{{0,40}}\b(?:disabled|turned off|must be|blocked|required|needed|benötigt|erforderlich|deaktiviert|désactivé|desactivad|requis|necesari)", r"\bscript support\b", r"^noscript\b",
    rf"\b(?:aktivieren|activer|active|habilite)\b[^.]{{0,30}}\b{_SCRIPT}\b", rf"\b{_SCRIPT}\b[^.]{{0,30}}\b(?:aktivieren|activer|activar)\b", r"\b(?:your|this) browser (?:does not|doesn't|is not|isn't|is too)\b", r"\bbrowser unterstützt\b[^.]*\bnicht\b", r"\bnavigateur ne (?:prend|supporte|permet)\b",
    r"\bnavegador no (?:admite|soporta|es compatible)\b", r"\bchecking your browser\b", r"\b(?:update|upgrade) your browser\b", r"\bskripte benötigt\b", r"\bcontent cannot be shown\b", r"^loading\.\.\.$",
]
_STATUS = (
    r"not found|forbidden|unauthori[sz]ed|bad request|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|request time-?out|gone|access denied|page not found|temporarily unavailable|method not allowed|payload too large|"
    r"interner serverfehler|seite nicht gefunden|zugriff verweigert|nicht gefunden|dienst nicht verfügbar|sitzung abgelaufen|verboten|erreur interne|page introuvable|accès refusé|accès interdit|service indisponible|session expirée|délai dépassé|"
    r"error interno(?: del servidor)?|página no encontrada|acceso denegado|servicio no disponible|sesión caducada|tiempo de espera agotado|database error|session expired|upload failed|oops!?|prohibido|solicitud incorrecta"
)
#: Error and refusal pages: status lines and their usual sentences.
ERRORS = [
    rf"^(?:(?:http|error|fehler|erreur)[ :\-–]*)?(?:\(?[45]\d\d\)?)?[ :\-–.]*(?:{_STATUS})[ .!]*(?:\([45]\d\d\))?[ .!]*(?:request id .*)?$", rf"\b(?:http|error|fehler|erreur)\s*[45]\d\d\b", rf"^[45]\d\d[ :\-–]+(?:{_STATUS})", rf"^(?:{_STATUS}) \([45]\d\d\)", rf"<(?:title|h1)>[^<]*(?:{_STATUS})",
    r"\brequest id [0-9a-f]{4,}\b", r"\bsession has expired\b", r"\btraceback \(most recent call last\)", r"\b(?:requested|angeforderte|demandée|solicitada)\b[^.]{0,40}\b(?:not be found|existiert nicht|n'existe pas|no existe|does not exist)\b", r"\bpage you are looking for\b", r"\bcould not (?:connect to|load this)\b", r"\btoo many connections\b", r"^template error\b",
    r"\b(?:query|request) (?:did not finish|timed out)\b", r"\bexceeded your rate limit\b", r"\bslow down and retry\b", r"\byou (?:must|need to) be (?:signed|logged) in\b", r"\bsie sind nicht angemeldet\b", r"\bmelden sie sich (?:erneut )?an\b", r"\b(?:down for|under|en|in) (?:maintenance|wartung|mantenimiento)\b",
    r"\binvalid response from the upstream\b", r"\bhas been removed by its owner\b", r"\b(?:record|page|report) (?:has been removed|is no longer available)\b", r"\bsearch returned no results\b", r"\bcheck the spelling and try again\b", r"\b(?:try again later|später erneut|réessayer plus tard|réessayez plus tard|inténtelo de nuevo)\b",
    r"\breload the page or go back\b", r"\bfile is empty or truncated\b", r"\byou (?:do not|don't) have permission\b", r"\bvous n'êtes pas (?:autorisé|connecté)\b", r"\bno tiene permiso\b|\bno ha iniciado sesión\b", r"\bserver(?: is|s are)? (?:currently )?(?:unavailable|overloaded)\b", r"\ban? (?:unexpected|internal) error (?:has )?occurred\b",
]
#: A sentence that quotes, describes or uses such things is no case: marks of code or speech, verbs of saying and explaining,
#: and words for the parts of templates.
MENTIONS = [
    r"`[^`]+`", r"\b(?:said|says|say|read|reads|asked|answered|showed|shows|displayed|reported)\b[^.]{0,60}(?:[\"“„«»”]|\b[45]\d\d\b)", r"\b(?:explained|described|documented|discussed|quoted|mentioned|means|refers to)\b", r"\b(?:erklärt|beschrieben|erläutert|bedeutet|expliqué|décrit|signifie|se explica|se describe|significa)\b",
    r"\b(?:manual|manuals|handbuch|manuel|documentation|dokumentation|documentación)\b", r"\b(?:template|plantilla|vorlage|vorlagentext|modèle|gabarit)\b[^.]{0,60}\b(?:slots?|fields?|feld|felder|hueco|champ|campo)\b", r"\bas (?:an )?(?:input|example|test data)\b",
]
ALL = {"slot": SLOTS, "instruction": INSTRUCTIONS, "filler": FILLER, "notice": NOTICES, "error": ERRORS}


def anchors(tree) -> set[str]:
    """Strings (lower case) of which a match of the parsed pattern holds at least one; empty where there are none."""
    found, run = [], ""
    for op, av in [*tree, (None, None)]:
        many = op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and av[0] > 0
        if op is rx.LITERAL or many and len(av[2]) == 1 and av[2][0][0] is rx.LITERAL:
            run += chr(av[2][0][1] if many else av).lower() * (av[0] if many else 1)
            if not many:
                continue
        if run:
            found.append({run})
            run = ""
        if op is rx.SUBPATTERN:
            found.append(anchors(av[3]))
        elif op is rx.BRANCH:
            parts = [anchors(x) for x in av[1]]
            found.append(set().union(*parts) if all(parts) else set())
        elif many:
            found.append(anchors(av[2]))
    # the rarest: long ones, or with a mark that is no letter
    rare = lambda a: len(a) + 4 * any(not (c.isalnum() or c == " ") for c in a)
    return max(found, key=lambda x: min(map(rare, x), default=0), default=set())


def example(tree, rng: random.Random) -> str:
    """A string of the parsed pattern's language, but for what look-arounds and classes of spaces and digits rule out."""
    out = []
    for op, av in tree:
        if op is rx.LITERAL:
            out.append(chr(av))
        elif op is rx.SUBPATTERN:
            out.append(example(av[3], rng))
        elif op is rx.BRANCH:
            out.append(example(rng.choice(av[1]), rng))
        elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT):
            low, high, part = av
            if len(part) == 1 and part[0][0] is rx.IN and high > 1:
                out.append(_fill_class(part[0][1], low, high, rng))
            else:
                out += [example(part, rng) for _ in range(rng.randint(low, min(high, low + 1)))]
        elif op is rx.IN:
            out.append(_of_class(av, rng))
        elif op is rx.NOT_LITERAL or op is rx.ANY:
            out.append(" ")
    return "".join(out)


def _fill_class(items, low: int, high: int, rng: random.Random) -> str:
    """Characters of a repeated class: a word where it holds letters, a word between spaces where it rules some out."""
    if items[0][0] is rx.NEGATE:
        return f" {rng.choice(WORDS)} "[: int(high)] if high > 8 and rng.random() < 0.7 else " " * max(1, low)
    ranges = {av for op, av in items if op is rx.RANGE}
    if (rx.CATEGORY, rx.CATEGORY_WORD) in items or (97, 122) in ranges:
        fits = [w for w in WORDS if low <= len(w) <= high and (" " in map(chr, (av for op, av in items if op is rx.LITERAL)) or " " not in w)]
        return rng.choice(fits or ["name"])
    if (65, 90) in ranges:
        return rng.choice([w for w in WORDS if len(w) >= low and w.isascii()]).upper().replace(" ", "_" if (rx.LITERAL, 95) in items else "")
    return "".join(_of_class(items, rng) for _ in range(max(low, rng.randint(0, 1))))


def _of_class(items, rng: random.Random) -> str:
    if items[0][0] is rx.NEGATE:
        return " "
    op, av = rng.choice(items)
    if op is rx.LITERAL:
        return chr(av)
    if op is rx.RANGE:
        return chr(rng.randint(*av))
    return {rx.CATEGORY_DIGIT: "4", rx.CATEGORY_SPACE: " "}.get(av, rng.choice("abcdefghijklmnoprstuvw"))


#: What stands in the open places of patterns when examples are made from them.
WORDS = ("name", "your name", "date", "title", "sample name", "site", "summary", "contact person", "lab", "value", "first name", "page", "text", "description", "nombre", "fecha", "nom", "titre", "datum", "zusammenfassung", "report", "this", "the", "in order to", "und", "de la", "to view", "is")
_PARSED = {k: [rx.parse(p) for p in ps] for k, ps in ALL.items()}
_I = re.IGNORECASE
_ASK = [p for p in SLOTS if p.startswith((r"\[(", "<(?"))]
#: Patterns that are tried together, and strings (lower case) without any of which none of them can match; they spare the
#: regular expressions.
_GROUPS = []
for _patterns, _flags in (([*SLOTS, INSTRUCTIONS[0]], 0), (_ASK, _I), (INSTRUCTIONS[1:], _I), (FILLER, _I), (NOTICES, _I), (ERRORS, _I)):
    _a = [anchors(rx.parse(p)) for p in _patterns]
    _GROUPS.append((re.compile("|".join(f"(?:{p})" for p in _patterns), _flags), tuple(sorted(set().union(*_a))) if all(_a) else ("",)))
_ERROR, _MENTION, _LOREM = _GROUPS[-1][0], re.compile("|".join(f"(?:{p})" for p in MENTIONS), _I), re.compile(FILLER[0], _I)


def seeds(context: Sequence[str] = (), each: int = 12, seed: int = 0) -> pd.DataFrame:
    """Labelled segments made from the patterns themselves: examples of each alone, in a frame, in other text and in capitals, a
    mention that quotes it, and the same frames without it as other text.

    They give small tables what large ones hold anyway; without any other text there are none. ``context`` are segments of other text; a slot takes the place of a
    word in them, other examples follow them. The number of rows depends on the patterns alone.
    """
    rng = random.Random(seed)
    rows: dict[str, int] = {}
    for w in WORDS:
        rows |= {w: 0, w.capitalize(): 0, rng.choice((" | ", " · ", " / ")).join(x.capitalize() for x in [w, *rng.sample(WORDS, 2)]): 0}
    context = [x for x in context if 3 <= x.count(" ") < 40] or ["It was read again on the next day."]
    for kind, trees in _PARSED.items():
        for tree in trees:
            for _ in range(each):
                x = re.sub(r"\s+", " ", example(tree, rng)).strip()
                if weak_label(x) != 1:
                    continue
                rows[x] = 1
                a, b = rng.choice(WORDS), rng.choice(WORDS)
                words = rng.choice(context).split(" ")
                if kind == "slot":
                    words[rng.randrange(len(words))] = x
                    pairs = [(f"{a.capitalize()}: {x}", f"{a.capitalize()}: {b}"), (f"{a.capitalize()} {x} {b}.", f"{a.capitalize()} {b}.")]
                else:
                    words.append(x + ".")
                    pairs = [(x[:1].upper() + x[1:] + ".", f"{a.capitalize()}."), (x.upper(), a.upper())]
                for bad, good in [*pairs, (" ".join(words), None)]:
                    if weak_label(bad) == 1:
                        rows[bad] = 1
                        if good is not None:
                            rows[good] = 0
                quoted = rng.choice((f'The {a} said "{x}" then.', f"The text `{x}` is explained in the manual.", f"The template has a field {x} that is described there."))
                if weak_label(quoted) == -1:
                    rows[quoted] = 2
    out = pd.DataFrame([(re.sub(r"\d", "0", s), 0, k) for s, k in rows.items()], columns=["segment", "title", "kind"]).drop_duplicates("segment")
    return out.assign(**{c: (out["kind"] == k).astype(int) for k, c in enumerate(("other", "residue", "mention"))}, h=0)


def _repeats(segment: str) -> bool:
    words = segment.lower().split()
    return len(words) >= 6 and len(set(words)) * 3 <= len(words)


def look(segment: str) -> tuple[int, bool]:
    """The weak label of a segment, and whether other text holds a string of the phrase patterns (a near miss)."""
    if _repeats(segment):
        return 1, False
    low = segment.lower()
    near = False
    for k, (pattern, triggers) in enumerate(_GROUPS):
        if any(t in low for t in triggers):
            if pattern.search(segment):
                return (-1 if _MENTION.search(segment) else 1), False
            near = near or k > 1
    return 0, near


def weak_label(segment: str) -> int:
    """1 for residue, 0 for other text, -1 for a mention of residue."""
    return look(segment)[0]


# ---------------------------------------------------------------------------------------------------------------
# Features


def encode(text: str) -> bytes:
    """UTF-8 with every digit as 0, CR as LF and no-break spaces as spaces."""
    return text.replace("\xa0", " ").encode("utf-8", "replace").translate(_DIGITS)


def cut(buf: np.ndarray) -> np.ndarray:
    """Starts of segments in a buffer: after line ends and sentence ends."""
    ends = buf == 10
    stop = (buf == 46) | (buf == 33) | (buf == 63)
    ends[:-1] |= stop[:-1] & (buf[1:] == 32)
    return np.r_[0, np.flatnonzero(ends[:-1]) + 1]


def spread(b: bytes, like: bytes | None = None) -> bytes:
    """``b`` with every segment above MAX_SEGMENT bytes as lines of at most that length that share OVERLAP bytes with the
    next; ``like`` is a text of equal length whose segments count instead."""
    starts = cut(np.frombuffer(like or b, np.uint8))
    ends = np.r_[starts[1:], len(b)]
    long = np.flatnonzero(ends - starts > MAX_SEGMENT)
    if not len(long):
        return b
    out, at = [], 0
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        out.append(b[at:s])
        step = MAX_SEGMENT - OVERLAP
        out.append(b"\n".join(b[k : k + MAX_SEGMENT] if k + MAX_SEGMENT < e else b[k:e] for k in range(s, e - OVERLAP, step)))
        at = e
    return b"".join([*out, b[at:]])


def gram_index(buf: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each family of n-grams: offset of its weights, hash at every position, and whether the n-gram stays in its segment."""
    n = len(buf)
    left = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n)
    for f, (size, lower) in enumerate(GRAMS):
        b = (_LOWER[buf] if lower else buf).astype(np.uint32)
        m = max(0, n - size + 1)
        h = np.zeros(m, np.uint32)
        for j in range(size):
            h *= np.uint32(0x01000193)
            h ^= b[j : j + m]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - BITS)
        yield f << BITS, h, left[:m] >= size


def length_class(buf_len: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(buf_len, 1)).astype(np.int64), LENGTHS - 1)


@dataclass(frozen=True)
class Model:
    """``weights`` holds the n-gram families, then length classes and the title flag."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def segment_scores(self, buf: np.ndarray, starts: np.ndarray, title: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), self.bias, np.float64)
        n = len(buf)
        for at, h, ok in gram_index(buf, starts):
            w = np.zeros(n, np.float32)
            w[: len(h)] = self.weights[at : at + (1 << BITS)][h] * ok
            out += np.add.reduceat(w, starts) if n else 0
        extra = self.weights[len(GRAMS) << BITS :]
        size = np.diff(np.r_[starts, n])
        seen = np.add.reduceat(buf > 32, starts, dtype=np.int64) > 0 if n else np.zeros(len(starts), bool)
        return np.where(seen, out + extra[length_class(size)] + title * extra[LENGTHS], -np.inf)

    def score_texts(self, texts: Sequence[str | None]) -> np.ndarray:
        """The highest segment score of each text; -inf for null and blank ones. Whole texts count."""
        out = np.full(len(texts), -np.inf)
        held, size = [], 0
        for i, t in enumerate(texts):
            if t is None or not t.strip():
                continue
            b = spread(encode(t))
            for k in range(0, len(b), CHUNK):  # a very long text in pieces that overlap by a segment
                piece = b[max(0, k - MAX_SEGMENT) : k + CHUNK]
                held.append((i, k == 0, piece))
                size += len(piece) + 1
                if size >= CHUNK:
                    self._score(held, out)
                    held, size = [], 0
        self._score(held, out)
        return out

    def _score(self, held: list[tuple[int, bool, bytes]], out: np.ndarray) -> None:
        if not held:
            return
        buf = np.frombuffer(b"\n".join(b for _, _, b in held) + b"\n", np.uint8)
        first = np.cumsum([0, *[len(b) + 1 for _, _, b in held[:-1]]])
        starts = cut(buf)
        owner = np.searchsorted(first, starts, side="right") - 1
        title = np.isin(starts, first[[k for k, (_, head, _) in enumerate(held) if head]])
        best = np.maximum.reduceat(self.segment_scores(buf, starts, title), np.searchsorted(owner, np.arange(len(held))))
        np.maximum.at(out, [i for i, _, _ in held], best)


# ---------------------------------------------------------------------------------------------------------------
# Training


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and the strength of the penalty."""

    documents: int = 20_000  #: about so many documents are labelled, chosen by a hash of their id
    positive: int = 6_000  #: distinct segments kept of each kind
    mention: int = 3_000
    frequent: int = 5_000  #: the most frequent other segments
    other: int = 5_000  #: other segments by hash
    near: int = 5_000  #: other segments, by hash, that hold a string of the patterns
    seeds: int = 12  #: examples made from each pattern
    l2: float = 3e-5
    rounds: int = 60
    seed: int = 0


def labelled_segments(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, int, bool, int]]:
    """(host, segment, title, near miss, label) of texts; a line of filler labels all its sentences, a short error page all its lines."""
    split = re.compile(r"(?<=[.!?]) ")
    for host, text in rows:
        lines = [x for x in text.replace("\r", "\n").replace("\xa0", " ").split("\n") if x.strip()]
        page = len(text) < 400 and lines and weak_label(lines[0][:200]) == 1 and _ERROR.search(lines[0][:200])
        for i, line in enumerate(lines):
            filler = _LOREM.search(line) and not _MENTION.search(line)
            for j, s in enumerate(split.split(line)):
                for k in range(0, max(1, len(s) - OVERLAP), MAX_SEGMENT - OVERLAP) if len(s) > MAX_SEGMENT else (0,):
                    x = s[k : k + MAX_SEGMENT]
                    label, near = look(x)
                    if label == 0 and (filler or page):
                        label = 1
                    yield host, re.sub(r"\d", "0", x), int(i == 0 and j == 0 and k == 0), near and label == 0, label


def training_rows(documents: DataFrame, doc_id: str, text: str, host: str, cfg: Training) -> pd.DataFrame:
    """Distinct labelled segments (segment, title, label share of residue, kind), at most the sum of cfg's bounds."""
    d = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text")).where("text is not null")
    n = d.select("id").count()
    share = min(1.0, cfg.documents / max(1, n))
    bucket = F.pmod(F.xxhash64("id", F.lit(cfg.seed)), F.lit(1_000_000)) < int(share * 1_000_000)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple, list[int]] = {}
            for _, s, title, near, y in labelled_segments(zip(b["host"], b["text"])):
                c = seen.setdefault((s, title), [0, 0, 0, 0])
                c[0 if y == 0 else 1 if y == 1 else 2] += 1
                c[3] |= near
            yield pd.DataFrame([(s, t, *c) for (s, t), c in seen.items()], columns=["segment", "title", "other", "residue", "mention", "near"])

    seg = (
        d.where(bucket)
        .repartition(documents.sparkSession.sparkContext.defaultParallelism)  # bounded by cfg.documents
        .mapInPandas(label, "segment string, title int, other long, residue long, mention long, near int")
        .groupBy("segment", "title")
        .agg(*[F.sum(c).alias(c) for c in ("other", "residue", "mention")], F.max("near").alias("near"))
        .withColumn("kind", F.when(F.col("mention") > 0, 2).when(F.col("residue") > F.col("other"), 1).otherwise(0))
        .withColumn("h", F.xxhash64("segment", "title"))
    )
    seg = materialise(seg)
    often = F.col("other") + F.col("residue") + F.col("mention")
    parts = [seg.where(F.col("kind") == k).orderBy(F.desc(often), "h").limit(m).toPandas() for k, m in ((0, cfg.frequent), (1, cfg.positive), (2, cfg.mention))]
    parts += [seg.where(c).orderBy("h").limit(m).toPandas() for c, m in (("kind = 0 and near = 1", cfg.near), ("kind = 0", cfg.other))]
    if cfg.seeds and len(parts[-1]):  # examples need other text beside them
        parts.append(seeds(parts[-1]["segment"].tolist(), cfg.seeds, cfg.seed))
    return pd.concat(parts, ignore_index=True)


def fit(rows: pd.DataFrame, cfg: Training | None = None) -> Model:
    """L2-regularised logistic regression by L-BFGS; rows of each kind weigh alike in total, mentions half as much, frequent ones more."""
    cfg = cfg or Training()
    size = (len(GRAMS) << BITS) + EXTRA
    if not len(rows) or not (rows["kind"] == 1).any():
        return Model(np.zeros(size, np.float32), BIAS)
    texts = [encode(s) for s in rows["segment"]]
    cols, seg_ids = [], []
    base = 0
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        starts = np.cumsum([0, *[len(b) + 1 for b in part[:-1]]])
        owner = np.repeat(np.arange(len(part)), np.diff(np.r_[starts, len(buf)]))
        for at, h, ok in gram_index(buf, starts):
            cols.append((h[ok] + np.uint32(at)).astype(np.int32))
            seg_ids.append((owner[: len(h)][ok] + base).astype(np.int32))
        base += len(part)
    # lengths and places of made segments say nothing, and those of real ones only where both kinds occur
    real = np.flatnonzero(rows["h"].to_numpy() != 0)
    real = real if (rows["kind"].to_numpy()[real] == 1).any() else real[:0]
    titles = real[rows["title"].to_numpy()[real] == 1]
    lens = np.array([len(texts[i]) + 1 for i in real], np.int64)
    cols += [((len(GRAMS) << BITS) + length_class(lens)).astype(np.int32), np.full(len(titles), (len(GRAMS) << BITS) + LENGTHS, np.int32)]
    seg_ids += [real.astype(np.int32), titles.astype(np.int32)]
    col, seg = np.concatenate(cols), np.concatenate(seg_ids)
    used, col = np.unique(col, return_inverse=True)
    y = (rows["kind"].to_numpy() == 1).astype(float)
    kind = rows["kind"].to_numpy()
    c = np.where(rows["h"] == 0, SEED_WEIGHT, np.log1p(rows[["other", "residue", "mention"]].sum(axis=1).to_numpy()))
    for k, w in ((0, 1.0), (1, 1.0), (2, 0.5)):
        c[kind == k] *= w / max(c[kind == k].sum(), 1e-300)
    c = c / c.sum()
    m, n = len(y), len(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(seg, weights=x[col], minlength=m) + BIAS
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        f = float((c * (np.logaddexp(0, z) - y * z)).sum() + cfg.l2 / 2 * (x @ x))
        r = c * (p - y)
        return f, np.bincount(col, weights=r[seg], minlength=n) + cfg.l2 * x

    x = lbfgs(loss, np.zeros(n), cfg.rounds)
    w = np.zeros(size, np.float32)
    w[used] = x
    return Model(w, BIAS)


def lbfgs(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, t, rho in reversed(past):
            a = rho * (s @ d)
            alphas.append(a)
            d -= a * t
        if past:
            s, t, _ = past[-1]
            d *= (s @ t) / (t @ t)
        for (s, t, rho), a in zip(past, reversed(alphas)):
            d += (a - rho * (t @ d)) * s
        step, slope = (1.0 if past else 1.0 / max(1e-12, np.abs(g).sum())), g @ d
        for _ in range(20):
            x2 = x - step * d
            f2, g2 = loss(x2)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (x2 - x) @ (g2 - g) > 1e-12:
            past = [*past[-memory + 1 :], (x2 - x, g2 - g, 1.0 / ((x2 - x) @ (g2 - g)))]
        done = abs(f - f2) < 1e-7 * max(1.0, abs(f))
        x, f, g = x2, f2, g2
        if done:
            break
    return x


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", cfg: Training | None = None) -> Model:
    """A model from weak labels of a bounded sample and of the patterns' own examples (see ``Training``); the same table gives the same model."""
    cfg = cfg or Training()
    return fit(training_rows(documents, doc_id, text, host, cfg), cfg)


def is_mention_only(text: str, model: Model) -> bool:
    """Exact check of a candidate: whether every segment that scores as residue only mentions, explains or quotes it."""
    code = encode(text)
    buf = np.frombuffer(spread(code) + b"\n", np.uint8)
    starts = cut(buf)
    raw = spread(text.replace("\r", "\n").replace("\xa0", " ").encode("utf-8", "replace"), code) + b"\n"
    ends = np.r_[starts[1:], len(buf)]
    hot = np.flatnonzero(model.segment_scores(buf, starts, starts == 0) > model.threshold)
    return len(hot) > 0 and all(_MENTION.search(raw[starts[k] : ends[k]].decode("utf-8", "ignore")) for k in hot)


def verdicts(texts: Sequence[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores of texts, and whether each is residue: it scores above the threshold and does not only mention such things."""
    s = model.score_texts(texts)
    bad = s > model.threshold
    for i in np.flatnonzero(bad):
        bad[i] = not is_mention_only(texts[i], model)
    return s, bad


def score_residue(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, score, is_residue) for every document, one pass without a shuffle.

    Null and blank texts score null and are no residue. A text is residue when a segment scores above the model's
    threshold and the exact check (``MENTIONS``) finds not only mentions. Texts of any length are scored whole, in pieces that
    overlap. Repeated or null ids give a row each; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 3 MB, whatever the input
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            s, bad = verdicts(b[text].tolist(), m)
            yield pd.DataFrame({doc_id: b[doc_id], "score": np.where(np.isfinite(s), s, np.nan), "is_residue": bad})

    return documents.select(doc_id, text).mapInPandas(run, f"{doc_id} {kind}, score double, is_residue boolean")


def host_validation(documents: DataFrame, folds: int = 5, doc_id: str = "doc_id", text: str = "text", host: str = "source", cfg: Training | None = None) -> DataFrame:
    """(fold, n, weak, found, both, precision, recall) of documents of hosts whose texts the model of that fold never saw,
    judged by the rule of ``score_residue`` against weak labels. Spellings of a host are one; a share of nothing is null."""
    d = documents.withColumn("__fold", F.pmod(F.xxhash64(F.coalesce(canon_source_name(host), F.lit(""))), F.lit(folds)))
    out = []
    for k in range(folds):
        shared = documents.sparkSession.sparkContext.broadcast(train(d.where(F.col("__fold") != k), doc_id, text, host, cfg))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts = b[text].tolist()
                weak = [t is not None and any(y == 1 for *_, y in labelled_segments([("", t)])) for t in texts]
                yield pd.DataFrame({"p": verdicts(texts, shared.value)[1], "y": weak})

        r = d.where(F.col("__fold") == k).select(text).mapInPandas(run, "p boolean, y boolean")
        n = lambda c: F.count(F.when(c, 1))
        r = r.agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n"), n(F.col("y")).alias("weak"), n(F.col("p")).alias("found"), n(F.col("p") & F.col("y")).alias("both"))
        out.append(r.withColumn("precision", F.col("both") / F.nullif("found", F.lit(0))).withColumn("recall", F.col("both") / F.nullif("weak", F.lit(0))))
    r = out[0]
    for o in out[1:]:
        r = r.unionByName(o)
    return r
