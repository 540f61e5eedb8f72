"""Personal data, plain and disguised, with offsets into the source text.

Plain identifiers are found on the text itself. Then transducers normalise disguises one after another - look-alike
characters, spelled digits, dots in numbers, and at/dot words - each keeping its edits, the same detectors run on the result, and a
span found there is mapped back through the edits to source characters. A found span that lies within a plain one of its
kind is not added; a wider one is added beside it, so plain spans always stay as they are. Every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .runtime import blocks, ship
from .top_names import is_top_level

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Numbers joined by single dots; tried only where a number begins, and without backtracking.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Every match has one @: what stands before it is taken back to the last match, so the scan is linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done_here = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = done_here = m.end()
        at = text.find("@", done_here)
    return out


def ips(text: str) -> list[Span]:
    """Four dotted numbers; in a longer row of numbers each four in turn."""
    out = []
    for run in _DOTTED.finditer(text):
        at, row = run.start(), []
        for part in run.group().split("."):
            row.append((at, at + len(part)))
            if len(row) == 4:
                values = [text[a:b].lstrip("0") for a, b in row]
                if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
                    out.append((row[0][0], row[3][1]))
                row = []
            at += len(part) + 1
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    digits = bool(_DIGIT.search(text))
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits and "." in text else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


class Edited:
    """A text after edits (start, end, replacement), in order and apart, that maps its characters back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.edits, last, length = [], [], edits, 0, 0
        for a, b, new in edits:
            parts += (text[last:a], new)
            self.at.append(length + a - last)
            length += a - last + len(new)
            last = b
        self.text = "".join([*parts, text[last:]])

    def source(self, start: int, end: int) -> Span:
        return self._of(start)[0], self._of(end - 1)[1]

    def _of(self, p: int) -> Span:
        k = bisect_right(self.at, p) - 1
        if k < 0:
            return p, p + 1
        a, b, new = self.edits[k]
        if p < self.at[k] + len(new):
            return a, b
        x = p - self.at[k] - len(new) + b
        return x, x + 1


#: Letters of other scripts that look like ASCII ones (fixed values).
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХҮаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονı",
    "ABESIJKMHOPCTXYaesijopcyxhdqwABEZHIKMNOPTYXovi",
    strict=True,
))
#: Dots, at signs, plus signs and dashes beyond ASCII, and characters without width (fixed values).
SIGNS = {"。": ".", "․": ".", "‧": ".", "·": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "", " ": " ", " ": " ", " ": " "}


def plain_character(c: str) -> str | None:
    """What an ASCII reader takes ``c`` for, or None if it is no disguise."""
    if c.isascii():
        return None
    if c in LOOK_ALIKES or c in SIGNS:
        return LOOK_ALIKES.get(c, SIGNS.get(c))
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    if unicodedata.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>", "<font>", "<small>", "<circle>"):
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isascii() else None
    return None


_BEYOND = re.compile(r"[^\x00-\x7f]")
_memo: dict[str, str | None] = {}


def character_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    out = []
    for m in _BEYOND.finditer(text):
        c = m.group()
        if c not in _memo:
            _memo[c] = plain_character(c)
        if _memo[c] is not None:
            out.append((m.start(), m.end(), _memo[c]))
    return out


#: Digit words (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT = rf"(?:\b(?:{_WORD})\b|[0-9])"
#: Spelled digits, and digits among them, with blanks or hyphens between; a spelled plus may lead, spelled dots may part them.
_SPELLED = re.compile(rf"(?:\+ ?|\bplus )?{_UNIT}(?:(?:[ ,-]{{1,2}}|(?: ?\(?\bdot\b\)? ?| ?\bpoint\b ?))?{_UNIT})+", re.IGNORECASE)
_A_WORD = re.compile(rf"\b(?:{_WORD}|plus|dot|point)\b", re.IGNORECASE)
#: Fewer spelled digits in a row are prose.
MIN_SPELLED = 3


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if sum(low.count(w) > 0 for w in DIGIT_WORDS) < 1:
        return []
    out = []
    for m in _SPELLED.finditer(text):
        words = [w for w in _A_WORD.finditer(text, m.start(), m.end())]
        if sum(w.group().lower() in DIGIT_WORDS for w in words) < MIN_SPELLED:
            continue
        signs = {"plus": "+", "dot": ".", "point": "."}
        tokens = [(t.start(), t.end(), t.group()) for t in re.finditer(rf"{_UNIT}|\+|\bplus\b|\bdot\b|\bpoint\b", m.group(), re.IGNORECASE)]
        for k, (a, b, t) in enumerate(tokens):
            new = DIGIT_WORDS.get(t.lower(), signs.get(t.lower(), t))
            end = tokens[k + 1][0] if k + 1 < len(tokens) else b  # what parts the tokens goes
            if text[m.start() + a : m.start() + end] != new:
                out.append((m.start() + a, m.start() + end, new))
    return out


#: Words for @ and for a dot in disguised addresses, and top-level names that tell a bare "at" from prose in any case (fixed values).
AT_WORDS, DOT_WORDS = "at|arroba|arobase|ät", "dot|punkt|point|punto"
TOP_NAMES = "com|org|net|edu|gov|info|io|co|eu|de|fr|es|uk|us|example"
_AT = rf"(?: ?[\[({{<] ?(?:{AT_WORDS}|@) ?[\])}}>] ?| @ ?|@ | (?:{AT_WORDS}) )"
_DOT = rf"(?: ?[\[({{<] ?(?:{DOT_WORDS}|\.) ?[\])}}>] ?| (?:{DOT_WORDS}) )"
_LABEL = r"[A-Za-z0-9-]+"
_ADDRESS = re.compile(rf"(?P<at>{_AT}|@){_LABEL}(?:(?:{_DOT}|\.){_LABEL})+", re.IGNORECASE)
_COMMON = frozenset(TOP_NAMES.split("|"))
_LAST_LOCAL = re.compile(r"[A-Za-z0-9%+_.-]$")
_DOT_AT_END = re.compile(rf"(?:{_DOT})$", re.IGNORECASE)
_DOT_PART = re.compile(_DOT, re.IGNORECASE)
#: Longest disguised dot.
_DOT_LENGTH = 12
_LABEL_BEFORE = _LOCAL - {"."}


def _local_dots(text: str, least: int, end: int) -> list[tuple[int, int, str]]:
    """Edits of the disguised dots in the local part that ends at ``end`` and begins at ``least`` or later."""
    out: list[tuple[int, int, str]] = []
    at = end
    while True:
        while at > least and text[at - 1] in _LABEL_BEFORE:
            at -= 1
        low = max(least, at - _DOT_LENGTH)
        m = _DOT_AT_END.search(text[low:at])
        if not m or low + m.start() == least or text[low + m.start() - 1] not in _LABEL_BEFORE:
            return out[::-1]
        out.append((low + m.start(), at, "."))
        at = low + m.start()


def _known_top(domain: str) -> bool:
    """Whether an undisguised domain ends in a top-level name. "at home.It was" is prose: only common names may be capitalised."""
    top = domain.rsplit(".", 1)[1]
    return top.lower() in _COMMON or (is_top_level(top) and not top.istitle())


def address_edits(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    words = AT_WORDS.split("|")
    if "@" not in text and not any(f"{o}{w}" in low for w in words for o in (" ", "(", "[", "{", "<")):
        return []
    out, done = [], 0
    for m in _ADDRESS.finditer(text):
        a, b = m.span("at")
        if a <= done or not _LAST_LOCAL.search(text[a - 1 : a]):
            continue
        domain = text[b : m.end()]
        disguised = list(_DOT_PART.finditer(domain))
        bare = text[a:b].strip().isalpha()
        if bare and not disguised and not _known_top(domain):
            continue
        edits = [(a, b, "@")] if text[a:b] != "@" else []
        edits += [(b + d.start(), b + d.end(), ".") for d in disguised]
        if edits:
            edits = _local_dots(text, done, a) + edits
        out += edits
        done = m.end()
    return out


_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT})(?=[0-9])", re.IGNORECASE)


def number_edits(text: str) -> list[tuple[int, int, str]]:
    """Disguised dots between digits."""
    return [(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text)]


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and spans the transducers add, by kind; code points, end exclusive."""
    base = detect(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    stages: list[Edited] = []
    now = text
    for edits_of in (character_edits, digit_edits, number_edits, address_edits):
        if edits := edits_of(now):
            stages.append(Edited(now, edits))
            now = stages[-1].text
    if stages:
        for kind, spans in detect(now).items():
            plain, last = base[kind], 0
            for span in spans:
                a, b = span
                for stage in reversed(stages):
                    a, b = stage.source(a, b)
                k = bisect_right(plain, (a, len(text))) - 1
                within = b <= last or (k >= 0 and b <= plain[k][1])
                if text[a:b] != now[span[0] : span[1]] and not within:
                    added[kind].append((a, b))
                    last = b
    return base, added


def joined(spans: dict[str, list[Span]]) -> str:
    rows = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in spans[kind])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs`` (doc_id, text), as in SCHEMA.

    The counts and ``spans`` are of all spans; ``base_sha256`` is of the plain ones alone. A null text counts as empty
    and has no spans; repeated rows are read each; an empty table gives no rows; other columns are ignored. Texts
    are read whole. There is no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts, sums, all_spans = [[] for _ in KINDS], [], []
            for text in pc.fill_null(block.column("text"), "").to_pylist():
                base, added = find(text)
                both = {k: base[k] + added[k] for k in KINDS}
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(len(both[k]))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(both))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums), pa.array(all_spans)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
