"""PII: detection through offset-preserving deobfuscation.

Two transducers rewrite a text: the first turns homoglyphs, full-width forms and
the decimal digits of all scripts into ASCII and drops zero-width characters,
the second reads chains of names and number words and turns spelled digits into
digits and at/dot disguises into @ and dots. Each keeps a map of what came from
where. Detection then runs on the
rewritten text, and its spans are mapped back to code points of the source.
What the plain text shows by itself (the base spans) is always kept; a mapped
span is added where it does not overlap a base span of its kind.

Kinds and base patterns are those of KINDS. Whole texts are read, however long,
in time proportional to their length: runs of digits, names, chains and number
words are entered at their start only and never read back, and a phone number's
run is read back once. Nulls: a null text counts as empty; a null id is returned as null.
Repeated rows give a row each. An empty table gives an empty result. Extra
columns are left aside by find_pii and kept by redact_documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

Span = tuple[str, int, int]

# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ε": "e", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _glyph(ch: str) -> str | None:
    """What the first transducer emits for a character; None: the character itself."""
    if ch in HOMOGLYPHS:
        return HOMOGLYPHS[ch]
    if ch in ZERO_WIDTH:
        return ""
    if "\uff01" <= ch <= "\uff5e":  # full-width forms keep the distance of their ASCII partners
        return chr(ord(ch) - 0xFEE0)
    if ch > "\x7f" and (digit := unicodedata.decimal(ch, None)) is not None:
        return str(digit)
    return None


#: What _glyph may change, and all beyond the basic plane, where _glyph decides: one range costs less than one a script.
_GLYPHS = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + ZERO_WIDTH + "！-～" + "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.decimal(c, None) is not None) + "\U00010000-\U0010ffff]")
#: A disguised or plain separator of an address: bracketed, a word with blanks around, or itself.
_BRACKETED = r"\s*+[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]\s*+"
_SEPARATOR = rf"(?:{_BRACKETED}|\s++(?:at|dot)\s++|[.@])"
_ATOM = r"[A-Za-z0-9_%+-]++"
#: Names and the separators between them, as far as they go. A chain starts where a name starts, and all parts are possessive: one pass.
_CHAIN = re.compile(rf"(?<![A-Za-z0-9_%+-]){_ATOM}(?:{_SEPARATOR}{_ATOM})++", re.IGNORECASE)
_LINK = re.compile(rf"({_SEPARATOR})({_ATOM})", re.IGNORECASE)
_NAME = re.compile(_ATOM)
_PART = re.compile(r"[A-Za-z0-9-]++")
#: Every disguised address holds one of these, whatever else the text holds.
_DISGUISED = re.compile(r"[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]|\sdot\s", re.IGNORECASE)
_NUMBER_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)(?![A-Za-z])"
_DIGIT_WORDS = re.compile(rf"(?<![A-Za-z])(?:plus[\s,-]++)?{_NUMBER_WORD}(?:[\s,.-]++(?:{_NUMBER_WORD}|(?:dot|point)(?![A-Za-z])|[0-9]++(?![A-Za-z])))++", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+|[0-9]+|[.]")


class OffsetMap:
    """Which source span a span of the rewritten text came from, kept as pieces."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        self.pieces, out, at, pos = [], [], 0, 0  # (output start, source start, source end, copied)
        for start, end, emitted in edits:
            if start > pos:
                self.pieces.append((at, pos, start, True))
                out.append(source[pos:start])
                at += start - pos
            self.pieces.append((at, start, end, False))
            out.append(emitted)
            at += len(emitted)
            pos = end
        self.pieces.append((at, pos, len(source), True))
        out.append(source[pos:])
        self.text = "".join(out)
        self.starts = [p[0] for p in self.pieces]

    def source_span(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span and whether an edit is part of it."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        at, src, _, copied = self.pieces[first]
        low = src + (start - at if copied else 0)
        at, src, stop, copied = self.pieces[last]
        high = src + (end - at) if copied else stop
        return low, high, any(not p[3] for p in self.pieces[first : last + 1])


def glyph_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _GLYPHS.finditer(text):
        emitted = _glyph(m[0])
        if emitted is not None:
            edits.append((m.start(), m.end(), emitted))
    return edits


def _spoken(run: str) -> str:
    """Digits of a run of number words: the machine emits a digit a word, a dot for dot/point, a plus for plus."""
    out = []
    for word in _WORD.findall(run.lower()):
        if word in SPELLED:
            out.append(SPELLED[word])
        elif word in ("dot", "point", "."):
            out.append(".")
        elif word == "plus":
            out.append("+")
        elif word.isdigit():
            out.append(word)
    return "".join(out)


def _kind(separator: str) -> str:
    """The symbol that the machine reads for a separator: @ and . plain, A and D bracketed, a and d as words."""
    if separator in ".@":
        return separator
    body = separator.strip().lower()
    at = "at" in body or "@" in body
    return ("A" if at else "D") if body[0] in "[({<" else ("a" if at else "d")


def chain_edits(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Disguised separators of the addresses in a chain of names.

    At each at, from left to right: the names before it that no address holds
    yet, as far as dots of any kind join them, are the local part; the names
    after it, likewise, are the domain, which ends inside a name where a
    character is none of a domain. It is an address if the domain has a dot, and
    a disguised one if the at is bracketed or a dot of the domain is disguised.
    Every name is looked at twice at most.
    """
    edge = _NAME.match(text, start, end).end()
    names, between = [(start, edge)], []
    for m in _LINK.finditer(text, edge, end):
        names.append(m.span(2))
        between.append((m.start(1), m.end(1), _kind(m[1])))
    edits, taken = [], 0
    for i, (_, _, at) in enumerate(between):
        if at in ".Dd" or i < taken:
            continue
        first, last = i, i + 1
        while first > taken and between[first - 1][2] in ".Dd":
            first -= 1
        while True:
            part = _PART.match(text, *names[last])
            if not part:
                last -= 1
                break
            if part.end() < names[last][1] or last == len(between) or between[last][2] not in ".Dd":
                break
            last += 1
        dots = [k for _, _, k in between[i + 1 : last]]
        if not dots:
            continue
        if at == "A" or not {*dots} <= {"."}:
            edits += [(s, e, "@" if k in "Aa" else ".") for s, e, k in between[first:last] if k not in ".@"]
            taken = last + 1
        elif at == "@":  # an address as it stands
            taken = last + 1
    return edits


def word_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if _DISGUISED.search(text):
        for m in _CHAIN.finditer(text):
            edits += chain_edits(text, m.start(), m.end())
    for m in _DIGIT_WORDS.finditer(text):
        edits.append((m.start(), m.end(), _spoken(m[0])))
    edits.sort()
    kept, pos = [], 0
    for e in edits:
        if e[0] >= pos:
            kept.append(e)
            pos = e[1]
    return kept


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans the plain text shows, by kind as in KINDS, then start."""
    found: list[Span] = []
    if "@" in text:
        free, at = 0, text.find("@")
        while at >= 0:
            low = at
            while low > free and not _NOT_LOCAL.match(text[low - 1]):
                low -= 1
            m = _DOMAIN.match(text, at + 1) if low < at else None
            if m:
                found.append(("email", low, m.end()))
                free = m.end()
            else:
                free = at + 1
            at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans found only after rewriting, in code points of `text`."""
    edits = glyph_edits(text)
    first = OffsetMap(text, edits) if edits else None
    middle = first.text if first else text
    edits = word_edits(middle)
    if not edits and not first:
        return []
    second = OffsetMap(middle, edits)
    out: list[Span] = []
    ends = {kind: [e for k, _, e in base if k == kind] for kind in KINDS}
    starts = {kind: [s for k, s, _ in base if k == kind] for kind in KINDS}
    for kind, start, end in base_spans(second.text):
        low, high, changed = second.source_span(start, end)
        if first:
            low, high, also = first.source_span(low, high)
            changed |= also
        if changed and bisect_right(ends[kind], low) == bisect_left(starts[kind], high):  # no base span of its kind overlaps
            out.append((kind, low, high))
    return out


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base and added spans, by kind as in KINDS, then start."""
    base = base_spans(text) if base is None else base
    more = added_spans(text, base)
    return sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else base


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, pos, reach = [], 0, 0
    for start, end, kind in sorted((s, e, k) for k, s, e in all_spans(text)):
        if start >= reach:
            out += [text[pos:start], f"[{kind.upper()}]"]
        reach = max(reach, end)
        pos = reach
    return "".join([*out, text[pos:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row per document: doc_id, counts of base spans by kind, base_sha256, spans (all), n_added."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                base = base_spans(text)
                every = all_spans(text, base)
                kinds = [s[0] for s in base]
                for k in KINDS:
                    rows[f"n_{k}"].append(kinds.count(k))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(every))
                rows["n_added"].append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()]], ["doc_id", *rows])

    schema = f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the spans of `text` replaced by their kind; other columns, if any, as they are."""
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((redact(x.as_py()) for x in batch.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
