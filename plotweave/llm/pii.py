"""Personal data, plain and disguised, with offsets into the source.

Plain identifiers are found by fixed patterns on the text as it is. Then transducers rewrite the text - look-alike
characters, spelled digits, at/dot disguises - and keep for every character where it came from; after each of them the same
patterns run on the rewritten text, and what they find over rewritten characters is mapped back to source spans and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.domain_endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, with look-behinds and possessive repeats where they change nothing but the time on long runs.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like ASCII ones.
CYRILLIC = {"а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S"}
GREEK = {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-"}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
RUN = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]+)?(?:{_WORD}|[0-9]+)(?:[\s,.()-]{{1,3}}(?:{_WORD}|[0-9]+))+(?!\w)")
ONE = re.compile(rf"(?i)plus[\s-]+|{_WORD}|[0-9]|[\s,.()-]+")
_AT = r"(?:\s{0,2}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,2}|\s{1,2}at\s{1,2}|\s{1,2}@\s{1,2}|@)"
_DOT = r"(?:\s{0,2}[\[({<]\s?(?:dot|\.)\s?[\])}>]\s{0,2}|\s{1,2}dot\s{1,2}|\.)"
_LOCAL = r"[A-Za-z0-9_%+-]++"
MAIL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{_DOT}{_LOCAL}){{0,4}}{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+")
ADDRESS = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
#: What shows that a text may hold an at/dot disguise.
HINT = re.compile(r"[Dd][Oo][Tt]\b|[\[({<]\s?(?:[Aa][Tt]|[.@])\s?[\])}>]|\s@|@\s")
AT, DOT = re.compile(rf"(?i){_AT}"), re.compile(rf"(?i){_DOT}")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the longest local part to the left, not before the last match's end, and the domain to the right."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if len(m[0]) >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and passes_luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class Tape:
    """A rewritten text; source[i] is the source span of its character i, changed[i] says if it was rewritten."""

    def __init__(self, text: str):
        self.text, self.source, self.changed = text, [(i, i + 1) for i in range(len(text))], bytearray(len(text))

    def replaced(self, edits: list[tuple[int, int, str]]) -> None:
        """Makes the edits (start, end, new), in order and apart; each new character comes from the whole of start..end."""
        parts, source, changed, at = [], [], bytearray(), 0
        for a, b, new in edits:
            span = (self.source[a][0], self.source[b - 1][1])
            parts += [self.text[at:a], new]
            source += self.source[at:a] + [span] * len(new)
            changed += self.changed[at:a] + b"\x01" * len(new)
            at = b
        parts.append(self.text[at:])
        self.text, self.source, self.changed = "".join(parts), source + self.source[at:], changed + self.changed[at:]


@cache
def plain_character(c: str) -> str | None:
    """The ASCII character that c stands for, "" for invisible ones, None if it is itself."""
    if c in INVISIBLE:
        return ""
    if look := CYRILLIC.get(c) or GREEK.get(c) or LATIN.get(c):
        return look
    if unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    if unicodedata.category(c) == "Zs":
        return " "
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and k.isascii() and k != c else None


def homoglyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = {c: p for c in set(text) if not c.isascii() and (p := plain_character(c)) is not None}
    if not odd:
        return []
    return [(m.start(), m.end(), odd[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)]


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits in runs become digits, however few; what parts them becomes at most one space or full stop."""
    out = []
    lower = text.lower()
    if not any(word in lower for word in SPELLED):
        return out
    for m in RUN.finditer(text):
        pieces = list(ONE.finditer(text, m.start(), m.end()))
        if not any(p[0].lower() in SPELLED for p in pieces):
            continue
        for p in pieces:
            word = p[0].lower()
            if word in SPELLED:
                out.append((*p.span(), SPELLED[word]))
            elif word.startswith("plus"):
                out.append((*p.span(), "+"))
            elif not word.isdigit() and word not in " -.":
                out.append((*p.span(), " "))
    return out


def disguise_edits(text: str) -> list[tuple[int, int, str]]:
    """at/dot disguises inside what has the shape of an address. A bare `at` counts only before a disguised dot.

    After bare words only, the last label must be a top-level domain, or prose such as `met at the dot of noon` would count.
    """
    out = []
    if not HINT.search(text):
        return out
    for m in MAIL.finditer(text):
        at = [a for a in AT.finditer(text, *m.span()) if not text[a.start() : a.end()].startswith(".")][-1:]
        dots = [d for d in DOT.finditer(text, *m.span()) if d[0] != "."]
        later = [d for d in dots if d.start() > at[0].start()]
        if at[0][0].strip().lower() == "at":
            plain = all(d[0].strip().lower() in ("dot", ".") for d in dots)
            if not later or plain and text[later[-1].end() : m.end()].lower().rpartition(".")[2] not in ENDINGS:
                continue
        elif at[0][0] != "@" and at[0][0].strip() == "@" and not dots:
            continue
        out += [(*x.span(), new) for x, new in sorted([(d, ".") for d in dots] + [(a, "@") for a in at if a[0] != "@"], key=lambda e: e[0].start())]
    for m in ADDRESS.finditer(text):
        out += [(*d.span(), ".") for d in DOT.finditer(text, *m.span()) if d[0] != "."]
    out.sort()
    return [e for i, e in enumerate(out) if i == 0 or e[0] >= out[i - 1][1]]


def disguised(text: str) -> Iterator[Tape]:
    """The text after each rewriting that changes it, on one tape."""
    tape, now = None, text
    for find in (homoglyph_edits, digit_edits, disguise_edits):
        if edits := find(now):
            tape = tape or Tape(text)
            tape.replaced(edits)
            now = tape.text
            yield tape


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by kind, then start."""
    base = base_spans(text)
    found = set()
    for tape in disguised(text):
        for kind, a, b in base_spans(tape.text):
            span = (kind, tape.source[a][0], tape.source[b - 1][1])
            if any(tape.changed[a:b]) or span[2] - span[1] != b - a:
                found.add(span)
    if not found:
        return base, base
    added = []
    for kind in KINDS:
        mine = sorted([(a, -b, 0) for k, a, b in base if k == kind] + [(a, -b, 1) for k, a, b in found if k == kind])
        reach = -1
        for a, b, new in mine:
            if new and -b > reach:
                added.append((kind, a, -b))
            reach = max(reach, -b)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans, more = [[] for _ in KINDS], [], [], []
        for text in batch.column("text"):
            base, every = all_spans(text.as_py() or "")
            for i, k in enumerate(KINDS):
                counts[i].append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
            spans.append(written_spans(every))
            more.append(len(every) - len(base))
        yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_disguised"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and disguised), n_disguised per row.

    Offsets are code points of the whole text, ends exclusive. A null text is empty. Null and repeated ids stay as they
    are. An added span that is equal to or inside a base span of its kind is left out; one that reaches further is
    added, and the base span stays. Only the two named columns are read.
    """
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mine.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go together, by the kind of the first one."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{kind}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])
