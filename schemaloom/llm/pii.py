"""Personal data: base patterns, and identifiers behind disguises found by offset-preserving transducers.

The transducer rewrites homoglyphs, zero-width characters, letters that stand for digits between digits, digits spelled in
English, German, Spanish or French, character references and at/dot disguises, and keeps
for each character of the rewritten text the span it came from; the same patterns then run over the
rewritten text and their matches are mapped back. Only matches that touch a rewritten place are added, and numbers
that run on into other digits, so base spans stay as they are. One pass over the documents, no shuffle.

Edge cases: null and empty texts have no spans; digit runs of any length and texts without blanks take
linear time; overlapping spans of one kind are not added twice; repeated rows are treated one by one; a plain "at"
makes an address only after "mail:" or "<", with another disguise, or as "_at_";
``mask`` passes other columns through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.text import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, by kind and start."""
    return [(k, a, b) for k in KINDS for a, b in _FIND[k](text)]


# Characters that look like the one they stand for.
_LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝοναρ", "aeopcyxijshdqwovap")) | dict(zip("АВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTXIJSABEZHIKMNOPTYX"))
_LOOKALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_LOOKALIKE |= {chr(0x1D7CE + i): str(i % 10) for i in range(50)} | {chr(a + i): str(i) for a in (0x660, 0x6F0, 0x966) for i in range(10)}
_LOOKALIKE |= dict.fromkeys("․。｡", ".") | {"﹫": "@", "﹢": "+"} | dict.fromkeys("‐‑‒–—−﹣", "-") | dict.fromkeys("    　", " ")
_UNSEEN = "­​‌‍⁠﻿"
# Digits as they are spelled.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_SPELLED |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
# The marks of an address as words.
_AT, _DOT, _PLUS = ("at", "arroba", "arobase"), ("dot", "punkt", "punto", "point"), ("plus", "más")

# Characters written as references or escapes.
_WRITTEN = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}

_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_AT_WORD, _DOT_WORD, _PLUS_WORD = map("|".join, (_AT, _DOT, _PLUS))
_GLYPHS = re.escape("".join(sorted({*_LOOKALIKE, *_UNSEEN})))
_CODES = "|".join(map(re.escape, _WRITTEN))
_MARK = rf"{_AT_WORD}|{_DOT_WORD}|@|\."
_GAP = r"(?:[\s]*[,‐‑‒–—−-][\s]*|[\s]+)"  # between spelled digits
_RUN = r"(?<![\t-\r ])\s++"  # blanks from their first one on, so long runs of them take linear time
_HARD = rf"[(\[{{<][\s]*(?:{_MARK})[\s]*[)\]}}>]"
_REWRITE = re.compile(
    rf"(?P<glyph>[{_GLYPHS}])|(?P<code>{_CODES})|(?P<hard>(?:{_RUN})?(?P<what>{_HARD})\s*)|(?P<soft>(?:{_RUN}|[_-])(?P<which>{_AT_WORD}|{_DOT_WORD})(?:\s+|[_-]))"
    rf"|(?P<run>(?P<after>(?<=[0-9]){_GAP})?\b(?:(?:{_PLUS_WORD})\s+)?(?:{_WORD})(?:(?:{_GAP}|\s+(?:{_DOT_WORD})\s+)(?:{_WORD}))*\b(?P<before>{_GAP}(?=[0-9]))?)"
    r"|(?P<mixed>(?-i:(?<![A-Za-z0-9])[0-9OoIl]+(?:[ .-][0-9OoIl]+)*(?![A-Za-z0-9])))"
    r"|(?P<round>(?<=[0-9])[OoIl](?=[0-9 .-])|(?<=[0-9][ .-])[OoIl](?=[0-9]))",
    re.IGNORECASE,
)
_PIECE = re.compile(rf"(?P<digit>{_WORD})|(?P<dot>\s+(?:{_DOT_WORD})\s+)|(?P<plus>(?:{_PLUS_WORD})\s+)|(?P<gap>{_GAP})", re.IGNORECASE)
_GROUP = re.compile(r"[0-9OoIl]+")
_ONLY = re.compile(r"[\W_]+")
#: Texts that can hold a disguise at all: what starts each rule of _REWRITE, without lookbehind, since RE2 looks for it over
#: the whole batch. A plain at needs a dotted domain behind it, or a second disguise, which is found by its own rule.
_TRIGGER = (
    rf"[{_GLYPHS}]|(?i:{_CODES}|{_HARD}|[\s_-](?:{_DOT_WORD})[\s_-]|[\s_-](?:{_AT_WORD})(?:[\s]+|[_-])[a-z0-9-]+\.[a-z0-9-]"
    rf"|\b(?:{_WORD})(?:{_GAP}|[\s]+(?:{_DOT_WORD})[\s]+)(?:{_WORD})\b|[0-9]{_GAP}(?:{_WORD})\b|\b(?:{_WORD}){_GAP}[0-9]|\b(?:{_DOT_WORD})[\s]+(?:{_WORD})\b)"
    r"|[0-9][ .-]?[OoIl]+(?:[^A-Za-z]|$)|(?:^|[^A-Za-z])[OoIl]+[ .-]?[0-9]|[0-9][OoIl]+[0-9]"
).replace(r"\s", r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")  # blanks as Python has them
#: Before or around an address whose only disguise is a plain at.
_CUE = re.compile(r"(?:\b(?:e-?mail|mail|mailto|e-?post|correo|courriel)\s{0,3}[:=]\s{0,3}|<)$", re.IGNORECASE)


def _letters_for_digits(run: str, bold: bool) -> set[int]:
    """Where a run of digits and of letters that look like them holds letters for digits. A group of letters alone that
    a blank sets off can be a word ("I"), so it counts only for ``bold``."""
    if sum(c.isdigit() for c in run) < 2:
        return set()
    out: set[int] = set()
    for g in _GROUP.finditer(run):
        alone = g[0].isalpha() and " " in run[max(0, g.start() - 1) : g.start()] + run[g.end() : g.end() + 1]
        if bold or not alone:
            out |= {i for i in range(*g.span()) if run[i].isalpha()}
    return out


def rewrite(text: str, bold: bool = False) -> tuple[str, list[int], list[int], list[str]]:
    """The normalised text; for each of its characters the source span; '' or what was rewritten there.
    ``bold`` also reads what can be a plain word as a digit: a single spelled one beside digits, letters set off by blanks."""
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    how: list[str] = []

    def put(chars: str, a: int, b: int, kind: str) -> None:
        for c in chars:
            out.append(c)
            start.append(a)
            end.append(b)
            how.append(kind)

    def copy(a: int, b: int) -> None:
        out.extend(text[a:b])
        start.extend(range(a, b))
        end.extend(range(a + 1, b + 1))
        how.extend([""] * (b - a))
        if gone and a < b:
            how[-(b - a)] = "glyph"  # the first character after one that is left out

    done, gone = 0, False
    for m in _REWRITE.finditer(text):
        copy(done, m.start())
        gone = (gone and m.start() == done) or m[0] in _UNSEEN
        done = m.end()
        if m["glyph"]:
            put(_LOOKALIKE.get(m[0], ""), m.start(), m.end(), "glyph")
        elif m["code"]:
            put(_WRITTEN[m[0].lower()], m.start(), m.end(), "hard")
        elif m["round"]:
            put("0" if m[0] in "Oo" else "1", m.start(), m.end(), "digit")
        elif m["mixed"]:
            at, a = _letters_for_digits(m[0], bold), m.start()
            for i in sorted(at):
                copy(a, m.start() + i)
                a = m.start() + i + 1
                put("0" if text[a - 1] in "Oo" else "1", a - 1, a, "digit")
                gone = False
            copy(a, m.end())
            gone = False
        elif m["hard"]:
            put("@" if "@" in m["what"] or _ONLY.sub("", m["what"]).lower() in _AT else ".", m.start(), m.end(), "hard")
        elif m["soft"]:
            at = m["which"].lower() in _AT
            put("@" if at else ".", m.start(), m.end(), "hard" if m[0][0] == m[0][-1] == "_" else "softat" if at else "softdot")
        else:
            pieces = list(_PIECE.finditer(text, m.end("after") if m["after"] else m.start(), m.start("before") if m["before"] else m.end()))
            beside = m["after"] or m["before"] or text[max(0, m.start() - 6) : m.start()].lower().strip().endswith(_DOT)
            if sum(x["digit"] is not None for x in pieces) < 2 and not (bold and beside):
                copy(m.start(), m.end())
                gone = False
                continue
            if m["after"]:
                put(" ", m.start(), m.end("after"), "digit")
            for x in pieces:
                put(_SPELLED[x[0].casefold()] if x["digit"] else "." if x["dot"] else "+" if x["plus"] else "", x.start(), x.end(), "digit")
            if m["before"]:
                put(" ", m.start("before"), m.end(), "digit")
    copy(done, len(text))
    return "".join(out), start, end, how


class _Taken:
    """The characters of a text that some span covers."""

    def __init__(self, size: int, spans: list[Span]):
        self.covered = bytearray(size)
        for _, a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.covered[a:b] = b"\1" * (b - a)

    def free(self, a: int, b: int) -> bool:
        return self.covered.find(1, a, b) < 0


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only in the rewritten text, as spans of the source text."""
    taken = {k: _Taken(len(text), [x for x in base if x[0] == k]) for k in KINDS}
    found = []
    seen = None
    for bold in (False, True):
        plain, start, end, how = rewrite(text, bold)
        if plain == seen:
            break
        seen = plain
        for kind in KINDS:
            for a, b in _FIND[kind](plain):
                used = {*how[a:b]} - {""}
                s, e = start[a], end[b - 1]
                if not used or kind == "email" and used <= {"softat"} and not _CUE.search(text, max(0, s - 20), s) or kind != "email" and used & {"softat"}:
                    continue  # nothing rewritten, or a plain "at" without any other sign of an address
                if taken[kind].free(s, e):
                    found.append((kind, s, e))
                    taken[kind].add(s, e)
    return found


_RUN_CARD = re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_DIGITS = re.compile(r"[0-9]+")


def run_on_spans(text: str, base: list[Span]) -> list[Span]:
    """Card and phone numbers inside matches that were too long: a card number set off by separators, a phone number up to
    the last group of digits that leaves it valid."""
    found: list[Span] = []
    free = _Taken(len(text), base).free
    for m in _CARD.finditer(text):
        if len(m[0]) > 19 and free(*m.span()):
            for x in _RUN_CARD.finditer(text, m.start(), m.end()):
                if luhn(x[0].replace(" ", "").replace("-", "")):
                    found.append(("card", *x.span()))
    for m in _PHONE.finditer(text):
        if free(*m.span()):
            digits, end = 0, 0
            for x in _DIGITS.finditer(text, m.start(), m.end()):
                digits += len(x[0])
                if 8 <= digits <= 15:
                    end = x.end()
            if end:
                found.append(("phone", m.start(), end))
    return found


def all_spans(text: str, triggered: bool) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), both by kind and start."""
    base = base_spans(text)
    added = run_on_spans(text, base)
    if triggered:
        added += disguised_spans(text, base + added)
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def spans_by_text(texts: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    triggered = pc.match_substring_regex(texts, _TRIGGER).to_numpy(zero_copy_only=False)
    plain = ~pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False) & ~triggered
    for text, hit, none in zip(texts.to_pylist(), triggered, plain):
        yield (text, [], []) if none else (text, *all_spans(text, hit))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the tag of its first kind."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, every = [], []
            for _, b, e in spans_by_text(texts_of(batch, "text")):
                base.append(b)
                every.append(e)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
            added = pa.array([len(e) - len(b) for b, e in zip(base, every)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, digest, pa.array(map(_joined, every), pa.string()), added],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def mask(documents: DataFrame) -> DataFrame:
    """All columns and rows, the personal data in ``text`` replaced by tags; a null text stays null."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nulls = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            new = pa.array([masked(t, e) for t, _, e in spans_by_text(texts_of(batch, "text"))], batch.column("text").type, mask=np.array(nulls))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 :]], names)

    return documents.mapInArrow(run, documents.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
