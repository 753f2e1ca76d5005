"""Personal data, also in disguise, with spans in the source text.

Plain identifiers are found by patterns. For disguised ones, the surroundings of every mark of a disguise are
put through transducers, each of which rewrites the text and keeps, for every character it writes, the source
span that the character stands for: look-alike letters and foreign digits become ASCII, invisible characters go,
spelled digits become digits, and "at", "dot" and "plus" in their usual disguises become signs. The same detectors
then run on the normalised text, and what they find is mapped back to the source.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# fixed values: letters that look like Latin ones, number words
LOOK_ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXoiv"))
INVISIBLE = "­​‌‍⁠﻿"
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_NUMBER = rf"\b(?:{'|'.join(NUMBERS)})\b"
_RUN = re.compile(rf"(?i){_NUMBER}(?:[ ,-]{{1,2}}{_NUMBER})*")
_ONE = re.compile(rf"(?i){_NUMBER}")
_PLUS = re.compile(r"(?i)\bplus[ -]{1,2}(?=[0-9])")
_AT = re.compile(r"(?i) {0,2}[\[({<] ?(?:at|@) ?[\])}>] {0,2}| {1,2}at {1,2}")
_DOT = re.compile(r"(?i) {0,2}[\[({<] ?(?:dot|\.) ?[\])}>] {0,2}| {1,2}dot {1,2}")
_BARE_AT = re.compile(r"(?i) at ")
#: A noun "dot" follows these, and a place on the web is said to be "at" its domain after those.
_ARTICLES = frozenset("a an the this that these those each every any some no my your his her its our their".split())
_PROSE = frozenset(
    "a an and are available be been but by directly find for found free from go he her here him hosted i in is it its join listed"
    " live located look looked looking me meet more now of on online only or out posted published read register see she site"
    " that the them there they this to us visit was we web webpage website were you".split()
)
#: What may begin a disguise. Prose is full of a bare "at", so that needs a domain with a real dot after it.
_MARK = re.compile(
    rf"[{''.join(LOOK_ALIKE)}{INVISIBLE}！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]"
    rf"|(?i:{_NUMBER}|\bdot\b|[\[({{<] ?(?:at|[.@]) ?[\])}}>]|\bat {{1,2}}(?=[A-Z0-9-]++\.[A-Z0-9])|\bplus[ -]{{1,2}}[0-9])"
)
#: Characters around a mark that are normalised with it, at least: no word or spaced number is cut.
AROUND = 96
_SPACED = frozenset("0123456789().+- ")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, leftmost and without overlap within a kind; linear in the text."""
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            # the local part ends at the sign, so the run of its characters before the sign is all that can match
            start = at
            while start > last and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                last = m.end()
                yield "email", start, last
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


class Tape:
    """A text whose characters know their source spans and whether they were rewritten."""

    def __init__(self, text: str, offset: int):
        self.text = text
        self.spans = [(offset + i, offset + i + 1) for i in range(len(text))]
        self.changed = [False] * len(text)

    def rewrite(self, pattern: re.Pattern, written: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace each match by (character, start, end) triples, positions within the present text."""
        text, spans, changed, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[last : m.start()])
            spans += self.spans[last : m.start()]
            changed += self.changed[last : m.start()]
            put = written(m)
            if not put and changed:
                changed[-1] = True  # what was left out lay next to this character
            for c, start, end in put:
                text.append(c)
                spans.append((self.spans[start][0], self.spans[end - 1][1]))
                changed.append(True)
            last = m.end()
        if last:
            self.text = "".join(text) + self.text[last:]
            self.spans = spans + self.spans[last:]
            self.changed = changed + self.changed[last:]


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    return LOOK_ALIKE.get(c, c) if digit is None else str(digit)


_CHARACTER = re.compile(r"[^\x00-\x7f]")


def normalise(text: str, offset: int = 0) -> Tape:
    """The text after all transducers."""
    tape = Tape(text, offset)
    if not text.isascii():
        tape.rewrite(_CHARACTER, lambda m: [(c, m.start(), m.end()) for c in _plain(m[0])])
        # characters that stay as they are were not rewritten in earnest
        tape.changed = [ch and ord(c) < 128 for c, ch in zip(tape.text, tape.changed)]

    def digits(m: re.Match) -> list[tuple[str, int, int]]:
        words = [(w[0].lower(), m.start() + w.start(), m.start() + w.end()) for w in _ONE.finditer(m[0])]
        return [(str(NUMBERS.index(w)), start, end) for w, start, end in words]

    tape.rewrite(_RUN, digits)
    tape.rewrite(_PLUS, lambda m: [("+", m.start(), m.end())])
    tape.rewrite(_DOT, lambda m: [(".", m.start(), m.end())])
    tape.rewrite(_AT, lambda m: [("@", m.start(), m.end())])
    return tape


def _is_address(found: str, source: str, after: str) -> bool:
    """Whether a normalised address, in lower case, is none that prose or a web address makes up."""
    local, _, domain = found.rpartition("@")
    *labels, last = domain.split(".")
    if any(c in source for c in "@[](){}<>"):
        return last in ENDINGS or len(last) >= 2 and last.isalpha()
    # words alone are a weak disguise: prose may run "at ... dot ..." or "at" a web address as well
    if last not in ENDINGS:
        return False
    at = _BARE_AT.search(source)
    if at and "." in source[at.end() :]:
        return local not in _PROSE and labels[0] != "www" and after != "/"
    return labels[-1] not in _ARTICLES


def disguised(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in the source of identifiers that only the normalised text shows."""
    windows: list[list[int]] = []
    for m in _MARK.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        low = windows[-1][1] if windows else 0
        if windows and end <= low:
            continue
        # from an edge to the next space that is not within a spaced number; nothing is passed over twice
        while start > low and not (text[start - 1].isspace() and text[start - 2 : start - 1] not in _SPACED):
            start -= 1
        while end < len(text) and not (text[end].isspace() and text[end + 1 : end + 2] not in _SPACED):
            end += 1
        if windows and start <= low:
            windows[-1][1] = end
        else:
            windows.append([start, end])
    for start, end in windows:
        tape = normalise(text[start:end], start)
        for kind, a, b in detect(tape.text):
            if not any(tape.changed[a:b]):
                continue
            if kind == "email":
                source = text[tape.spans[a][0] : tape.spans[b - 1][1]]
                if not _is_address(tape.text[a:b].lower(), source, tape.text[b : b + 1]):
                    continue
            yield kind, tape.spans[a][0], tape.spans[b - 1][1]


def personal_data(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) in code points, by kind and start. Disguised spans within a plain one are left out."""
    if not text:
        return []
    plain = list(detect(text))
    found = [(k, s, e, True) for k, s, e in plain]
    if _MARK.search(text):
        starts = {kind: [s for k, s, _ in plain if k == kind] for kind in KINDS}
        ends = {kind: [e for k, _, e in plain if k == kind] for kind in KINDS}
        for k, s, e in dict.fromkeys(disguised(text)):
            # plain spans of a kind do not overlap, so the last that begins before is the only one to hold it
            at = bisect.bisect_right(starts[k], s) - 1
            if at < 0 or e > ends[k][at]:
                found.append((k, s, e, False))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2], not x[3]))


_SPAN = T.StructType(
    [T.StructField(n, t) for n, t in (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("plain", T.BooleanType()))]
)


@F.arrow_udf(T.ArrayType(_SPAN))
def _spans(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
    rows = [[dict(zip(("kind", "start", "end", "plain"), x)) for x in personal_data(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(kind))


def find_personal_data(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """The documents with `spans_col`, an array of (kind, start, end, plain) in code points, ends exclusive.

    Null and empty texts have no spans; a column of that name is replaced; repeated rows have equal spans.
    """
    return docs.withColumn(spans_col, _spans(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by <kind>; of overlapping spans the first one counts."""
    made = f"spans_{uuid.uuid4().hex}"

    @F.arrow_udf("string")
    def mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            parts, last = [], 0
            for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= last:
                    parts += [text[last : s["start"]], f"<{s['kind']}>"]
                    last = s["end"]
            out.append(text if text is None else "".join(parts) + text[last:])
        return pa.array(out, pa.string())

    marked = find_personal_data(docs, text_col, made)
    return marked.withColumn(text_col, mask(F.col(text_col), F.col(made))).drop(made)
