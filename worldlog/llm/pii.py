"""Operator 10, personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in the order of reports, their scores before context, and the words that speak for each.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT_GAIN, CONTEXT_CHARS, LEAST_SCORE = 0.3, 40, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits that failed from its first digit fails from the others too: lookbehind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Context words count as whole words, with a plural or verb ending at most.
_WORDS = {kind: re.compile(rf"\b(?:{'|'.join(words)})(?:s|ed|ing)?\b", re.I) for kind, words in CONTEXT.items()}

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from each @ so that long runs of address characters cost one pass."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans that pattern and checksum accept; a failing match is dropped and not tried again within."""
    if "@" in text:
        yield from ((a, b, "email") for a, b in emails(text))
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.start(), m.end(), "phone"
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield m.start(), m.end(), "iban"
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), "ssn"


def spans(text: str) -> list[Span]:
    """(start, end, kind, score) by start, then kind; base kinds stay whatever their score."""
    found = []
    for a, b, kind in proposals(text):
        near = _WORDS[kind].search(text[max(0, a - CONTEXT_CHARS) : a] + " " + text[b : b + CONTEXT_CHARS])
        score = min(1.0, SCORES[kind] + CONTEXT_GAIN * bool(near))
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            found.append((a, b, kind, score))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def masked(text: str, found: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, done = [], 0
    for a, b, kind, _ in found:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SPAN_TYPE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_SPANS = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
)


def detect(docs: DataFrame, mask: bool = True) -> DataFrame:
    """``docs`` with ``pii_spans`` (start, end, kind, score; code points, end exclusive) of ``text``, which is masked.

    Without ``mask``, ``text`` is left out. Whole texts are read. Null text has no span and stays null; empty text has
    no span. Every other column, and every row, repeated or not, stays; a ``pii_spans`` of the input is replaced. No
    rows give no rows.
    """
    kept = docs.drop("pii_spans").withColumn("text", F.col("text").cast("string"))
    place = kept.columns.index("text")
    others = [i for i in range(len(kept.columns)) if i != place]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for x in batch.column(place):
                said = x.as_py()
                own = spans(said) if said else []
                found.append([dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in own])
                if mask:
                    texts.append(masked(said, own) if own else said)
            added = [pa.array(found, _SPANS), *([pa.array(texts, pa.string())] if mask else [])]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in others], *added], names=names)

    fields = [*[kept.schema.fields[i] for i in others], T.StructField("pii_spans", T.ArrayType(_SPAN_TYPE))]
    fields += [T.StructField("text", T.StringType())] * mask
    names = [f.name for f in fields]
    return kept.mapInArrow(find, T.StructType(fields))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
