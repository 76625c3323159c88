"""Personal data against the patterns as they are written."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from worldlog.llm import pii

from . import corpus

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute(text: str) -> list[tuple[int, int, str]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [(*m.span(), "email") for m in re.finditer(EMAIL, text)]
    out += [(*m.span(), "ip") for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in re.finditer(CARD, text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(*m.span(), "phone") for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE_KINDS.index(s[2])))


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_those_of_the_patterns(seed):
    draw = random.Random(seed)
    parts = ["a@b.c", "x@y", "@", ".", "..", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "+", "0", "12", "-", " ", "a", "%", "é@é.fr", "00000000000000000001.2.3.4", "+49 30 ", "()", "\n"]
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 12)))
        got = [s[:3] for s in pii.spans(text) if s[2] in pii.BASE_KINDS]
        assert got == brute(text), text


def test_checksums_and_context():
    kinds = lambda text: [s[2] for s in pii.spans(text)]
    assert "iban" in kinds("pay to GB82 WEST 1234 5698 7654 32 now")
    assert "iban" not in kinds("pay to GB82 WEST 1234 5698 7654 33 now")
    assert kinds("social security 123-45-6789") == ["ssn"]
    assert kinds("order 123-45-6789 of parts") == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a.b" * 100_000 + "@", "@a" * 150_000):
        pii.spans(text)


def test_masking_keeps_rows_and_columns(spark):
    docs = corpus.table(spark, [*corpus.texts(), (90, "mail a@b.co or 1.2.3.4, twice")])
    got = pii.detect(docs)
    assert set(got.columns) == {*docs.columns, "pii_spans"}
    rows = {r.doc_id: r for r in got.filter("doc_id IN (63, 64, 90)").collect()}
    assert rows[90].text == "mail <EMAIL> or <IP>, twice"
    assert rows[63].text is None
    assert rows[64].text == ""
    assert got.count() == docs.count()
    assert pii.detect(corpus.table(spark, [])).count() == 0
    assert got.filter(F.col("doc_id").isNull()).count() == 2


def test_context_words_are_whole_words():
    score = lambda text: pii.spans(text)[0][3]
    assert score("discard 4111 1111 1111 1111") == score("4111 1111 1111 1111") < score("my card: 4111 1111 1111 1111")
    assert score("a description 10.1.2.3") == score("10.1.2.3") < score("two servers, 10.1.2.3")
    assert score("hotel +1 555 010 2030") < score("tel +1 555 010 2030")
