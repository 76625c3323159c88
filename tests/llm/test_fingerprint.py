"""Fingerprints: equal texts, edited texts, and the order of neighbours."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from worldlog.llm import fingerprint

from . import corpus


def test_edits_are_those_of_a_plain_loop(spark):
    rows = [(i, t) for i, t in corpus.texts() if i is not None and i != 44]
    got = {r.doc_id: r for r in fingerprint.compared(corpus.table(spark, rows)).collect()}
    line = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(line)
    for (i, t), (_, following) in zip(line, [*line[1:], line[0]], strict=True):
        text, following = t or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == text)
        assert (got[i].edited_paragraphs == "") == (edited == text or not text)
        assert 0 <= got[i].near_next <= 1
        assert 0 <= got[i].near_edited <= 1


def test_equal_texts_have_equal_fingerprints_and_edits_are_located(spark):
    lines = [f"line {i} says nothing of note today" for i in range(40)]
    other = [*lines[:17], "line 17 was edited", *lines[18:]]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join(other))], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1] == prints[2] != prints[3]
    pair = spark.createDataFrame([(prints[1], prints[3])], "a string, b string")
    got = pair.select(fingerprint.differing(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), F.col("b"))).first()
    assert got[0] == [17]
    assert 0.9 < got[1] < 1


def test_leaves_make_up_the_text(spark):
    texts = ["", "a", "a b c d e f", "\n\n", " \t x\n\ty  z \n", "  ", "日本 語\n\nß"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.array_join(F.regexp_extract_all(F.col("text"), F.lit(fingerprint.LEAF), F.lit(0)), "")
    assert all(r[0] == r[1] for r in docs.select("text", whole).collect())


@pytest.mark.parametrize("ids", [[5], [1, 2, 3], [0, 10**15, 10**15 + 1, -7], list(range(0, 9000, 3))])
def test_next_of_each_key(spark, ids):
    rows = spark.createDataFrame([(i, 0) for i in ids], "key long, tie long")
    line = sorted(ids, reverse=True)
    want = dict(zip(line, [*line[1:], line[0]], strict=True))
    assert {r.key: r.next.key for r in fingerprint.with_next(rows).collect()} == want


def test_no_rows(spark):
    assert fingerprint.compared(corpus.table(spark, [])).count() == 0


def test_nulls_and_repeats_stay(spark):
    rows = corpus.texts()
    assert fingerprint.compared(corpus.table(spark, rows)).count() == len(rows)


def test_unlike_texts_are_never_wholly_alike(spark):
    line = "one two three four\n"
    docs = spark.createDataFrame([(1, line), (2, line * 2), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.compared(docs).collect()}
    assert got[2].fingerprint != got[1].fingerprint
    assert 0 < got[2].near_next < 1
    assert got[4].near_next == 1  # both are empty
    pair = fingerprint.likeness(F.lit("x:a,"), F.lit("x:a,")), fingerprint.likeness(F.lit("x:a,"), F.lit("y:a,a,"))
    assert [*docs.limit(1).select(*pair).first()] == [1.0, 0.5]


def test_columns_stay_and_long_texts_are_whole(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000, 5)], "doc_id long, text string, _leaves int")
    got = fingerprint.fingerprints(docs).first()
    assert got._leaves == 5
    assert got.fingerprint.count(",") == 12_500
