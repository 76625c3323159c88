"""Substring dedup against a table of all windows."""

from __future__ import annotations

import hashlib
import re

import pytest

from worldlog.llm import substring

from . import corpus


def brute(rows: list, window: int) -> list[tuple]:
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in split:
        for at in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[at : at + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for at in range(len(w) - window + 1):
            if i is not None and first[tuple(w[at : at + window])] < i:
                gone |= set(range(at, at + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2_000, 1])
def test_words_of_repeated_windows_go(spark, hot):
    rows = corpus.texts()
    got = substring.without_repeats(corpus.table(spark, rows), hot=hot).drop("kept_text").collect()
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows, 50), key=order)


def test_no_rows(spark):
    assert substring.without_repeats(corpus.table(spark, [])).count() == 0
