"""The filter audit against a plain loop over every order."""

from __future__ import annotations

import itertools
from collections import Counter

import pytest

from worldlog.llm import filter_audit

from . import corpus


def plain(verdicts: list[tuple[str, set, int, int]], filters: str) -> Counter:
    """Rows of every part, order and step, each filter applied in turn to a list."""
    found, totals = {}, Counter()
    for part in {v[0] for v in verdicts}:
        rows = [v for v in verdicts if v[0] == part]
        for order in itertools.permutations(filters):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [v for v in left if f in v[1]]
                left = [v for v in left if f not in v[1]]
                fails = [v for v in rows if f in v[1]]
                found[part, "".join(order), step, f] = (len(left), len(gone), len(fails) - len(gone), sum(v[1] == {f} for v in rows), sum(v[2] for v in gone), sum(v[3] for v in gone))
                totals[part, f] += len(gone)
    return Counter((part, order, step, *x, totals[part, f]) for (part, order, step, f), x in found.items())


def plain_verdicts(docs, labels):
    least: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, source in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least[t] < i,
        }
        said = [x for x in labels if i is not None and x[0] == i]
        out.append((source or "", {f for f, x in fails.items() if x}, int(any(x[1] == 1 for x in said)), int(any(x[2] == 1 for x in said))))
    return out


def test_awkward_documents(spark):
    texts = [*corpus.texts(), (80, "a " * 250), (81, "A B"), (82, "\u0085x # y"), (83, None), (84, "a " * 250), (85, "x y" * 300 + "|")]
    docs = [(i, t, [None, "", "s1", "s2"][k % 4]) for k, (i, t) in enumerate(texts)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(5, None, 1), (5, 0, None), (None, 1, 1), (80, 1, 0), (84, 1, 1)]
    rows = spark.createDataFrame([(*d, 1, "p", True, "s") for d in docs], "doc_id long, text string, source string, A int, part string, good boolean, state string").repartition(3)
    said = spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = Counter(tuple(r) for r in filter_audit.audited(rows, said).collect())
    assert got == plain(plain_verdicts(docs, labels), "ABCDE")
    assert max(got.values()) == 1
    assert len(got) == 600 * 3


def test_other_filters_and_nulls(spark):
    rows = [("p", True, None, True, None, True), (None, False, True, True, True, None), ("", True, True, True, False, False), ("q", False, None, False, True, True)] * 3
    verdicts = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = Counter(tuple(r) for r in filter_audit.interactions(verdicts, ("X", "Y", "Z")).collect())
    plainly = [(r[0] or "", {f for f, x in zip("XYZ", r[1:4], strict=True) if x}, int(bool(r[4])), int(bool(r[5]))) for r in rows]
    assert got == plain(plainly, "XYZ")


def test_no_rows(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(rows, labels).collect() == []
    with pytest.raises(ValueError, match="letter"):
        filter_audit.interactions(rows, ("AB",))
