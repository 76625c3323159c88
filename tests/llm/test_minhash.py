"""Near-dedup against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from worldlog.llm import minhash

from . import corpus


def sets(text: str | None, n: int) -> set[tuple[str, ...]]:
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", plain)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows: list, n: int, percent: int) -> dict:
    kept = [(i, sets(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in kept}
    changed = True
    while changed:
        changed = False
        for i, a in kept:
            for j, b in kept:
                if a and b and root[i] != root[j] and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(spark, shingle, percent):
    rows = corpus.texts()
    got = minhash.near_duplicates(corpus.table(spark, rows), shingle, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, shingle, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    sizes = {i: len(sets(t, shingle)) for i, t in rows if i is not None}
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == sizes


def test_one_row_of_each_group_stays(spark):
    docs = corpus.table(spark, corpus.texts())
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    want = {i for i, root in brute(corpus.texts(), 5, 80).items() if i == root}
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert set(ids) - {None} == want
    assert ids.count(None) == 2


def test_no_rows(spark):
    docs = corpus.table(spark, [])
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.without_near_duplicates(docs).count() == 0


def test_densification_fills_every_bin_alike():
    signer = minhash.Signer(4, 3)
    few = np.array([5, 2**63], np.uint64)
    assert set(signer.bins_of(few)) <= set(few)
    assert (signer(few) == signer(few.copy())).all()
    # agreement of bins estimates similarity
    wide = minhash.Signer(40, 6)
    draw = np.random.Generator(np.random.PCG64(1))
    a = np.unique(draw.integers(0, 2**64, 150, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:120], draw.integers(0, 2**64, 30, dtype=np.uint64)]))
    agree = (wide.bins_of(a) == wide.bins_of(b)).mean()
    assert abs(agree - 120 / 180) < 0.15


def test_links_away_from_the_hubs_of_a_crowded_bucket(spark):
    draw = np.random.Generator(np.random.PCG64(5))
    shared = [f"s{i}" for i in range(80)]
    own = lambda i: [f"o{i}x{j}" for j in range(40)]
    # members of one template are apart (J about 0.48), but four have a copy with two words changed
    rows = [(i, " ".join(shared + own(i))) for i in range(1500)]
    for i, like in enumerate(draw.choice(1500, 4, replace=False)):
        words = shared + own(int(like))
        words[85] = words[86] = "changed"
        rows.append((3000 + i, " ".join(words)))
    docs = minhash.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "texts")
    buckets = minhash.written(docs.selectExpr("doc_id", "0L AS bucket").select("doc_id", "bucket"), "buckets")
    links = minhash._links(buckets, docs, 3, 85).collect()
    plain = [(i, sets(t, 3)) for i, t in rows]
    want = {(i, j) for i, a in plain[1500:] for j, b in plain[:1500] if 100 * len(a & b) >= 85 * len(a | b)}
    assert len(want) == 4
    assert {(r.a, r.b) for r in links} == want


def test_links_of_few_shingles_are_found(spark):
    draw = np.random.Generator(np.random.PCG64(9))
    found = []
    for _ in range(5):  # sets of 4 and 5 shingles, J = 0.8
        words = [f"w{x}" for x in draw.integers(0, 10**9, 9)]
        found.append((" ".join(words[:8]), " ".join(words)))
    pairs = pa.table({"doc_id": list(range(10)), "text": [t for p in found for t in p]})
    docs = spark.createDataFrame(pairs.to_pylist(), "doc_id long, text string")
    texts = minhash.written(docs, "texts")
    shared = minhash.written(docs.selectExpr("doc_id div 2 AS bucket", "doc_id"), "shared")
    away = minhash.written(shared.selectExpr("bucket", "-1 - bucket AS doc_id").distinct(), "away")
    more = texts.union(away.selectExpr("doc_id", "concat('z', bucket, ' a b c d e f') AS text"))
    links = minhash._links(shared.union(away).select("doc_id", "bucket"), more, 5, 80).collect()
    assert {(r.b, r.a) for r in links} == {(i, i + 1) for i in range(0, 10, 2)}


@pytest.mark.parametrize("edits", [3, 7, 14])
def test_one_bucket_of_edited_copies_joins_as_all_pairs_do(spark, edits):
    """Members of a bucket near the threshold: substitutions, deletions, insertions, a second template, small sets."""
    draw = np.random.Generator(np.random.PCG64(edits))
    rows = []
    for i in range(260):
        words = [f"t{i % 2 if i % 5 == 0 else 0}x{j if j < 60 else j + 100 * (i % 5 == 0)}" for j in range(110)]
        for at in sorted(draw.choice(100, int(draw.integers(0, edits + 1)), replace=False), reverse=True):
            kind = draw.integers(3)
            words[at : at + (kind != 2)] = [] if kind == 1 else [f"e{draw.integers(40) if i % 3 else i}"]
        rows.append((i, " ".join(words[: 6 if i % 41 == 7 else None])))
    docs = minhash.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "texts")
    buckets = minhash.written(docs.selectExpr("doc_id", "doc_id % 2 AS bucket"), "buckets")
    buckets = buckets.union(buckets.selectExpr("doc_id", "-1L AS bucket")).select("doc_id", "bucket")
    links = [(r.a, r.b) for r in minhash._links(buckets, docs, 3, 85).collect()]
    plain = dict((i, sets(t, 3)) for i, t in rows)
    assert all(100 * len(plain[a] & plain[b]) >= 85 * len(plain[a] | plain[b]) for a, b in links)
    root = {i: i for i in plain}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {i: find(i) for i in root} == brute(rows, 3, 85)
