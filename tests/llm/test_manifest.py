"""The Merkle manifest against a plain loop, in one block and in many, with few and with many parts."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worldlog.llm import manifest


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row: dict) -> str:
    said = [None if row[f] is None else str(row[f]) for f in manifest.FIELDS]
    return H("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in said))


def plain(rows: list[dict], tampered, fan: int = 2) -> Counter:
    """Every row's result, level by level over whole lists."""
    parts: dict = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))

    def tree(nodes):
        paths = [[] for _ in nodes]
        under = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(a, min(a + fan, len(nodes))) for a in range(0, len(nodes), fan)]
            for run in runs:
                for k in run:
                    for leaf in under[k]:
                        paths[leaf].append((["".join(nodes[j] for j in run if j < k)], ["".join(nodes[j] for j in run if j > k)]))
            nodes, under = [H("".join(nodes[j] for j in run)) for run in runs], [[x for j in run for x in under[j]] for run in runs]
        return (nodes or [None])[0], paths

    trees = []
    for part in order:
        rows_ = sorted(parts[part], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees.append((rows_, *tree([plain_leaf(r) for r in rows_])))
    root, above = tree([t[1] for t in trees])
    out = Counter()
    for (rows_, subroot, paths), over in zip(trees, above, strict=True):
        for r, path in zip(rows_, paths, strict=True):
            whole = [*path, *over]
            folded = plain_leaf(r | {"n_chars": r["n_chars"] + 1} if tampered(r) else r)
            for (a,), (b,) in whole:
                folded = H(a + folded + b)
            out[r["doc_id"], plain_leaf(r), subroot, root, H("".join(a + b for (a,), (b,) in whole)), folded, folded == root] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, part int, pos int, members string, seen string, path int"


def table(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "h", 1, 2, "m", "s", 3) for r in rows], SCHEMA).repartition(3)


def made(n: int, langs: list) -> list[dict]:
    rows = [{"doc_id": i * 7 % n, "source": f"s{i % 3}", "lang": langs[i * i % len(langs)], "n_chars": i, "text": f"text ß {i}"} for i in range(n)]
    return [*rows, {"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}, {"doc_id": 0, "source": "", "lang": "", "n_chars": None, "text": ""}, dict(rows[0]), {"doc_id": 3, "source": "a", "lang": "zz", "n_chars": 1, "text": "x" * 200_000}]


@pytest.mark.parametrize(
    ("n", "langs", "fan", "levels", "top"),
    [
        (60, ["en", "de", None, "É", "z"], 2, 10, 4096),
        (150, ["en", "en", "en", "de"], 2, 2, 8),  # several rounds of blocks
        (120, [f"l{i}" for i in range(40)], 2, 1, 4),  # more parts than the driver may hold
        (90, ["en", "de", None], 3, 2, 6),
        (64, ["en"], 2, 3, 4),
    ],
)
def test_against_a_plain_loop(spark, n, langs, fan, levels, top):
    rows = made(n, langs)
    got = manifest.audited(
        table(spark, rows), {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, fan=fan, levels=levels, top=top
    ).collect()
    tampered = lambda r: r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["n_chars"] is not None
    assert Counter(tuple(r) for r in got) == plain(rows, tampered, fan)
    assert all(r.verified != (r.folded_root != r.root) for r in got)


def test_one_row_and_none(spark):
    rows = [{"doc_id": 5, "source": "s", "lang": "en", "n_chars": 1, "text": "t"}]
    [got] = manifest.audited(table(spark, rows)).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root == plain_leaf(rows[0])
    assert got.proof_sha256 == H("")
    assert manifest.audited(table(spark, rows).limit(0)).collect() == []


def test_repeated_rows_have_a_place_each(spark):
    rows = [{"doc_id": 1, "source": "s", "lang": "en", "n_chars": 1, "text": "t"}] * 37
    got = manifest.audited(table(spark, rows), levels=2, top=4).collect()
    assert Counter(tuple(r) for r in got) == plain(rows, lambda r: False)
