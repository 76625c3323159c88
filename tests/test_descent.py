"""Walks of numbers: what is written of them, and ids of several records."""

from __future__ import annotations

from worldlog import plans
from worldlog.operators import explain, graph

SF = "/root/testdata/sf0.001"
EDGE, RECORD = "src string, field string, kind string, ref string", "kind string, ref string, visible boolean"


def test_explanations_walk_by_numbers(spark, monkeypatch):
    seen = []
    for name in ("saved", "kept_by"):
        kept = getattr(graph, name)
        monkeypatch.setattr(explain, name, lambda df, label, *keys, kept=kept, **more: seen.append((label, dict(df.dtypes))) or kept(df, label, *keys, **more))
    plans.QUERIES["q12_explanations"](spark, SF)
    walks = [types for label, types in seen if label == "descent"]
    assert walks and all(types[c] == "bigint" for types in walks for c in ("seed", "parent", "node"))
    # references are dealt once, by what makes them; those that no walk comes by are not looked up
    [edges] = [types for label, types in seen if label == "edges"]
    assert list(edges) == ["_src", "_field", "_kind", "_ref"]


def test_ids_of_several_records(spark):
    # x is of two kinds, y has a visible and a hidden row, what its hidden row names is told apart
    records = spark.createDataFrame([("a", "s", True), ("a", "x", True), ("b", "x", True), ("a", "y", True), ("a", "y", False), ("a", "z", True), ("a", "h", False), ("a", None, True)], RECORD)
    edges = spark.createDataFrame([("s", "g", "*", "x"), ("s", "f", "*", "x"), ("s", "f", "a", "y"), ("x", "f", "b", "s"), ("x", "f", "a", "gone"), ("s", "f", "a", "h"), (None, "f", "a", "z")], EDGE)
    hidden = spark.createDataFrame([("y", "f", "a", "z"), ("h", "f", "a", "lost")], EDGE)
    seeds = spark.createDataFrame([("s",), ("x",), ("s",), (None,), ("h",)], "ref string")
    got = sorted((r.seed, r.hop, r.parent or "", r.field or "", r.kind, r.ref) for r in explain.descent(seeds, edges, records, 3, hidden).collect())
    assert got == [
        ("s", 0, "", "", "a", "s"), ("s", 1, "s", "f", "a", "REDACTED"), ("s", 1, "s", "f", "a", "REDACTED"), ("s", 1, "s", "f", "a", "x"), ("s", 1, "s", "f", "a", "y"), ("s", 1, "s", "f", "b", "x"), ("s", 2, "y", "f", "a", "z"),
        ("x", 0, "", "", "a", "x"), ("x", 0, "", "", "b", "x"),
    ]
    places = {"ALL": ("a", "b")}
    want = {tuple(r) for r in explain.sections(explain.descent(seeds, edges, records, 3, hidden), places).collect()}
    assert want == {("s", "ALL", 7, 2, "s"), ("x", "ALL", 2, 0, "x")}
    assert {tuple(r) for r in explain.explained(seeds, edges, records, 3, places, hidden).collect()} == want
