"""References of record types never met before, walks that stop at what is hidden, and redaction against a plain search."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from worldlog.operators import explain, redaction, references
from worldlog.operators.references import Blob, DynamicRef, Label, OwnId, Ref, RefInPairs, RefPairs

S = StringType()


def struct(**fields):
    return StructType([StructField(n, t, True, m) for n, (t, m) in fields.items()])


def test_references_of_an_unknown_type(spark):
    inner = struct(part_id=(S, Ref("part")), note=(S, None), deep=(ArrayType(struct(who=(S, DynamicRef("kind")), kind=(S, None))), None))
    schema = struct(
        thing_id=(S, OwnId()), other_id=(S, Label()), one=(S, Ref("claim")), many=(ArrayType(S), Ref()), pairs=(ArrayType(struct(k=(S, None), r=(S, None))), RefPairs()), bare=(ArrayType(S), RefPairs()),
        slots=(ArrayType(ArrayType(S)), RefInPairs("slot", 1)), named=(ArrayType(struct(a=(S, None), b=(S, None))), RefInPairs("b-kind", 1)), nested=(inner, None), lists=(ArrayType(ArrayType(inner)), None),
        maps=(MapType(S, inner), None), blob=(S, Blob()), plain=(ArrayType(S), None), what=(S, None), dyn=(S, DynamicRef("what")),
    )
    part = lambda n: {"part_id": n, "note": "part-x", "deep": [{"who": f"w{n}", "kind": "Object"}, {"who": "", "kind": "x"}, {"who": "lost", "kind": None}]}
    row = ("t1", "l1", "c1", ["m1", "", None, "m1"], [("Object", "p1"), ("x", ""), (None, "p2")], ["b1", ""], [["k", "s1"], ["only"]], [("a", "n1")], part("i1"), [[part("i2")], []], {"k": part("i3"), "none": None},
           '{"x":{"part_id":["q1",["q2"]],"one":"","y":[{"thing_id":"t9","note":"t8"}]},"z":{"kind":"OBJECT","who":"w9"},"who":"nobody"}', ["z"], "claim", "d1")
    empty = ("t2", *[None] * 14)
    things = spark.createDataFrame([row, empty], schema)
    got = {tuple(r) for r in references.bridge({"thing": things, "none": spark.createDataFrame([("n1", "x")], struct(none_id=(S, OwnId()), y=(S, None)))}, {"object": "entity"}).collect()}
    want = {
        ("one", "claim", "c1"), ("many", "*", "m1"), ("pairs", "entity", "p1"), ("bare", "*", "b1"), ("slots", "slot", "s1"), ("named", "b-kind", "n1"), ("nested.part_id", "part", "i1"), ("nested.deep.who", "entity", "wi1"),
        ("lists.part_id", "part", "i2"), ("lists.deep.who", "entity", "wi2"), ("maps.part_id", "part", "i3"), ("maps.deep.who", "entity", "wi3"), ("blob", "part", "q1"), ("blob", "part", "q2"), ("blob", "thing", "t9"), ("blob", "entity", "w9"), ("dyn", "claim", "d1"),
    }
    assert got == {("thing", "t1", *w) for w in want}


def test_walks_stop_at_what_is_hidden(spark):
    edges = spark.createDataFrame([(a, f"f{a}", "k", b) for a, b in ["ab", "bc", "cd", "ae", "ed", "dg", "ga", "ax", "ch"]], "src string, field string, kind string, ref string")
    records = spark.createDataFrame([("k", n, n != "b") for n in "abcdegh"], "kind string, ref string, visible boolean")
    seeds = spark.createDataFrame([("a",), ("b",), ("zz",)], "ref string")
    got = sorted((r.seed, r.hop, r.parent, r.ref) for r in explain.descent(seeds, edges, records, 5).collect() if r.hop)
    assert got == [("a", 1, "a", "REDACTED"), ("a", 1, "a", "e"), ("a", 2, "e", "d"), ("a", 3, "d", "g")]
    parts = {r.section: (r.n, r.n_hidden, r["first"]) for r in explain.sections(explain.descent(seeds, edges, records, 5), {"ALL": ("k",), "E": ("k/fa",), "NONE": ("q",)}).collect()}
    assert parts == {"ALL": (5, 1, "a"), "E": (2, 1, "e")}


def plain_scrub(text, hidden, visible):
    needles = {h for h in hidden if h}
    for h in hidden:
        needles |= {h[:n] for n in redaction.SHORT_FORMS if len(h) > n and not any(v.startswith(h[:n]) for v in visible)}
    if text is None or not needles:
        return text
    return re.sub("|".join(re.escape(n) + r"(?:@v\d+)?" for n in sorted(needles, key=len, reverse=True)), "REDACTED", text)


@pytest.mark.parametrize("bound", [100_000, 3])
def test_redaction_against_a_plain_search(spark, monkeypatch, bound):
    monkeypatch.setattr(redaction, "BEGINNINGS", bound)
    draw = random.Random(8)
    ids = [f"{k}-{''.join(draw.choices('0123456789abcdef', k=n))}" for k in ("clm", "obs", "x") for n in (3, 14, 20, 26) for _ in range(12)]
    ids += ["a", "ab", "é-1", "日本-22", "a.b*c", "q" * 30, "q" * 20 + "r" * 10, "q" * 16 + "zz"]
    hidden, visible = draw.sample(ids[:-4], 50) + ["q" * 30, "a.b*c"], []
    visible = [i for i in ids if i not in hidden]
    pieces = [*ids, *(i[:18] for i in ids), *(i[:16] for i in ids), *(i[1:] for i in ids), "@v12", "@v", " ", ",", "x", "日", "q" * 40]
    rows = [(n, "".join(draw.choices(pieces, k=draw.randint(0, 30)))) for n in range(200)] + [(900, None), (901, ""), (902, "a" * 3000)]
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "key long, body string, at int, said string")
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    got = redaction.scrubbed(table, "key", "body", names([*hidden, hidden[0], ""]), names(visible))
    assert got.columns == table.columns
    assert {r.key: r.body for r in got.collect()} == {k: plain_scrub(t, hidden, visible) for k, t in rows}
    assert redaction.scrubbed(table, "key", "body", names([]), names(visible)).select("key", "body").collect() is not None
    assert {r.key: r.body for r in redaction.scrubbed(table, "key", "body", names([]), names(visible)).collect()} == dict(rows)


def test_projection_of_latest_versions(spark):
    mark = lambda df: df.withColumn("open", F.col("open"))
    rows = spark.createDataFrame([("e1", 1, "no", "t", True), ("e1", 2, "see e2, t1", "t", True), ("e2", 2, "x", "t", False), ("e2", 1, "x", "t", True)], "id string, version int, note string, t string, open boolean")
    more = spark.createDataFrame([("t1", "by e2@v1", False), ("t2", "ne2w e1", True)], "tid string, note string, open boolean")
    got = redaction.projection({"e": (mark(rows), "id")}, {"t": (more, "tid")}, F.col("open"), ["open"]).collect()
    assert {(r.family, r.ref, r.n_versions): r.record for r in got} == {("e", "e1", 2): '{"id":"e1","version":2,"note":"see REDACTED, REDACTED","t":"t"}', ("t", "t2", 1): '{"tid":"t2","note":"nREDACTEDw e1"}'}


def test_hidden_ids_are_gone_through_twice_at_most(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    hidden = [f"clm-{i:020}" for i in range(100)]
    rows = spark.createDataFrame([(1, f"{hidden[3]}@v2{hidden[4]}"), (2, None)], "key long, body string")
    got = redaction.scrubbed(rows, "key", "body", names(hidden).mapInArrow(counted, "id string"), names(["ent-1"])).collect()
    assert {r.key: r.body for r in got} == {1: "REDACTEDREDACTED", 2: None}
    assert read.value <= 200
