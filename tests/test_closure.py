"""Closures over references: what is shuffled, and what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldlog.operators import graph, reads, references
from worldlog.operators.references import Blob, DynamicRef, OwnId, Ref, annotated


def _families(spark):
    body = '{"a_id":"1","deep":[{"kind":"Object","ref":"2"},{"kind":"b","ref":""},{"ref":"3"}],"kind":"b","other":{"ref":"1"}}'
    a = spark.createDataFrame([("1", "b", "2", body), ("2", None, "1", "{"), ("2", None, "1", None)], "a_id string, kind string, ref string, body string")
    b = spark.createDataFrame([("1", ["2", None, "", "9"]), ("1", ["2"])], "b_id string, a_ids array<string>")
    return {"a": annotated(a, a_id=OwnId(), ref=DynamicRef("kind"), body=Blob()), "b": annotated(b, b_id=OwnId(), a_ids=Ref("a"))}


def test_named_is_the_bridge_without_a_shuffle(spark):
    found = references.named(_families(spark), {"object": "a"})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {("a", "1", "ref", "b", "2"), ("a", "1", "body", "a", "1"), ("a", "1", "body", "a", "2"), ("b", "1", "a_ids", "a", "2"), ("b", "1", "a_ids", "a", "9")}
    assert set(map(tuple, found.collect())) == want
    assert sorted(map(tuple, references.bridge(_families(spark), {"object": "a"}).collect())) == sorted(want)


def test_ways_in_buckets_are_not_shuffled_again(spark):
    ways = graph.kept_by(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string"), "ways", "src")
    assert ways.count() == 2
    step = ways.hint("merge").join(ways.withColumnRenamed("src", "_s").select("_s").distinct(), ways.src == F.col("_s"))
    assert "Exchange hashpartitioning" not in step._jdf.queryExecution().executedPlan().toString()


def test_closure_ends_ways_that_name_no_record(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "gone"), ("gone", "c"), ("b", "d")], "src string, dst string")
    records = spark.createDataFrame([(x,) for x in "abcd"], "ref string")
    found, lost = reads.closure(spark.createDataFrame([("a",), ("nobody",)], "ref string"), refs, records)
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("d", 2)] and [r.ref for r in lost.collect()] == ["nobody"]
