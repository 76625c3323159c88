"""Tasks grow with the rows, and components pass nothing through the driver."""

from __future__ import annotations

import re

import pytest

from worldlog import plans
from worldlog.operators import graph

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["g13_provenance_walk", "j01_claim_chain", "g08_shortest_path", "g07_k_hop", "q15_refreshed_hypotheses"])
def test_tasks_grow_with_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    seen = []
    monkeypatch.setattr(graph, "saved", lambda df, label, kept=graph.saved: seen.append(_plan(df)) or kept(df, label))
    told = [*seen, _plan(plans.QUERIES[name](spark, SF))] + seen
    # 6,000 lines in tasks of 500
    assert any(", 12), REPARTITION_BY_NUM" in plan for plan in told)


def test_labels_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "saved", lambda df, label, kept=graph.saved: seen.append(_plan(df)) or kept(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 7)], "src long, dst long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    now, merged = graph.joined_components(graph.components(edges), spark.createDataFrame([(3, 100)], "src long, dst long"))
    assert {r.component for r in now.collect()} == {0} and [tuple(r) for r in merged.collect()] == [(100, 0)]
    assert seen and not any("Broadcast" in plan for plan in [*seen, _plan(now)])


def test_neighbourhood_turns_no_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("a", "b"), ("x", "y")], "src string, dst string")
    found = graph.neighbourhood(edges, spark.createDataFrame([("a",), ("z",)], "node string"), 2)
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("c", 2), ("z", 0)]


@pytest.mark.parametrize("name", ["f15_name_variants", "f21_structured_observations"])
def test_heavy_rows_are_dealt_before_their_work(spark, name):
    assert "REPARTITION_BY_NUM" in _plan(plans.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["p02_payload_status", "r04_quarantine", "p05_units"])
def test_payloads_are_not_dealt_by_feed_and_judged_once(spark, name):
    plan = _plan(plans.QUERIES[name](spark, SF))
    assert not re.search(r"hashpartitioning\(schema_id#\d+(, _declared#\d+)?, \d+\)", plan)
    assert "REPARTITION_BY_NUM" in plan
    assert plan.count("undeclared field present") == 2  # of a document and of a feature


def test_a_receipt_judges_payloads_once(spark):
    assert "required field missing" not in _plan(plans.QUERIES["q04_ingest_counts"](spark, SF))


@pytest.mark.parametrize("name", ["q04_ingest", "q04_ingest_relationships"])
def test_ingest_does_not_deal_payloads_by_feed(spark, name):
    plan = _plan(plans.QUERIES[name](spark, SF))
    assert "hashpartitioning(schema_id" not in plan and "REPARTITION_BY_NUM" in plan
