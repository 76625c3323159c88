"""Rules of the world model at their edges: nulls, ties, repeats, empty tables, tampered bundles."""

from __future__ import annotations

import tempfile
from datetime import datetime

import pytest

from worldlog.operators import bundles, evidence, world
from worldlog.sources import feeds, structured

OBSERVED = "claim_id string, at long, value string, family string, state_time timestamp"


def day(n: int) -> datetime:
    return datetime(2024, 1, n)


def outcomes(spark, rows):
    got = world.advanced_claims(spark.createDataFrame(rows, OBSERVED)).collect()
    return {(r.claim_id, r.at): (r.outcome, r.version, r.value, list(r.families)) for r in got}


def test_claims_advance_by_family_and_time(spark):
    got = outcomes(
        spark,
        [
            ("c", 1, "A", "f", day(1)), ("c", 2, "A", "f", day(2)), ("c", 3, "A", "g", day(3)), ("c", 4, "B", "h", day(9)),
            ("c", 5, "B", "f", day(2)), ("c", 6, "B", "f", day(8)), ("c", 7, "B", None, day(1)), ("c", 8, "C", None, day(9)), ("c", 9, "D", "f", None),
            (None, 1, "A", "f", day(1)), ("e", 1, None, None, None),
        ],
    )
    assert [got["c", i][0] for i in range(1, 10)] == ["RECORDED", "NO_NEW_BASIS", "BASIS_ADDED", "CONFLICT", "NOT_NEWER", "REPLACED", "BASIS_ADDED", "REPLACED", "NOT_NEWER"]
    assert got["c", 4] == ("CONFLICT", 2, "A", ["f", "g"]) and got["c", 6] == ("REPLACED", 3, "B", ["f"]) and got["c", 8] == ("REPLACED", 5, "C", [])
    assert got["e", 1] == ("RECORDED", 1, None, []) and len(got) == 10
    assert outcomes(spark, []) == {}


def test_claims_are_folded_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(f"c{i % 2}", i, "AB"[i // 20 % 2], "f", day(1 + i // 20)) for i in range(60)]
        got = outcomes(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [k[1] for k, v in sorted(got.items(), key=lambda x: x[0][1]) if v[0] != "NO_NEW_BASIS"] == [0, 1, 20, 21, 40, 41]


def test_standing_is_reset_by_the_machine_only_from_its_own_states(spark):
    moves = spark.createDataFrame([(c, 10, "REPLACED", 2) for c in "abcde"] + [("f", 10, "BASIS_ADDED", 2)], "claim_id string, at long, outcome string, version long")
    states = spark.createDataFrame([("a", "STALE", 5), ("b", "DISPUTED", 5), ("c", "STALE", 10), ("d", "CURRENT", 1)], "claim_id string, state string, at long")
    assert {r.claim_id: r.action for r in world.settled_standing(moves, states).collect()} == {"a": "RESET", "b": "REVIEW", "c": "STANDS", "d": "NONE", "e": "NONE"}


def test_only_the_last_change_sets_a_state_and_people_are_not_stamped_over(spark):
    changes = spark.createDataFrame(
        [(1, 1, "VALUE_CHANGED", "a", "x", day(5)), (2, 2, "SOURCE_CORRECTION", "a", "y", day(6)), (3, 3, "VALUE_CHANGED", "b", "x", day(6)), (4, 4, "VALUE_CHANGED", "c", "old", day(6)), (5, 5, "NEW_PROPOSITION", "a", "x", day(6)), (6, 6, "VALUE_CHANGED", "d", "x", None)],
        "change_id long, position long, change_class string, claim_id string, current_value string, state_time timestamp",
    )
    claims = spark.createDataFrame([(c, "old", 0, day(1)) for c in "abcd"], "claim_id string, value string, position long, evidence_time timestamp")
    states = spark.createDataFrame([("b", "DISPUTED")], "claim_id string, state string")
    got = {r.change_id: (r.state, r.review) for r in world.propagated_changes(changes, claims, states).collect()}
    assert got == {1: (None, "MANIFESTATION_CHANGED"), 2: ("CORRECTED", "SOURCE_CORRECTED"), 3: (None, "MANIFESTATION_CHANGED"), 4: (None, "MANIFESTATION_CHANGED"), 6: ("STALE", "MANIFESTATION_CHANGED")}


def test_carried_changes_count_each_change_once_and_skip_inert_ones(spark):
    changes = spark.createDataFrame([(1, 1, "VALUE_CHANGED", "r"), (1, 1, "VALUE_CHANGED", "s"), (2, 2, "SEMANTICALLY_UNCHANGED", "r"), (3, 3, "ROLE_CHANGED", None)], "change_id long, position long, change_class string, ref string")
    rests = spark.createDataFrame([("r", "theme", "t"), ("s", "theme", "t"), (None, "theme", "u")], "ref string, kind string, dependent string")
    got = [(r.dependent, r.n_changes, r.classes, r.latest) for r in world.carried_changes(changes, rests).collect()]
    assert got == [("t", 1, "VALUE_CHANGED", 1)]


def test_links_close_once_and_open_again(spark):
    proposals = spark.createDataFrame([(1, 2, 0, "AUTO_ASSOCIATE"), (3, 4, 0, "PROPOSE_ASSOCIATION"), (5, 6, 0, "UNKNOWN")], "left long, right long, at long, outcome string")
    steps = [(1, 2, 1, "SPLIT"), (1, 2, 2, "REVERSED"), (1, 2, 3, "ACCEPTED"), (3, 4, 1, "DEFERRED"), (3, 4, 2, "REVERSED"), (5, 6, 1, "REJECTED")]
    got = {(r.left, r.relation_type): (r.status, r.version) for r in world.association_links(proposals, spark.createDataFrame(steps, "left long, right long, at long, resolution string")).collect()}
    assert got == {(1, "SAME_AS"): ("ACTIVE", 3), (3, "POSSIBLY_SAME_AS"): ("RETIRED", 2)}


def test_services_do_not_acknowledge_and_repeats_keep_the_status(spark):
    raised = spark.createDataFrame([("k", 1), ("k", 5), ("m", 2)], "dedup_key string, at long")
    moved = spark.createDataFrame([("k", 2, "ACKNOWLEDGED", "HUMAN"), ("m", 3, "ACKNOWLEDGED", "SERVICE"), ("k", 0, "RESOLVED", "HUMAN"), ("z", 1, "RESOLVED", "HUMAN")], "dedup_key string, at long, to_status string, actor_kind string")
    assert {r.dedup_key: (r.first_at, r.retriggered, r.status) for r in world.alerts(raised, moved).collect()} == {"k": (1, 1, "ACKNOWLEDGED"), "m": (2, 0, "OPEN")}


def test_an_indicator_is_spent_once(spark):
    acts = spark.createDataFrame(
        [(1, "f", 1, 0.2, "r", "SERVICE", "i"), (2, "f", 2, 0.2, "r", "SERVICE", "i"), (3, "f", 3, 0.4, "r", "SERVICE", "i"), (4, "f", 4, 1.0, "r", "HUMAN", ""), (5, "f", 5, 0.5, "r", "HUMAN", ""), (6, "f", 6, 0.2, "r", "SERVICE", "none"), (7, None, 7, 0.2, "r", "HUMAN", "")],
        "act_id long, forecast_id string, at long, probability double, reason string, actor_kind string, indicator_id string",
    )
    forecasts = spark.createDataFrame([("f", "UPDATE_REQUIRED")], "forecast_id string, status string")
    armed = spark.createDataFrame([("i", "FIRED", ["f"], "APPLY_PROBABILITY", 0.2)], "indicator_id string, status string, forecast_ids array<string>, mode string, target double")
    got = {r.act_id: (r.verdict, r.status) for r in world.update_verdict(acts, forecasts, armed).collect()}
    held = "UPDATE_REQUIRED"
    assert got == {1: ("UPDATED", held), 2: ("SPENT", held), 3: ("NOT_AUTHORIZED", held), 4: ("OUT_OF_RANGE", held), 5: ("UPDATED", "OPEN"), 6: ("NOT_FIRED", held), 7: ("UNKNOWN_FORECAST", None)}


PAIR = """struct<type:string,refs:array<struct<system:string,external_id:string>>,attributes:map<string,string>,time:timestamp,lon:double,lat:double,sources:array<string>,confidence:double>"""


@pytest.mark.parametrize(
    ("left", "right", "negative", "want"),
    [
        ({"refs": [("s", "1")]}, {"refs": [("s", "1")]}, [], ("SYSTEM_MATCH", "AUTO_ASSOCIATE")),
        ({"refs": [("s", "1")]}, {"refs": [("s", "2")]}, [], ("CONFLICT", "REJECT_ASSOCIATION")),
        ({"attributes": {"hull_id": "7"}}, {"attributes": {"hull_id": "7"}}, [], ("ATTRIBUTE_MATCH", "PROPOSE_ASSOCIATION")),
        ({"attributes": {"hull_id": "7"}}, {"attributes": {"hull_id": "8"}}, [], ("CONFLICT", "REJECT_ASSOCIATION")),
        ({"attributes": {"hull_id": "7", "speed": "10"}}, {"attributes": {"hull_id": "7", "speed": "13"}}, [], ("ATTRIBUTE_MATCH", "UNKNOWN")),
        ({"refs": [("s", "1")]}, {"refs": [("s", "1")]}, ["seen apart"], ("SYSTEM_MATCH", "REJECT_ASSOCIATION")),
        ({"lon": 0.0, "lat": 0.0}, {"lon": 9.0, "lat": 9.0}, [], ("ABSENT", "REJECT_ASSOCIATION")),
        ({"time": None}, {}, [], ("ABSENT", "UNKNOWN")),
    ],
)
def test_pairs_are_decided_by_all_features(spark, left, right, negative, want):
    base = {"type": "A", "refs": [], "attributes": {}, "time": day(1), "lon": 1.0, "lat": 1.0, "sources": [], "confidence": None}
    row = spark.createDataFrame([(base | left, base | right, negative)], f"l {PAIR}, r {PAIR}, negative array<string>")
    names = list(base)
    flat = row.selectExpr("negative", *[f"{s}.{n} AS {s}_{n}" for s in "lr" for n in names])
    got = evidence.pair_features(flat).first()
    assert (got.identifier, got.outcome) == want


def test_structured_records_without_an_identifier_say_nothing(spark):
    bodies = ['{"data":{"attributes":{"entity":{"status":"X"}}}}', '{"data":{"id":"L1","attributes":{"entity":{"jurisdiction":"DE"}}}}', "no json", None, '{"hits":{"hits":[{"_source":{"adsh":"a"}}]}}', '{"entities":{"Q5":{"labels":{"en":{"value":""}}}}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "k long, body string")
    got = {(r.k, r.attribute, r.value) for r in structured.observations(feeds.json_fields(rows, "k", "body"), "k").collect()}
    assert got == {(1, "LEI", "L1"), (1, "jurisdiction", "DE")}


def test_a_tampered_member_is_found(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    tables = {"a": spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, 0.1)], "id long, t string, d double"), "b": spark.createDataFrame([], "id long")}
    bundles.export_tables(tables, folder)
    assert {r.name: (r.n, r.n_read, r.equal) for r in bundles.verified(spark, tables, folder).collect()} == {"a": (3, 3, True), "b": (0, 0, True)}
    spark.createDataFrame([(3, "y", 1.0)], "id long, t string, d double").write.mode("append").json(f"{folder}/a")
    assert {r.name: (r.n_read, r.equal) for r in bundles.verified(spark, tables, folder).collect()} == {"a": (4, False), "b": (0, True)}
    seen = spark.createDataFrame([(2,)], "id long")
    assert [r.id for r in bundles.dissemination(tables, seen, "id")["a"].collect()] == [2]
