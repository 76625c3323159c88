"""Rules of assessments at their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from worldlog.operators import assess


def test_hypotheses_by_what_stands(spark):
    links = [("a", "1", "SUPPORTING"), ("a", "1", "SUPPORTING"), ("a", "2", "SUPPORTING"), ("b", "1", "SUPPORTING"), ("b", "4", "CONTRADICTING"), ("c", "4", "CONTRADICTING"), ("c", "5", "CONTRADICTING"), ("d", "3", "SUPPORTING"), ("e", "9", "SUPPORTING"), ("f", "6", "SUPPORTING"), ("g", "1", "SUPPORTING")]
    claims = [("1", "CURRENT", "x"), ("2", "CURRENT", "y"), ("3", "STALE", "x"), ("4", "CURRENT", "z"), ("5", "CURRENT", "z"), ("6", "CURRENT", None)]
    got = assess.refreshed_hypotheses(spark.createDataFrame(links, "hypothesis_id string, claim_id string, stance string"), spark.createDataFrame(claims, "claim_id string, state string, family string"))
    assert {r.hypothesis_id: r.status for r in got.collect()} == {"a": "SUPPORTED", "b": "DISPUTED", "c": "REJECTED", "d": "UNRESOLVED", "e": "UNRESOLVED", "f": "UNRESOLVED", "g": "WEAKLY_SUPPORTED"}


def test_pivots_of_nothing_or_to_itself_are_none(spark):
    rows = [(1, "s", "n", "IDENTIFIER", "LEI", ""), (1, "s", "n", "ATTRIBUTE", "alias:en", "s"), (1, "s", "n", "ATTRIBUTE", "alias:en", "t"), (1, "s", "n", "ATTRIBUTE", "alias:de", "t"), (1, "s", "n", "IDENTIFIER", "URL", "not an address"), (1, "s", "n", "ATTRIBUTE", "label:en", None)]
    got = assess.pivots(spark.createDataFrame(rows, "response_id long, subject string, native_id string, kind string, name string, value string"))
    assert {(r.to_ref, r.pivot_type) for r in got.collect()} == {("t", "ALIAS_OF"), ("URL:not an address", "IDENTIFIER_OF")}
    assert got.count() == 2


def test_closed_paths_stay_and_objectives_are_named_once(spark):
    paths = spark.createDataFrame([("p", "o", "ACTIVE", "a"), ("p", "o", "ACTIVE", "c"), ("q", "o", "RESOLVED", "a"), ("r", None, "ACTIVE", "n")], "path_id string, objective_id string, status string, basis_id string")
    claims, invalid = spark.createDataFrame([("c", "STALE"), ("n", "CURRENT")], "claim_id string, state string"), spark.createDataFrame([("a",)], "assumption_id string")
    assert sorted(tuple(r) for r in assess.degraded_paths(paths, claims, invalid).collect()) == [("impact_path", "p", "ASSUMPTION_INVALIDATED"), ("mission_objective", "o", "ASSUMPTION_INVALIDATED")]
    assert assess.degraded_paths(paths.limit(0), claims, invalid).count() == 0


def test_replay_takes_the_last_state_before_the_action(spark):
    sha = lambda x: spark.range(1).select(F.sha2(F.lit(x), 256)).first()[0]
    actions = [(1, "p", sha("p"), "k", 5, True), (2, "p", sha("p"), "k", 9, True), (3, "p", sha("q"), "k", 5, True), (4, "p", sha("p"), None, 5, True), (5, None, None, "k", 5, True), (6, "p", sha("p"), "k", 0, True), (7, "p", sha("p"), "k", 5, None)]
    got = assess.replay_verdicts(
        spark.createDataFrame(actions, "action_id long, payload string, payload_digest string, key_id string, time long, signed boolean"),
        spark.createDataFrame([("k",)], "key_id string"), spark.createDataFrame([("k", 1, "VALID"), ("k", 8, "REVOKED")], "key_id string, at long, status string"),
    )
    assert {r.action_id: r.verdict for r in got.collect()} == {1: "GENUINE", 2: "KEY_NOT_VALID_AT_TIME", 3: "DIGEST_MISMATCH", 4: "KEY_UNKNOWN", 5: "DIGEST_MISMATCH", 6: "KEY_NOT_VALID_AT_TIME", 7: "SIGNATURE_INVALID"}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (None, "INVALID"), ("[]", "INVALID"), ('{"schema_id":"s","version":"1","media_type":"m","payload_kind":"rows","fields":{}}', ""),
        ('{"schema_id":"s","version":"1","media_type":"m","payload_kind":"rows","fields":{"a":{"type":"string","enum":["x"],"required":true}}}', ""),
        ('{"schema_id":"s","version":"1","media_type":"m","payload_kind":"rows","fields":{"a":{}}}', "type of a"),
    ],
)
def test_definitions(spark, body, want):
    rows = spark.createDataFrame([(body,)], "body string")
    assert rows.select(F.array_join(assess.definition_problems("body"), "; ")).first()[0] == want


@pytest.mark.parametrize(
    ("body", "value", "repaired", "problem"),
    [
        ('{"a":"\\ud83d"}', '{"a":"\\ufffd"}', True, None), ('{"a":"\\ud83d\\ude00"}', '{"a":"\\ud83d\\ude00"}', False, None), ('{"a":"\\\\ud83d"}', '{"a":"\\\\ud83d"}', False, None),
        ('{"a":"\\ud83d\\ud83d\\ude00\\ude00"}', '{"a":"\\ufffd\\ud83d\\ude00\\ufffd"}', True, None), ('{"a":"\\udc00","a":1}', None, True, "INVALID"), (None, None, None, "INVALID"),
    ],
)
def test_foreign_json(spark, body, value, repaired, problem):
    got = spark.createDataFrame([(body,)], "body string").select(assess.foreign_json("body").alias("f")).select("f.*").first()
    assert (got.value, got.repaired, got.problem) == (value, repaired, problem)
