"""Rules over a small scene, geometry by cells, and findings of reports sentence by sentence."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from worldlog.operators import rules, sitrep

OBJECT = "object_id long, object_type string, lifecycle string, epistemic_state string, status string, reported_status string, stale boolean, lon double, lat double, line array<array<double>>"


def flat(p, line):
    k = math.radians(1) * 6_371_008.8
    best = math.inf
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        c = k * math.cos(math.radians(p[1]))
        ax, ay, bx, by = (ax - p[0]) * c, (ay - p[1]) * k, (bx - p[0]) * c, (by - p[1]) * k
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if d == 0 else max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / d))
        best = min(best, math.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
    return best


def test_points_near_lines_are_all_found(spark):
    draw = random.Random(3)
    place = lambda: (draw.uniform(-1, 1), draw.uniform(50, 52))
    points = [(i, *place()) for i in range(150)]
    lines = [(1000 + i, [list(place()) for _ in range(draw.randint(2, 5))]) for i in range(40)]
    targets = spark.createDataFrame([(i, "ROUTE", None, None, None, None, None, None, None, line) for i, line in lines], OBJECT)
    for metres in (900.0, 7_000.0):
        got = {(r.id, r.target_id) for r in rules.near_geometries(spark.createDataFrame(points, "id long, lon double, lat double"), targets, metres).collect()}
        want = {(i, j) for i, x, y in points for j, line in lines if flat((x, y), line) <= metres}
        assert got == want
        assert want


def test_rules_of_a_scene(spark):
    rows = [
        (1, "INFRASTRUCTURE", "ACTIVE", "DISPUTED", "OPERATIONAL", None, False, 10.0, 50.0, None), (2, "ROUTE", "ACTIVE", "REPORTED", None, None, False, None, None, [[10.0, 50.0], [10.2, 50.0]]),
        (3, "ROUTE", "ACTIVE", "REPORTED", None, None, False, None, None, [[0.0, 0.0], [0.1, 0.0]]), (4, "MOVEMENT", "ACTIVE", "PLANNED", None, None, False, None, None, None),
        (5, "OBSERVATION", "ACTIVE", "REPORTED", None, "DAMAGED", False, 10.1, 50.001, None), (6, "OBSERVATION", "ACTIVE", "REPORTED", None, "OPERATIONAL", False, None, None, None), (7, "OBSERVATION", "ACTIVE", "REPORTED", None, "UNKNOWN", False, None, None, None),
        (8, "OPERATIONAL_CONCERN", "ACTIVE", "REPORTED", None, None, False, 10.0, 50.2, None), (9, "OPERATIONAL_CONCERN", "CLOSED", "REPORTED", None, None, False, 10.0, 50.0, None), (10, "RESOURCE_STOCK", "ACTIVE", "REPORTED", None, None, True, None, None, None),
        (11, "RESOURCE_STOCK", "ACTIVE", "REPORTED", None, None, False, None, None, None),
    ]
    relations = [("REPORTS_ON", 5, 1), ("REPORTS_ON", 6, 1), ("REPORTS_ON", 7, 1), ("REPORTS_ON", 5, 1), ("DEPENDS_ON", 2, 1), ("PLANNED_FOR", 4, 2), ("ALTERNATE_OF", 3, 2)]
    groups = [("g", 5), ("g", 6), ("g", 99), ("h", 7), ("h", 98)]
    tables = spark.createDataFrame(rows, OBJECT), spark.createDataFrame(relations, "relation_type string, source_id long, target_id long"), spark.createDataFrame(groups, "group_id string, object_id long")
    assert {tuple(r) for r in rules.exposure(*tables[:2]).collect()} == {(2, 1, "DEPENDENCY_DISPUTED"), (2, 5, "PROXIMATE_DISRUPTION")}
    got = {(r.rule, r.kind, r.subject, r.other, r.n) for r in rules.proposals(*tables).collect()}
    assert got == {
        ("infrastructure-conflict", "ALERT", "1", "DAMAGED,OPERATIONAL", 2), ("infrastructure-conflict", "STATE", "1", "DISPUTED", 2), ("reported-disruption", "ALERT", "1", "DAMAGED", 1),
        ("hazard-impact", "ALERT", "8", None, 2), ("hazard-impact", "RELATIONSHIP", "8", "1", 1), ("hazard-impact", "RELATIONSHIP", "8", "2", 1), ("route-exposure", "ASSESSMENT", "2", None, 2),
        ("movement-route-risk", "ALERT", "4", "2", 2), ("movement-route-risk", "RECOMMENDATION", "4", "3", 2), ("stale-stock", "ALERT", "10", None, 1), ("source-dependence", "ALERT", "g", None, 2),
    }
    assert rules.proposals(*(t.limit(0) for t in tables)).count() == 0


def test_quotes(spark):
    text = "0.42 and .5, 42% or 7 % but 1.42, 0.42% and v2.0.3 12345%"
    [[got]] = spark.range(1).select(rules.quoted_probabilities(F.lit(text))).collect()
    import re

    want = [float(m[1]) if m[1] else float(m[2]) / 100 for m in re.finditer(rules.QUOTED, text)]
    assert got == want


def test_findings(spark):
    records = spark.createDataFrame(
        [("semantic_claim", "c1", "REPORTED", "2020-01-01", 1), ("semantic_claim", "c2", "INFERRED", None, 3), ("semantic_claim", "c3", "DISPUTED", "2030-01-01", 0), ("analytic_forecast", "f1", None, None, None), ("analytic_forecast", "f2", None, None, None), ("fabric_manifestation", "m1", None, None, None)],
        "kind string, ref string, epistemic_state string, valid_to string, independent_basis_count long",
    ).withColumn("valid_to", F.to_timestamp_ntz("valid_to"))
    rows = [
        ("s1", "x", "SUPPORTED", "", True, []), ("s2", "x", "SUPPORTED", None, False, None), ("s3", "x", "SUPPORTED", "", False, ["c1"]), ("s4", "x", "SUPPORTED", "HISTORICAL", True, ["c1", "gone", "gone"]), ("s5", "x", "SUPPORTED", "", True, ["c1", "c2"]),
        ("s6", "x", "SUPPORTED", "CURRENT", False, ["c1", "c3"]), ("s7", "0.3 or 40%", "EXPLICITLY_INFERENTIAL", "", False, ["f1", "f2", "c3"]), ("s8", "0.3", "SUPPORTED", "", False, ["f1"]), ("s9", "99%", "EXPLICITLY_INFERENTIAL", "", True, ["f1", "m1"]), ("s10", "7%", "SUPPORTED", "", False, ["m1"]),
    ]
    sentences = spark.createDataFrame(rows, "sentence_id string, text string, status string, temporal_scope string, asserts_independent boolean, basis_refs array<string>")
    states = spark.createDataFrame([("c1", "SUPERSEDED"), ("c2", "CURRENT")], "claim_id string, state string")
    reviews = spark.createDataFrame([("c2",), ("c2",)], "subject_id string")
    forecasts = spark.createDataFrame([("f1", 0.3), ("f1", 0.5), ("f2", 0.4)], "forecast_id string, probability double")
    found = rules.report_findings(sentences, records, states, reviews, forecasts, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert sorted((r.sentence_id, r.code, r.ref or "") for r in found) == sorted(
        [
            ("s1", "NO_EVIDENCE_BASIS", ""), ("s2", "NO_EVIDENCE_BASIS", ""), ("s3", "STALE_BASIS", "c1"), ("s3", "HISTORICAL_AS_CURRENT", ""), ("s4", "STALE_BASIS", "c1"), ("s4", "UNRESOLVABLE_BASIS", "gone"), ("s4", "INDEPENDENCE_MISREPRESENTED", ""),
            ("s5", "STALE_BASIS", "c1"), ("s5", "INFERENCE_AS_OBSERVATION", "c2"), ("s5", "CONTESTED_AS_SETTLED", "c2"), ("s5", "TEMPORAL_SCOPE_REQUIRED", ""), ("s6", "STALE_BASIS", "c1"), ("s6", "CONTESTED_AS_SETTLED", "c3"), ("s6", "PARTIALLY_HISTORICAL_BASIS", ""),
            ("s7", "MULTI_FORECAST_NUMERIC_AMBIGUITY", ""), ("s8", "INFERENCE_AS_OBSERVATION", "f1"), ("s9", "FORECAST_PROBABILITY_MISMATCH", ""),
        ]
    )
    assert {r.code for r in found if not r.blocking} == {"PARTIALLY_HISTORICAL_BASIS", "MULTI_FORECAST_NUMERIC_AMBIGUITY"}


def test_report_in_four_formats(spark, tmp_path):
    rows = [("Routes", "2", "INFERRED", "object <2>", 'a & "b"'), ("Routes", "1", "INFERRED", "object 1", "x" * 90), ("Decisions", "d", "ACCEPTED", "by q", "so")]
    found = spark.createDataFrame(rows, "section string, key string, state string, label string, detail string")
    said = {f: [r.line for r in sitrep.lines(found, f).orderBy("place").collect()] for f in sitrep.FORMATS}
    assert [r for r in said["markdown"] if r][4:8] == ["## Routes", "- **INFERRED** object 1: " + "x" * 90, '- **INFERRED** object <2>: a & "b"', "## Movements"]
    assert said["markdown"].count("- none in this view") == 10
    at = said["text"].index("ROUTES")
    assert said["text"][at + 1] == ("  INFERRED object 1: " + "x" * 90)[:72]
    assert said["text"][at + 3] == "-" * 72
    assert "<li><b>INFERRED</b> object &lt;2&gt;: a &amp; &quot;b&quot;</li>" in said["html"]
    assert said["json"].count('{"section":"Resources","note":"none in this view"}') == 1
    sitrep.written(found, "text", str(tmp_path / "report"))
    files = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == said["text"]
