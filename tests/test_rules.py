"""Rules at their edges: values that the queries over tables do not reach."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from worldlog.functions import scalar
from worldlog.operators import access, evidence, graph, log, versions, views
from worldlog.plans import state
from worldlog.sources import feeds
from worldlog.streaming import live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scores_and_bands(spark):
    assert value(spark, scalar.brier(F.lit(0.7), F.lit(True))) == pytest.approx(0.09)
    assert value(spark, scalar.brier(F.lit(0.7), F.lit(False))) == pytest.approx(0.49)
    for p, band in ((0.05, "REMOTE"), (0.15, "POSSIBLE"), (0.62, "LIKELY"), (0.75, "VERY_LIKELY"), (0.80, "VERY_LIKELY")):
        assert value(spark, scalar.probability_band(F.lit(p))) == band
    for hours, label in ((0, "PASSED"), (72, "IMMINENT"), (336, "CLOSE"), (1440, "NEAR"), (1441, "DISTANT")):
        assert value(spark, scalar.time_pressure(F.lit(hours))) == label
    assert value(spark, scalar.evidence_confidence(F.lit(2), F.lit(1))) == "WEAK"
    assert value(spark, scalar.evidence_confidence(F.lit(1), F.lit(3))) == "NONE"


@pytest.mark.parametrize(
    ("band", "consequence", "pressure", "confidence", "tier"),
    [
        ("LIKELY", "CRITICAL", "NEAR", "STRONG", "CRITICAL"),
        ("POSSIBLE", "HIGH", "IMMINENT", "STRONG", "PRIORITY"),
        ("VERY_LIKELY", "CRITICAL", "NEAR", "WEAK", "PRIORITY"),
        ("VERY_LIKELY", "CRITICAL", "IMMINENT", "STRONG", "CRITICAL"),
        ("POSSIBLE", "HIGH", "PASSED", "STRONG", "ATTENTION"),
        ("POSSIBLE", "UNLISTED", "NEAR", "STRONG", None),
    ],
)
def test_warning_tier(spark, band, consequence, pressure, confidence, tier):
    assert value(spark, scalar.warning_tier(*map(F.lit, (band, consequence, pressure, confidence)))) == tier


def test_calibration_literals(spark):
    rows = spark.createDataFrame([(0.62, True), (0.65, False), (0.05, False)], "probability double, outcome boolean")
    buckets = {r.bucket: r for r in evidence.reliability(rows).collect()}
    assert len(buckets) == 10
    assert (buckets[6].n, round(buckets[6].mean_probability, 4), buckets[6].observed_rate) == (2, 0.635, 0.5)
    assert buckets[3].n == 0
    assert evidence.calibration_error(rows).first().ece == pytest.approx(2 / 3 * 0.135 + 1 / 3 * 0.05)
    assert evidence.calibration_error(rows.limit(0)).first().ece is None


def test_times_and_places(spark):
    assert value(spark, scalar.instant(F.lit("2024-01-01T00:00:00"))) is None
    assert str(value(spark, scalar.instant(F.lit("2024-01-01T02:00:00+02:00")))) == "2024-01-01 00:00:00"
    assert str(value(spark, scalar.instant_or_utc(F.lit("2024-01-01T00:00:00")))) == "2024-01-01 00:00:00"
    assert str(value(spark, scalar.archive_stamp(F.lit("20240102030405")))) == "2024-01-02 03:04:05"
    assert str(value(spark, scalar.mail_time(F.lit("Tue, 02 Jan 2024 03:04:05 +0000")))) == "2024-01-02 03:04:05"
    assert value(spark, scalar.haversine_m(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))) == pytest.approx(111_195, rel=1e-4)
    assert value(spark, scalar.url_key(F.lit("https://www.Example.org/a/"))) == "example.org/a"
    assert value(spark, scalar.url_key(F.lit("example.org"))) == "example.org/"
    assert tuple(value(spark, scalar.subject_parts(F.lit("LEI:A:1")))) == ("LEI", "A:1")
    assert tuple(value(spark, scalar.subject_parts(F.lit("plain")))) == (None, "plain")


def test_contradictions(spark):
    test = lambda a, b: value(spark, scalar.contradicts(F.lit(a), F.lit(b)))
    assert not test("100", "81")
    assert test("100", "79")
    assert not test("UNKNOWN", "5")
    assert not test(None, "x")
    assert test("open", "shut")


MARKS = [
    ("A", [], ["X"], "OBSERVER"), ("A", ["C"], ["X", "Y"], "ANALYST"), ("B", ["D"], ["Y"], "OBSERVER"), ("A", [], [], "OBSERVER"),
    ("B", [], [], "SUPERVISOR"), ("A", ["C", "D"], ["X"], "UNHEARD"), ("", [], [], "OBSERVER"), ("A", ["C"], [], "OBSERVER"),
]
CONTEXTS = [
    access.Context("A", (), ("X",), "OBSERVER"), access.Context("A", ("C", "D"), ("X", "Y"), "SUPERVISOR"),
    access.Context("B", ("D",), ("Y",), "ANALYST"), access.Context("", (), (), "SUPERVISOR"),
]


def admits(mark, c):
    owner, comps, rel, role = mark
    if role not in access.ROLES or access.ROLES.index(role) > access.ROLES.index(c.role) or not set(comps) <= set(c.compartments):
        return False
    return bool(set(rel) & set(c.releasability)) if rel else bool(owner) and owner == c.organisation


def test_who_sees_a_derived_row_sees_its_sources(spark):
    schema = "pair string, ord int, owning_authority string, compartments array<string>, releasability array<string>, min_role string"
    pairs = [(i, j) for i in range(len(MARKS)) for j in range(len(MARKS)) if "UNHEARD" not in (MARKS[i][3], MARKS[j][3])]
    rows = spark.createDataFrame([(f"{i}/{j}", k, *MARKS[x]) for i, j in pairs for k, x in enumerate((i, j))], schema)
    joined = access.joined_markings(rows, "pair").persist()
    for c in CONTEXTS:
        seen = {r.ord for r in spark.createDataFrame([("p", i, *m) for i, m in enumerate(MARKS)], schema).filter(access.can_view(c)).collect()}
        assert seen == {i for i, m in enumerate(MARKS) if admits(m, c)}
        for r in joined.filter("NOT sealed").filter(access.can_view(c)).collect():
            i, j = map(int, r.pair.split("/"))
            assert admits(MARKS[i], c) and admits(MARKS[j], c)


def test_quality_and_freshness(spark):
    quality = F.create_map(*map(F.lit, ("a", "0.4", "b", "UNKNOWN", "c", "0.9", "d", "UNREVIEWED", "e", "fine")))
    assert value(spark, versions.weak_dimensions(quality, F.lit("STALE"))) == ["a", "b", "d", "freshness"]
    assert value(spark, versions.weak_dimensions(quality, F.lit("FRESH"))) == ["a", "b", "d"]
    assert value(spark, versions.freshness(F.lit(None).cast("timestamp_ntz"), "2024-01-01 00:00:00"))["state"] == "UNKNOWN"


def test_late_rows_are_strictly_below_the_watermark_of_their_source(spark):
    rows = [(1, "a", 5), (2, "a", 5), (3, "a", 4), (4, "b", 1), (5, "a", 9), (6, "b", 0)]
    events = spark.createDataFrame(rows, "seq long, source_id string, source_time int")
    got = {r.seq: (r.watermark, r.late) for r in log.blocked_watermarks(events, 2).collect()}
    assert got == {1: (None, False), 2: (5, False), 3: (5, True), 4: (None, False), 5: (5, False), 6: (1, True)}


def test_time_order_sorts_no_whole_source(spark):
    plan = state.w05_time_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    # one over a source's blocks, one over the rows of each block
    assert len(windows) == 2
    assert all("_block" in x for x in windows)


def test_field_errors_and_quarantine(spark):
    rows = spark.createDataFrame([("1", "x", "true"), (None, "2", "maybe"), ("NaN", "3", None)], "n string, i string, b string")
    good, bad = log.admitted(rows, log.field_errors([("n", "number", True), ("i", "integer", True), ("b", "boolean", False)]))
    assert good.count() == 0
    assert [r.reasons for r in bad.collect()] == [["i is no integer"], ["missing n", "b is no boolean"], ["n is no number"]]


def test_components_of_a_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0}
    assert (got[100], got[200], got[201]) == (100, 200, 200)


def test_dependents_of_a_cycle_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "src long, dst long")
    got = graph.dependents(edges, spark.createDataFrame([(1,)], "node long"))
    assert {r.node for r in got.collect()} == {2, 3, 4}


def test_near_points_at_poles_and_the_date_line(spark):
    points = spark.createDataFrame([(1, 179.99, 0.0), (2, -179.99, 0.0), (3, 0.0, 89.99), (4, 179.0, 89.99), (5, 50.0, 50.0)], "id long, lon double, lat double")
    got = evidence.within_distance(points, points, 5_000.0).filter("id < place_id")
    assert {(r.id, r.place_id) for r in got.collect()} == {(1, 2), (3, 4)}


def test_feeds(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "log").mkdir()
    (folder / "log/a.jsonl").write_text('{"seq":1,"x":"a"}\n\n{"seq":2}\r\n{"seq":\n{"seq":3,"x":"b"}\n')
    lines = feeds.log_lines(spark, str(folder / "log"))
    assert [r.problem for r in lines.collect()] == [None, "EMPTY_LINE", "CARRIAGE_RETURN", "TORN_OR_INVALID", None]
    assert [(r.seq, r.x) for r in feeds.events(spark, str(folder / "log"), "seq long, x string").collect()] == [(1, "a"), (3, "b")]
    (folder / "t.csv").write_text("a,n,b\n1,2.5,yes\n2,oops,no\n,,\n")
    got = feeds.csv_rows(spark, str(folder / "t.csv"), {"n": "number", "b": "boolean"}).collect()
    assert [(r.n, r.b, r.bad_fields) for r in got] == [(2.5, True, []), (None, False, ["n"]), (None, None, [])]
    shape = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"k": 1}}, {"geometry": {"type": "Point", "coordinates": [1, 99]}}]})
    geo = feeds.geojson_features(spark.createDataFrame([(1, shape), (2, "{}")], "id long, body string"), "id", "body").collect()
    assert [(r.id, r.lon, r.problem) for r in geo] == [(1, 1.0, None), (1, 1.0, "OUT_OF_BOUNDS"), (2, None, "NOT_A_COLLECTION")]
    rss = "<rss><channel><item><guid>g1</guid><title>T</title></item><item><link>http://l</link></item><item><title>none</title></item></channel></rss>"
    items = feeds.feed_items(spark.createDataFrame([(1, rss), (2, "<!DOCTYPE x><rss/>")], "id long, body string"), "id", "body").collect()
    assert [(r.id, r.native_id, r.problem) for r in items] == [(1, "g1", None), (1, "http://l", None), (1, None, "NO_NATIVE_ID"), (2, None, "DTD_REFUSED")]


def test_stream_equals_batch_over_several_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, "ab"[i % 2], 1_700_000_000 + (i * 37) % 50) for i in range(60)]
    events = spark.createDataFrame(rows, "seq long, source_id string, s long").select("seq", "source_id", F.timestamp_seconds("s").alias("source_time"))
    for part in range(3):
        events.filter(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(folder)
    stream = live.stream_of(spark, folder, "seq long, source_id string, source_time timestamp", files=1)
    got = {(r.seq, r.late) for r in live.run_to_end(live.flag_late(stream), "late").collect()}
    assert got == {(r.seq, r.late) for r in log.blocked_watermarks(events, 16).collect()}


def test_ingest_records_repeats_once(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/seen"
    apply = live.ingest_batch(path, ["key"])
    schema = "seq long, key string"
    apply(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema), 0)
    apply(spark.createDataFrame([(4, "b"), (5, "c")], schema), 1)
    apply(spark.createDataFrame([(4, "b"), (5, "c")], schema), 1)  # run again after a loss
    got = sorted((r.seq, r.duplicate) for r in spark.read.parquet(path).collect())
    assert got == [(1, False), (2, True), (3, False), (4, True), (5, False)]


def test_nobody_sees_a_sealed_row(spark):
    schema = "pair string, ord int, owning_authority string, compartments array<string>, releasability array<string>, min_role string"
    rows = [(f"{i}/{j}", k, *MARKS[x]) for i in range(len(MARKS)) for j in range(len(MARKS)) for k, x in enumerate((i, j))]
    joined = access.joined_markings(spark.createDataFrame(rows, schema), "pair").filter("sealed").persist()
    assert joined.count() > 5
    for owner in ("A", "B", ""):
        everything = access.Context(owner, ("C", "D"), ("X", "Y"), "SUPERVISOR")
        assert joined.filter(access.can_view(everything)).count() == 0
    with pytest.raises(ValueError, match="sealed"):
        access.Context("A", (access.SEALED_COMPARTMENT,))


def test_redaction_of_short_forms_and_texts_without_ids(spark):
    long_, other = "doc-" + "a1b2c3d4e5f60718293a4b5c", "doc-" + "a1b2c3d4e5f6ffffffffffff"
    rows = [(1, f"see {long_}, {long_[:24]}@v3 and {long_[:18]}."), (2, "nothing here"), (3, f"{long_[:16]} is not one id's alone"), (4, "doc-7 doc-8"), (5, "")]
    hidden = spark.createDataFrame([(long_,), (other,), ("doc-7",), ("doc-7",)], "id string")
    got = {r.k: r.t for r in views.redacted(spark.createDataFrame(rows, "k int, t string"), "k", "t", hidden).collect()}
    assert got == {1: "see REDACTED, REDACTED and REDACTED.", 2: "nothing here", 3: f"{long_[:16]} is not one id's alone", 4: "REDACTED doc-8", 5: ""}


def test_key_status_at_equal_times(spark):
    keys = spark.createDataFrame([("k", 5, 1, "VALID"), ("k", 5, 2, "REVOKED"), ("k", 9, 3, "VALID")], "key_id string, status_time int, seq int, status string")
    uses = spark.createDataFrame([(1, "k", 4), (2, "k", 5), (3, "k", 9), (4, "z", 9)], "use_id int, key_id string, at int")
    assert {r.use_id: r.status for r in views.key_status(uses, keys).collect()} == {2: "REVOKED", 3: "VALID"}


def test_json_leaves_of_any_depth(spark):
    deep = "x"
    for _ in range(40):
        deep = f'{{"k":[{deep}]}}' if deep != "x" else '{"z":1.50,"a":null}'
    rows = spark.createDataFrame([(1, deep), (2, "torn{"), (3, "[true,{}]"), (4, None)], "id long, body string")
    got = [(r.id, r.path, r.value) for r in feeds.json_fields(rows, "id", "body").collect()]
    stem = "$" + ".k[0]" * 39
    assert sorted(got) == [(1, f"{stem}.a", ""), (1, f"{stem}.z", "1.50"), (3, "$[0]", "true")]


def test_a_broken_table_of_seen_keys_is_no_first_batch(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/seen"
    spark.createDataFrame([(1,)], "other long").write.parquet(path)
    with pytest.raises(Exception, match="batch_id"):
        live.ingest_batch(path, ["key"])(spark.createDataFrame([(1, "a")], "seq long, key string"), 0)


def test_folding_decomposes(spark):
    assert value(spark, views.folded(F.lit("Őşžé ﬀ ß ø Ǻ é"))) == "Osze ﬀ ss ø A e"
