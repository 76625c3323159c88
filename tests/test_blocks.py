"""Points and geometries that meet in blocks: counts and pairs, whatever repeats and however small the blocks, and nothing written for each pair."""

from __future__ import annotations

import math
import random

import pytest

from worldlog import plans
from worldlog.operators import graph, near, rules

SF = "/root/testdata/sf0.001"
R = 6_371_008.8


def sphere(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1, h)))


def flat(p, line):
    k, c, best = math.radians(1) * R, math.cos(math.radians(p[1])), math.inf
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        ax, ay, bx, by = (ax - p[0]) * k * c, (ay - p[1]) * k, (bx - p[0]) * k * c, (by - p[1]) * k
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if d == 0 else max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / d))
        best = min(best, math.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
    return best


@pytest.mark.parametrize("repeat", [False, True])
def test_blocks_against_all_pairs(spark, monkeypatch, repeat):
    for name, small in (("POINTS", 7), ("SHAPES", 5), ("TASK_PAIRS", 900), ("STEP", 30)):
        monkeypatch.setattr(near, name, small)
    draw = random.Random(9)
    place = lambda: (draw.uniform(-0.2, 0.2), draw.uniform(50, 50.2))
    points = [(f"p{i}", *place()) for i in range(90)] + [("e", 179.99, 50.0), ("none", None, 50.0), ("twin", 0.0, 50.1), ("like", 0.0, 50.1)]
    targets = [(i, *place(), None) for i in range(40)] + [(100 + i, None, None, [list(place()) for _ in range(draw.randint(2, 4))]) for i in range(30)]
    targets += [(200, -179.995, 50.0, None), (201, None, None, None), (202, None, None, [[0.0, 50.1], [0.0, 50.1]])]
    if repeat:
        points += [("p1", *place()), ("p1", 0.0, 50.1), ("twin", 0.0, 50.1)]
        targets += [(3, *place(), None), (100, None, None, [list(place()), list(place())]), (202, 0.1, 50.1, None)]
    frames = spark.createDataFrame(points, "id string, lon double, lat double"), spark.createDataFrame(targets, "object_id long, lon double, lat double, line array<array<double>>")
    metres = 5_000.0
    want = {(p, t) for p, *a in points if a[0] is not None for t, x, y, line in targets if (flat(a, line) if line else sphere(a, (x, y)) if x is not None else math.inf) <= metres}
    assert {("e", 200), ("twin", 202), ("like", 202)} < want
    assert sorted(map(tuple, near.pairs(*frames, metres).collect())) == sorted(want)
    for k, by in enumerate(("id", "target_id")):
        assert {tuple(r) for r in near.counts(*frames, metres, by).collect()} == {(x, sum(pair[k] == x for pair in want)) for x in {pair[k] for pair in want}}


def test_no_points_meet_nothing(spark):
    points, targets = spark.createDataFrame([], "id long, lon double, lat double"), spark.createDataFrame([(1, 0.0, 0.0, None)], "object_id long, lon double, lat double, line array<array<double>>")
    assert near.pairs(points, targets, 10.0).count() == near.counts(points, targets, 10.0).count() == 0


def test_exposure_is_counted_as_it_is_told(spark):
    objects, relations, _ = plans.findings._scene(spark, SF)
    told = rules.exposure(objects, relations, 20_000.0).groupBy("route_id").count()
    want = {tuple(r) for r in told.collect()}
    assert want and {tuple(r) for r in rules.exposure_counts(objects, relations, 20_000.0).collect()} == want


def _written(monkeypatch, build):
    """Labels, columns and plans of what is written while a query is put together."""
    seen = []

    def watched(df, label, kept=graph.saved):
        seen.append((label, df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, label)

    for module in (graph, near, rules):
        monkeypatch.setattr(module, "saved", watched, raising=False)
    return build(), seen


def test_report_lines_write_no_exposed_pairs(spark, monkeypatch):
    _, seen = _written(monkeypatch, lambda: plans.QUERIES["s24_report_lines"](spark, SF))
    assert [columns for label, columns, _ in seen if label == "exposure"] == [["route_id", "n"]]


def test_six_rules_write_no_pairs_of_hazards(spark, monkeypatch):
    df, seen = _written(monkeypatch, lambda: plans.QUERIES["q07_six_rules"](spark, SF))
    assert not [label for label, *_ in seen if label == "hazards"]
    # told as they leave their block: no pair is shuffled, nor written to be counted
    pairs = df.filter("kind = 'RELATIONSHIP'")._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.split("\n")[1].lstrip(":+- ").startswith("MapInArrow") and "Aggregate" not in pairs.split("MapInArrow")[0]


def test_report_items_count_hazards_in_blocks(spark, monkeypatch):
    _, seen = _written(monkeypatch, lambda: plans.QUERIES["q10_report_items"](spark, SF))
    [proposals] = [plan for label, _, plan in seen if label == "proposals"]
    assert "MapInArrow" in proposals and "HYPOT" not in proposals.upper()
