"""Points near geometries: each pair once, whatever repeats, and without a shuffle of pairs."""

from __future__ import annotations

from worldlog.operators import rules


def test_pairs_are_made_once_and_not_shuffled(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.001), (2, 0.0, 0.2), (3, 179.9999, 10.0), (4, None, 0.0)], "id long, lon double, lat double")
    line = [[-0.01, 0.002], [0.01, 0.002]]
    targets = spark.createDataFrame([(7, None, None, line), (8, 0.0, 0.003, None), (9, -179.9999, 10.0, None), (9, 5.0, 5.0, None), (5, None, None, None)], "object_id long, lon double, lat double, line array<array<double>>")
    found = rules.near_geometries(points, targets, 500.0)
    assert sorted((r.id, r.target_id, round(r.metres)) for r in found.collect()) == [(1, 7, 222), (1, 8, 334), (2, 7, 111), (2, 8, 222), (3, 9, 22)]
    # the first branch is that of ids that are told once: its join is not grouped again
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[1].lstrip(":+- ").startswith(("Project", "Filter", "Join"))
