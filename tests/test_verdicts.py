"""Verdicts on acts by what indicators name."""

from __future__ import annotations

from worldlog.operators import world


def test_an_indicator_names_forecasts_by_rows(spark):
    acts = spark.createDataFrame([(i, f, i, 0.2, "r", "SERVICE", n) for i, (f, n) in enumerate([("f", "i"), ("g", "i"), ("f", "bare"), ("f", "empty"), ("f", "twice")])], "act_id long, forecast_id string, at long, probability double, reason string, actor_kind string, indicator_id string")
    forecasts = spark.createDataFrame([("f", "OPEN"), ("g", "OPEN")], "forecast_id string, status string")
    lists = {"i": ["f", None], "bare": None, "empty": [], "twice": ["f", "f"], "unasked": ["f"]}
    armed = spark.createDataFrame([(n, "FIRED", x, "APPLY_PROBABILITY", 0.2) for n, x in lists.items()], "indicator_id string, status string, forecast_ids array<string>, mode string, target double")
    got = [(r.act_id, r.verdict) for r in world.update_verdict(acts, forecasts, armed).orderBy("act_id").collect()]
    assert got == [(0, "UPDATED"), (1, "NOT_NAMED"), (2, "NOT_NAMED"), (3, "NOT_NAMED"), (4, "UPDATED")]
