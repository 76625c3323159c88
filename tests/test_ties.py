"""Rows that a tie rule leaves equal."""

from __future__ import annotations

from datetime import datetime

from worldlog.operators import versions


def test_equal_points_and_versions_go_to_the_first_recorded(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [("o", 9, 1, None, day(5), day(6)), ("o", 3, 1, day(5), None, day(7)), ("o", 4, 1, None, day(5), day(6)), ("o", 1, 0, day(5), None, day(1))]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        table = spark.createDataFrame(order, "object_id string, seq long, version long, valid_from timestamp_ntz, source_time timestamp_ntz, recorded_time timestamp_ntz").coalesce(1)
        got = versions.current_by_valid_point(table)
        assert got.columns == table.columns and [r.seq for r in got.collect()] == [4]
