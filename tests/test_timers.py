"""Timers, stream joins and typed paths: cut into batches anyhow, restarted, against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from worldlog.operators import graph
from worldlog.streaming import timers

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def fed(spark, tmp_path, schema, batches, made):
    """What a stream yields whose rows come in batches, the query stopped and started again after each."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run(made(stream), out, state)
    return spark.read.parquet(out).collect()


def at(minutes):
    return START + timedelta(minutes=minutes)


def ms(minutes):
    return int(at(minutes).timestamp() * 1000)


def cut(rows, n):
    draw = random.Random(n)
    places = sorted(draw.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *places], [*places, len(rows)], strict=True)]


@pytest.mark.parametrize("n", [1, 5])
def test_watches(spark, tmp_path, n):
    draw, polls, state = random.Random(3), [], {}
    want = []
    for seq in range(120):
        watch, minute = draw.randrange(4), seq * 7
        failed, records = draw.random() < 0.2, {f"r{i}": f"t{draw.randrange(2)}" for i in range(4) if draw.random() < 0.6}
        polls.append((watch, seq, at(minute), 60 * 25, "SOURCE_FAILED" if failed else "EXECUTED_WITH_RESULTS", records))
        before = state.get(watch)
        if before and before[0] < minute:
            want.append((watch, ms(before[0]), "DUE", ""))
        want += [(watch, ms(minute), c, r) for c, r in timers.compared(before[1] if before else None, {} if failed else records, failed)]
        state[watch] = (minute + 25, {} if failed else records)
    last = 119 * 7
    want += [(w, ms(due), "DUE", "") for w, (due, _) in state.items() if due <= last]
    schema = "watch_id long, seq long, run_time timestamp, cadence_s long, outcome string, records map<string,string>"
    got = fed(spark, tmp_path, schema, cut(polls, n), timers.watch_changes)
    assert sorted((r.watch_id, r.at_ms, r.change_type, r.ref) for r in got) == sorted(want)


def test_a_poll_compared():
    assert timers.compared(None, {"a": "1"}, False) == []
    assert timers.compared(None, {}, True) == [("RETRIEVAL_FAILURE", "")]
    assert timers.compared({"a": "1", "b": "", "c": "2"}, {"a": "2", "b": "1", "d": "x"}, False) == [("NEW_OBJECT", "d"), ("DISAPPEARED_OBJECT", "c"), ("CHANGED_SOURCE_RECORD", "a")]
    assert len(timers.compared({}, {str(i): "" for i in range(99)}, False)) == timers.MOST_CHANGES


@pytest.mark.parametrize("n", [1, 4])
def test_horizons(spark, tmp_path, n):
    draw, acts = random.Random(5), []
    for seq in range(80):
        posed = draw.random() < 0.7
        acts.append((draw.randrange(3), seq, at(seq * 5), "POSED" if posed else "MATCH", at(seq * 5 + 31) if posed else None))
    want = []
    for subject, seq, when, kind, horizon in acts:
        if kind == "POSED":
            hit = min((a[2] for a in acts if a[0] == subject and a[3] == "MATCH" and when < a[2] <= horizon), default=None)
            if hit or horizon <= acts[-1][2]:
                want.append((subject, seq, "TRUE" if hit else "FALSE_BY_ABSENCE", int((hit or horizon).timestamp() * 1000)))
    got = fed(spark, tmp_path, "subject long, seq long, at timestamp, kind string, horizon timestamp", cut(acts, n), timers.horizon_verdicts)
    assert sorted(tuple(r) for r in got) == sorted(want)


class Store:
    """A subject's state and timers, and how often they are asked."""

    def __init__(self):
        self.rows, self.timers, self.asked = [], set(), 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.asked += 1
        return bool(self.rows)

    def get(self):
        self.asked += 1
        return iter(self.rows)

    def put(self, rows):
        self.asked, self.rows = self.asked + 1, rows

    def clear(self):
        self.asked, self.rows = self.asked + 1, []

    def registerTimer(self, at_ms):
        self.asked += 1
        self.timers.add(at_ms)


def test_a_subject_asks_the_store_a_few_times(spark):
    store, told = Store(), timers.Horizons()
    told.init(store)
    posed = [{"at_ms": i, "seq": i, "kind": "POSED", "horizon_ms": i + 50} for i in range(100)]
    got = list(told.handleInputRows((7,), iter(posed), TimerValues(0, -1)))
    assert [(r.forecast_id, r.at_ms) for r in got] == [(i, i + 50) for i in range(49)]
    assert store.timers == {99} and store.asked == 3
    # the watermark has passed two more horizons than the timer's own
    got = list(told.handleExpiredTimer((7,), TimerValues(0, 101), ExpiredTimerInfo(99)))
    assert [(r.forecast_id, r.at_ms, r.verdict) for r in got] == [(i, i + 50, "FALSE_BY_ABSENCE") for i in (49, 50, 51)]
    assert store.timers == {99, 102} and store.asked == 6
    got = list(told.handleInputRows((7,), iter([{"at_ms": 102, "seq": 200, "kind": "MATCH", "horizon_ms": None}]), TimerValues(0, 101)))
    assert [(r.forecast_id, r.verdict) for r in got] == [(i, "TRUE") for i in range(52, 100)] and store.rows == []
    # a timer that nothing waits for any more, and a subject of whom nothing stays open, leave nothing behind
    assert list(told.handleExpiredTimer((7,), TimerValues(0, 102), ExpiredTimerInfo(102))) == []
    assert store.asked == 9


def test_stream_join_is_the_batch_join(spark, tmp_path):
    draw = random.Random(7)
    rows = [[(draw.randrange(3), at(i * 4 + side), i) for i in range(60)] for side in (0, 1)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in range(3):
        for side in (0, 1):
            spark.createDataFrame(rows[side][part * 20 : part * 20 + 20], "k long, at timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{side}"))
        left, right = (spark.readStream.schema("k long, at timestamp, id long").parquet(str(tmp_path / f"in{side}")) for side in (0, 1))
        run(timers.interval_matches(left, right, "k", "30 MINUTES", "10 minutes"), out, state)
    want = sorted((a[2], b[2]) for a in rows[0] for b in rows[1] if a[0] == b[0] and a[1] < b[1] <= a[1] + timedelta(minutes=30))
    assert sorted((r.left_id, r.right_id) for r in spark.read.parquet(out).collect()) == want


def test_typed_paths_against_a_plain_search(spark):
    draw = random.Random(9)
    edges = [(f"r{i:03}", f"n{draw.randrange(30)}", f"n{draw.randrange(30)}", draw.choice("ABC"), draw.choice(["ACTIVE", "ACTIVE", "ENDED"])) for i in range(90)] + [("r999", "n1", None, "A", "ACTIVE"), ("r000", "n0", "n0", "A", "ACTIVE")]
    wanted = [(f"n{i}", f"n{j}") for i in range(0, 30, 4) for j in range(30)] + [("n0", "far"), ("far", "n0")]
    ways: dict[str, list] = {}
    for r, a, b, t, s in edges:
        if s == "ACTIVE" and t in "AB" and b and a != b:
            ways.setdefault(a, []).append((r, t, b))
            ways.setdefault(b, []).append((r, t, a))
    want = set()
    for seed, target in set(wanted):
        layers, seen = [{seed: None}], {seed}
        for _ in range(3):
            new: dict = {}
            for node in layers[-1]:
                for r, t, b in ways.get(node, ()):
                    if b not in seen:
                        new[b] = min(new.get(b, (r, node, t)), (r, node, t))
            seen |= set(new)
            layers.append(new)
        at_, end = next((i for i, layer in enumerate(layers) if target in layer), 0), target
        while at_:
            r, before, t = layers[at_][end]
            want.add((seed, target, at_, before, r, t, end))
            at_, end = at_ - 1, before
    table = spark.createDataFrame(edges, "relation_id string, src string, dst string, relation_type string, status string")
    got = graph.typed_paths(table, spark.createDataFrame(wanted + wanted[:3], "seed string, target string"), ["A", "B"]).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)
    assert graph.typed_paths(table.limit(0), spark.createDataFrame(wanted, "seed string, target string"), ["A"]).count() == 0
