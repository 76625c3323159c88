"""Timers: watches that fall due, feeds compared poll by poll, forecasts that end at their horizon without a new row.

State is kept for each key; timers follow the stream's watermark. What a stream yields does not depend on how its rows were cut
into batches, as long as no row comes later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from worldlog.streaming.live import run_to_end

# Outcomes of a poll that observed nothing, and how many changes of a kind one poll may tell.
FAILED = ("SOURCE_FAILED", "ACCESS_RESTRICTED", "POLICY_REFUSED")
MOST_CHANGES = 50

CHANGES = "watch_id long, at_ms long, change_type string, ref string"
VERDICTS = "subject long, forecast_id long, verdict string, at_ms long"


def compared(before: dict[str, str] | None, now: dict[str, str], failed: bool) -> list[tuple[str, str]]:
    """(change, ref) of a poll against the poll before it; the first poll is the baseline. A failure is a change by itself."""
    if failed:
        return [("RETRIEVAL_FAILURE", "")]
    if before is None:
        return []
    new = [("NEW_OBJECT", i) for i in sorted(now) if i not in before][:MOST_CHANGES]
    gone = [("DISAPPEARED_OBJECT", i) for i in sorted(before) if i not in now][:MOST_CHANGES]
    return new + gone + [("CHANGED_SOURCE_RECORD", i) for i in sorted(now) if before.get(i) and now[i] and now[i] != before[i]]


class Watches(StatefulProcessor):
    """Polls of watches: their changes, and DUE at each time at which a watch should have run and had not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "due long, told boolean")
        self.records = handle.getListState("records", "id string, stated string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, told, records = 0, True, None
        if self.last.exists():
            due, told = self.last.get()
            records = dict(self.records.get())
        for r in sorted(rows, key=lambda r: (r["run_ms"], r["seq"])):
            if not told and r["run_ms"] > due:
                yield Row(watch_id=key[0], at_ms=due, change_type="DUE", ref="")
            failed = r["outcome"] in FAILED
            now = {} if failed else dict(r["records"] or {})
            for change, ref in compared(records, now, failed):
                yield Row(watch_id=key[0], at_ms=r["run_ms"], change_type=change, ref=ref)
            due, told, records = r["run_ms"] + 1000 * r["cadence_s"], False, now
        self.last.update((due, told))
        self.records.clear()
        if records:
            self.records.put(list(records.items()))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, told = self.last.get()
        # a run since then has moved the due time on
        if not told and due <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((due, True))
            yield Row(watch_id=key[0], at_ms=due, change_type="DUE", ref="")

    def close(self) -> None:
        pass


class Horizons(StatefulProcessor):
    """Forecasts of a subject and what bears them out: TRUE at the first match up to the horizon, FALSE_BY_ABSENCE at the horizon.

    Each call to the store is a message of its own, so a subject has one timer, for the earliest horizon of what a batch leaves
    open; when it comes, all that the watermark has passed is told, and the next one is set.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "forecast_id long, horizon long")

    def _keep(self, before: dict[int, int], waiting: dict[int, int]) -> None:
        if waiting == before:
            return
        if not waiting:
            self.open.clear()
            return
        self.open.put(list(waiting.items()))
        first = min(waiting.values())
        if not before or first != min(before.values()):
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = dict(self.open.get())
        waiting = dict(before)
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["seq"])):
            yield from self._passed(key, waiting, r["at_ms"] - 1)
            if r["kind"] == "MATCH":
                for i in sorted(waiting):
                    yield Row(subject=key[0], forecast_id=i, verdict="TRUE", at_ms=r["at_ms"])
                waiting.clear()
            else:
                waiting[r["seq"]] = r["horizon_ms"]
        self._keep(before, waiting)

    @staticmethod
    def _passed(key, waiting: dict[int, int], now: int) -> Iterator[Row]:
        for i, horizon in sorted(waiting.items()):
            if horizon <= now:
                del waiting[i]
                yield Row(subject=key[0], forecast_id=i, verdict="FALSE_BY_ABSENCE", at_ms=horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = dict(self.open.get())
        waiting = dict(before)
        # rows up to the watermark have been seen, whichever horizon this timer stood for
        yield from self._passed(key, waiting, timerValues.getCurrentWatermarkInMs())
        self._keep(before, waiting)

    def close(self) -> None:
        pass


def _with_state(spark: SparkSession) -> None:
    """Timers need the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watch_changes(polls: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of ``CHANGES`` from a stream of polls: watch_id, seq, run_time, cadence_s, outcome, records (id to source time)."""
    _with_state(polls.sparkSession)
    timed = polls.withWatermark("run_time", delay).withColumn("run_ms", F.unix_millis("run_time"))
    return timed.groupBy("watch_id").transformWithState(Watches(), CHANGES, "append", "eventTime")


def horizon_verdicts(acts: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of ``VERDICTS`` from a stream of acts: subject, seq, at, kind (POSED or MATCH), horizon (of posed ones)."""
    _with_state(acts.sparkSession)
    timed = acts.withWatermark("at", delay).withColumns({"at_ms": F.unix_millis("at"), "horizon_ms": F.unix_millis("horizon")})
    return timed.groupBy("subject").transformWithState(Horizons(), VERDICTS, "append", "eventTime")


def interval_matches(left: DataFrame, right: DataFrame, key: str, within: str, delay: str) -> DataFrame:
    """A stream of pairs of two streams' rows (key, at, id) of one key: a right row up to ``within`` after the left one.

    Both have watermarks, so that state is let go once no partner can come.
    """
    a = left.withWatermark("at", delay).select(F.col(key).alias(key), F.col("at").alias("left_at"), F.col("id").alias("left_id"))
    b = right.withWatermark("at", delay).select(F.col(key).alias("_key"), F.col("at").alias("right_at"), F.col("id").alias("right_id"))
    on = (F.col(key) == F.col("_key")) & (F.col("right_at") > F.col("left_at")) & F.expr(f"right_at <= left_at + INTERVAL {within}")
    return a.join(b, on).select(key, "left_id", "right_id", "left_at", "right_at")


def sliding(events: DataFrame, width: str, slide: str, delay: str | None = None) -> DataFrame:
    """source_id, start, n, total of windows of ``width`` that begin every ``slide``; a row counts in each that it falls in."""
    timed = events.withWatermark("source_time", delay) if delay else events
    rows = timed.groupBy("source_id", F.window("source_time", width, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select("source_id", F.col("w.start").alias("start"), "n", "total")


__all__ = ["CHANGES", "VERDICTS", "compared", "horizon_verdicts", "interval_matches", "run_to_end", "sliding", "watch_changes"]
