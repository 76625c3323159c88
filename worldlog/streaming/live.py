"""Streams over the log: watermarks of each source, ingest that records repeats, windows over event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from worldlog.operators.blocks import placed
from worldlog.operators.graph import saved
from worldlog.sources import connectors

MARKED = "seq long, source_id string, source_time timestamp, watermark timestamp, late boolean"


def flag_late(events: DataFrame) -> DataFrame:
    """A stream of seq, source_id, source_time with each source's own watermark and ``late``; nothing is dropped.

    Spark's watermark is one for the whole query, so each source's greatest time is kept as state. A batch's rows of a
    source are put in log order; triggers bound their number (``maxFilesPerTrigger``).
    """

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.NaT
        rows = pd.concat(list(batches)).sort_values("seq")
        before = rows["source_time"].cummax().shift(1)
        rows["watermark"] = before.where(before.notna() & ~(before < top), top) if top is not pd.NaT else before
        rows["late"] = (rows["source_time"] < rows["watermark"]).fillna(False)
        top = max(x for x in (top, rows["source_time"].max()) if x is not pd.NaT)
        state.update((top.value // 1000,))
        yield rows[["seq", "source_id", "source_time", "watermark", "late"]]

    return events.groupBy("source_id").applyInPandasWithState(mark, MARKED, "top long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream yields over the input that is there, as a table in the shared folder."""
    spark = stream.sparkSession
    empty = saved(spark.createDataFrame([], stream.schema), name)  # fixes the shared folder
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{folder}/rows")


def catch_up(spark: SparkSession, path: str, schema: str, out: str, state: str, read: int) -> None:
    """Appends to ``out`` the log lines in ``path`` that no earlier call with this ``state`` has seen, with ``read``.

    Lines that are not readable keep their place and text with the problem; a line without its end waits for it.
    """
    lines = connectors.segment_stream(spark, path)
    rows = lines.select(F.when(F.col("problem").isNull(), F.from_json("line", schema)).alias("e"), "problem", F.when(F.col("problem").isNotNull(), F.col("line")).alias("line"))

    def keep(batch: DataFrame, batch_id: int) -> None:  # a batch that is run again writes its folder again
        batch.select("e.*", "problem", "line").withColumn("read", F.lit(read)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Folders that keys seen are spread over by their hash.
SHARDS = 32


def _table_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; none where there is no such folder. Anything else that is wrong with it is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def ingest_batch(seen_path: str, keys: list[str]):
    """A ``foreachBatch`` function: appends a batch with ``duplicate``, by the keys that the table at ``seen_path`` has.

    A batch that is run again after a loss finds its own rows under its id and writes nothing: effects are exactly once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")
        seen = _table_at(spark, seen_path)
        if seen is None:  # the first batch of all
            known = batch.limit(0).select(*keys).withColumn("_known", F.lit(True))
        elif seen.filter(F.col("batch_id") == batch_id).limit(1).count():
            return
        else:  # the shards of the batch's keys alone are read
            met = [r[0] for r in batch.select(shard).distinct().collect()]  # SHARDS at most
            known = seen.filter(F.col("shard").isin(met)).select(*keys).distinct().withColumn("_known", F.lit(True))
        first = batch.groupBy(*keys).agg(F.min("seq").alias("_first"))
        told = batch.join(first, keys).join(known, keys, "left")
        told.withColumn("duplicate", F.coalesce("_known", F.lit(False)) | (F.col("seq") > F.col("_first"))).withColumn(
            "batch_id", F.lit(batch_id)
        ).withColumn("shard", shard).drop("_known", "_first").write.mode("append").partitionBy("shard").parquet(seen_path)

    return apply


def tumbling(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """source_id, start, n, total for each window of event time; streams close windows by ``watermark``."""
    timed = events.withWatermark("source_time", watermark) if watermark else events
    rows = timed.groupBy("source_id", F.window("source_time", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select("source_id", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """subject, start, n for each run of a subject's events with no gap as long as ``gap``."""
    rows = events.groupBy("subject", F.session_window("source_time", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("subject", F.col("w.start").alias("start"), "n")


#: Indicators without an attribute are matched so many at a time.
FEW_INDICATORS = 10_000


def fired(indicators: DataFrame, observations: DataFrame) -> DataFrame:
    """indicator_id, n, first_seq: PRESENCE indicators and their matches; both times must be later than the arming.

    An empty pattern is a wildcard: indicators are a stated set, matched by attribute where they name one, else in blocks
    of ``FEW_INDICATORS``, each of which is broadcast and counted by itself.
    """
    columns = ["indicator_id", "armed", "least", "seq", "recorded_time", "source_time", "value"]
    counts = lambda met: met.select(*columns).filter("recorded_time > armed AND source_time > armed AND value >= least").groupBy("indicator_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    found = counts(indicators.filter("attribute <> ''").join(observations, "attribute"))
    wild = indicators.filter("attribute = ''").drop("attribute")
    blocks = -(-wild.count() // FEW_INDICATORS)
    if blocks > 1:
        wild = saved(placed(wild, ["indicator_id"], "_place", 0), "wildcards")
    for block in range(blocks):
        few = wild.filter(F.floor(F.col("_place") / FEW_INDICATORS) == block).drop("_place") if blocks > 1 else wild
        found = found.union(counts(observations.join(F.broadcast(few))))
    return found


def absent(indicators: DataFrame, observations: DataFrame, searched: DataFrame) -> DataFrame:
    """indicator_id, verdict of ABSENCE indicators (attribute, least, deadline, source) after their deadline.

    DEFEATED where a match was observed at or before the deadline, arming or not; FIRED where none was and the named
    source was searched after the deadline; BLOCKED without such a search: silence alone proves nothing.
    """
    matches = observations.select("attribute", "value", "source_time")
    hits = indicators.join(matches, "attribute").filter("value >= least AND source_time <= deadline").select("indicator_id").distinct()
    last = searched.groupBy("source").agg(F.max("searched_time").alias("_searched"))
    met = indicators.join(hits.withColumn("_hit", F.lit(True)), "indicator_id", "left").join(last, "source", "left")
    verdict = F.when(F.col("_hit"), "DEFEATED").when(F.col("_searched") > F.col("deadline"), "FIRED").otherwise("BLOCKED")
    return met.select("indicator_id", verdict.alias("verdict"))


def changed_only(previous: DataFrame, current: DataFrame, key: str, components: list[str]) -> DataFrame:
    """Rows of ``current`` that are new or differ from ``previous`` in a component (nulls are values): what to append."""
    was = previous.select(key, F.struct(*components).alias("_was"))
    met = current.join(was, key, "left")
    return met.filter(~F.col("_was").eqNullSafe(F.struct(*components))).drop("_was")
