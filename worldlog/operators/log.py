"""The append-only log: its chain, its order, late rows, repeated deliveries and quarantined payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldlog.operators.blocks import previous

GENESIS = "0" * 64


def entry_hash(*parts: str) -> Column:
    """The hash of an entry's canonical text: its parts joined by ``|``."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def broken_links(entries: DataFrame, log_key: str, parts: list[str]) -> DataFrame:
    """Rows of each log whose own hash is not that of their content, or whose prev_hash is not the entry before's.

    Rows are hashed each for itself; only hashes and numbers are ordered, in ranges: a log of any length is linked by many
    tasks, and their ends with each other.
    """
    thin = entries.select(log_key, "seq", "prev_hash", "entry_hash", (F.col("entry_hash") == entry_hash(*parts)).alias("own_ok"))
    linked = previous(thin, [log_key], ["seq"], ["entry_hash"])
    link_ok = F.col("prev_hash") == F.coalesce("before.entry_hash", F.lit(GENESIS))
    return linked.withColumn("link_ok", link_ok).filter("NOT own_ok OR NOT link_ok").select(log_key, "seq", "own_ok", "link_ok")


def blocked_watermarks(events: DataFrame, block: int) -> DataFrame:
    """Every event with its source's ``watermark`` (greatest source_time before it) and ``late`` (strictly below it).

    A source may hold a third of the log, so its rows are cut into blocks of ``block`` log numbers: the greatest time of
    each block is found in a grouping, carried over the blocks of a source, and joined to the rows of the next block.
    Rows are kept and flagged, never dropped. A source without rows before has a null watermark and is not late.
    """
    cut = events.withColumn("_block", F.floor(F.col("seq") / block))
    tops = cut.groupBy("source_id", "_block").agg(F.max("source_time").alias("_top"))
    carried = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select("source_id", "_block", F.max("_top").over(carried).alias("_base"))
    within = Window.partitionBy("source_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = cut.withColumn("_own", F.max("source_time").over(within)).join(base, ["source_id", "_block"])
    return marked.withColumn("watermark", F.greatest("_base", "_own")).withColumn(
        "late", F.coalesce(F.col("source_time") < F.col("watermark"), F.lit(False))
    ).drop("_block", "_base", "_own")


def deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """Every event with ``first_seq``, the first one of its idempotency key, and ``duplicate``; none is dropped.

    The first of each key comes from a grouping, so that a key repeated without end is never ordered in one task.
    """
    first = events.groupBy(*keys).agg(F.min("seq").alias("first_seq"))
    return events.join(first, keys).withColumn("duplicate", F.col("seq") > F.col("first_seq"))


def admitted(payloads: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Payloads without errors, and the quarantined ones with their reasons."""
    judged = payloads.withColumn("reasons", errors)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def field_errors(schema: list[tuple[str, str, bool]], enums: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What is wrong with a payload whose fields came as text: missing required ones, types, enums.

    ``schema``: (field, kind, required), kinds number, integer, boolean, string and iso-datetime.
    """
    tests = {
        "number": lambda c: c.try_cast("double").isNotNull() & ~F.lower(c).isin("nan", "infinity", "-infinity", "inf", "-inf"),
        "integer": lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("long").isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
        "string": lambda c: F.lit(True),
        "iso-datetime": lambda c: c.rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(c).isNotNull(),
    }
    found = []
    for name, kind, required in schema:
        value = F.col(name)
        if required:
            found.append(F.when(value.isNull() | (value == ""), F.lit(f"missing {name}")))
        found.append(F.when(value.isNotNull() & (value != "") & ~tests[kind](value), F.lit(f"{name} is no {kind}")))
        if enums and name in enums:
            found.append(F.when(value.isNotNull() & ~value.isin(*enums[name]), F.lit(f"{name} is not listed")))
    return F.array_compact(F.array(*found))


def failure_streaks(attempts: DataFrame, key: str) -> DataFrame:
    """key, streak: failures since the last success (``ok``), by ``seq``; retries stop at a bound."""
    reset = attempts.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("seq"))), F.lit(-1)).alias("_last"))
    return attempts.join(reset, key).groupBy(key).agg(F.count_if(~F.col("ok") & (F.col("seq") > F.col("_last"))).alias("streak"))


def with_cap(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group, and one row that counts the rest: nothing goes unsaid.

    group, item, n_items. A window group limit keeps ``n`` rows of each task before the shuffle.
    """
    line = Window.partitionBy(group).orderBy(*order)
    top = rows.withColumn("_rank", F.row_number().over(line)).filter(F.col("_rank") <= n)
    told = top.select(group, F.col("item"), F.lit(1).cast("long").alias("n_items"))
    rest = rows.groupBy(group).agg((F.count("*") - n).alias("n_items")).filter("n_items > 0")
    return told.union(rest.select(group, F.lit("(more)").alias("item"), "n_items"))


def snapshot_diff(prior: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """key, kind of rows that are NEW, DISAPPEARED or CHANGED between two polls."""
    both = prior.select(key, F.col(digest).alias("_was")).join(now.select(key, F.col(digest).alias("_is")), key, "full_outer")
    kind = F.when(F.col("_was").isNull(), "NEW").when(F.col("_is").isNull(), "DISAPPEARED").when(F.col("_was") != F.col("_is"), "CHANGED")
    return both.select(key, kind.alias("kind")).filter("kind IS NOT NULL")


def delta_verdict(base: DataFrame, bundle: DataFrame) -> DataFrame:
    """verdict, n: how a delta's events (seq, entry_hash) meet a store: DUPLICATE, DIVERGED, NEW or MISSING_BASE."""
    head = base.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    met = bundle.alias("d").join(base.select(F.col("seq"), F.col("entry_hash").alias("own")), "seq", "left").join(F.broadcast(head))
    verdict = (
        F.when(F.col("own") == F.col("entry_hash"), "DUPLICATE")
        .when(F.col("own").isNotNull(), "DIVERGED")
        .otherwise("NEW")
    )
    kinds = met.select("seq", "head", verdict.alias("verdict"))
    gap = kinds.filter("verdict = 'NEW'").groupBy("head").agg(F.min("seq").alias("first")).filter("first > head + 1")
    missing = gap.select(F.lit("MISSING_BASE").alias("verdict"), (F.col("first") - F.col("head") - 1).alias("n"))
    return kinds.groupBy("verdict").agg(F.count("*").alias("n")).union(missing)


def delta_imports(store: DataFrame, manifests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle_id, verdict, n_applied) of delta bundles against a store, and the events (bundle_id, seq, entry_hash) that each applies.

    ``store``: seq, entry_hash; ``manifests``: bundle_id, base_seq, base_entry_hash (``GENESIS`` at 0); ``events``: bundle_id, seq,
    entry_hash, verified before. MISSING_BASE: the store ends before the base; WRONG_BASE: it has another hash there;
    DIVERGED_OVERLAP: an event that it has too is another one; DUPLICATE_DELTA: it has them all; else APPLIED, whole or not at all.
    Each bundle is judged by itself; bundles without events are duplicates. One bundle may be as long as the log.
    """
    held = store.select(F.col("seq").alias("_seq"), F.col("entry_hash").alias("_own"))
    head = store.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_head"))
    met = events.join(held, F.col("seq") == F.col("_seq"), "left")
    new = F.col("_own").isNull()
    told = met.groupBy("bundle_id").agg(F.count_if(new).alias("_new"), F.count_if(F.col("_own") != F.col("entry_hash")).alias("_other"))
    based = manifests.join(F.broadcast(head)).join(held, F.col("base_seq") == F.col("_seq"), "left").join(told, "bundle_id", "left")
    own_base = F.when(F.col("base_seq") == 0, GENESIS).otherwise(F.col("_own"))
    verdict = (
        F.when(F.col("_head") < F.col("base_seq"), "MISSING_BASE").when(~F.col("base_entry_hash").eqNullSafe(own_base), "WRONG_BASE").when(F.col("_other") > 0, "DIVERGED_OVERLAP")
        .when(F.coalesce("_new", F.lit(0)) == 0, "DUPLICATE_DELTA").otherwise("APPLIED")
    )
    receipts = based.select("bundle_id", verdict.alias("verdict"), F.when(verdict == "APPLIED", F.col("_new")).otherwise(0).cast("long").alias("n_applied"))
    applied = met.filter(new).join(receipts.filter("verdict = 'APPLIED'"), "bundle_id", "left_semi").select("bundle_id", "seq", "entry_hash")
    return receipts, applied
