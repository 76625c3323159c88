"""Ingest: payloads are validated, taken apart into units, mapped to versioned objects, and linked to where they came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldlog.functions import scalar
from worldlog.operators.blocks import placed



def units(payloads: DataFrame) -> DataFrame:
    """payload_id, pos, unit (JSON): a document is one unit, rows are each one, features are their properties and geometry."""
    parts = F.from_json("body", "rows array<string>, features array<struct<geometry:string,properties:string>>")
    feature = lambda f: F.concat(
        F.regexp_replace(F.coalesce(f["properties"], F.lit("{}")), r"\}\s*$", ""),
        F.when(F.coalesce(f["properties"], F.lit("{}")).rlike(r"^\{\s*\}$"), "").otherwise(","),
        F.lit('"__geometry":'), F.coalesce(f["geometry"], F.lit("null")), F.lit("}"),
    )
    each = F.when(F.col("kind") == "rows", parts["rows"]).when(F.col("kind") == "geojson", F.transform(parts["features"], feature)).otherwise(F.array("body"))
    return payloads.select("payload_id", F.posexplode(each).alias("pos", "unit"))


def versioned(units_: DataFrame, external_id: Column, prefix: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units as versions of objects, and those skipped for want of an external id.

    Adds object_id, version (after the last of ``known``: object_id, version), transformation_id. An object's units are
    numbered in the order of payload and place.
    """
    named = units_.withColumn("external_id", F.nullif(external_id, F.lit("")))
    good = named.filter("external_id IS NOT NULL").withColumn("object_id", F.concat(F.lit(prefix), "external_id"))
    line = Window.partitionBy("object_id").orderBy("payload_id", "pos")
    last = known.groupBy("object_id").agg(F.max("version").alias("_last"))
    made = good.withColumn("_n", F.row_number().over(line)).join(last, "object_id", "left")
    version = (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long")
    tf = scalar.digest_id("tf", F.col("payload_id"), F.col("external_id"))
    return made.withColumns({"version": version, "transformation_id": tf}).drop("_n", "_last"), named.filter("external_id IS NULL")


def relationships(objects: DataFrame, relation: str, target: Column, outward: bool = True) -> DataFrame:
    """relationship_id, relation_type, source_object_id, target_object_id, evidence_ref, version of units that name a target."""
    ends = (F.col("object_id"), target) if outward else (target, F.col("object_id"))
    found = objects.filter(target.isNotNull() & (target != "")).select(F.lit(relation).alias("relation_type"), ends[0].alias("source_object_id"), ends[1].alias("target_object_id"), F.col("payload_id").alias("evidence_ref"), "pos")
    keyed = found.withColumn("relationship_id", scalar.digest_id("rel", F.col("relation_type"), F.col("source_object_id"), F.col("target_object_id")))
    line = Window.partitionBy("relationship_id").orderBy("evidence_ref", "pos")
    return keyed.withColumn("version", F.row_number().over(line).cast("long")).drop("pos")


def numbered(rows: DataFrame, order: str, start: Column | int = 0) -> DataFrame:
    """``rows`` with ``seq`` = start + 1, ... by ``order``: tasks number their ranges, and only their counts are summed."""
    start = F.lit(start) if isinstance(start, int) else start
    return placed(rows, [order], "seq").withColumn("seq", (start + F.col("seq")).cast("long"))


def appended(store: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What an append of ``batch`` adds to ``store`` (seq, keys): rows whose keys it has not, first wins, numbered after its head."""
    first = batch.groupBy(*keys).agg(F.min(order).alias(order))
    new = batch.join(first, [*keys, order], "left_semi").join(store.select(*keys), keys, "left_anti")
    head = store.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_head"))  # one row
    return numbered(new, order).join(F.broadcast(head)).withColumn("seq", F.col("seq") + F.col("_head")).drop("_head")


def once(transitions: DataFrame, recorded: DataFrame) -> DataFrame:
    """Transitions that are not recorded yet, each once: their id comes from subject, type and cause alone."""
    parts = ("subject_kind", "subject_id", "transition_type", "caused_by")
    named = transitions.withColumn("transition_id", scalar.digest_id("antrans", *map(F.col, parts)))
    return named.dropDuplicates(["transition_id"]).join(recorded.select("transition_id"), "transition_id", "left_anti")


def version_commands(commands: DataFrame, current: DataFrame) -> DataFrame:
    """command_id, verdict, version: writes that name the version they saw.

    APPLIED (as the next version), CONFLICT where the target has moved, or where an earlier command of the same
    version was applied; NOT_FOUND without a target. commands: command_id, target_id, expected; current: target_id, version.
    """
    met = commands.join(current.withColumnRenamed("version", "_now"), "target_id", "left")
    first = met.filter("expected = _now").groupBy("target_id").agg(F.min("command_id").alias("_first"))
    judged = met.join(first, "target_id", "left")
    verdict = F.when(F.col("_now").isNull(), "NOT_FOUND").when(F.col("command_id") == F.col("_first"), "APPLIED").otherwise("CONFLICT")
    return judged.select("command_id", verdict.alias("verdict"), F.when(verdict == "APPLIED", F.col("_now") + 1).cast("long").alias("version"))


def committed_prefix(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (file, no, line, problem) before the first bad one of their file, and the receipt: file, n_kept, n_lost, digest.

    What is lost is named by count and by a hash over its lines, so that a forensic copy can be held against it.
    """
    torn = lines.filter("problem IS NOT NULL").groupBy("file").agg(F.min("no").alias("_torn"))
    met = lines.join(torn, "file", "left").withColumn("_kept", F.col("_torn").isNull() | (F.col("no") < F.col("_torn")))
    lost = F.bit_xor(F.when(~F.col("_kept"), F.conv(F.substring(F.md5(F.concat_ws("|", "no", "line")), 1, 15), 16, 10).cast("long")))
    receipt = met.groupBy("file").agg(F.count_if("_kept").alias("n_kept"), F.count_if(~F.col("_kept")).alias("n_lost"), F.coalesce(lost, F.lit(0).cast("long")).alias("digest"))
    return met.filter("_kept").drop("_torn", "_kept"), receipt


def recovered(lines: DataFrame, path: str) -> DataFrame:
    """Writes what a recovery keeps of each file to ``path``/kept and what it loses, line by line with its problem, to
    ``path``/forensic; the receipts (file, n_kept, n_lost, digest). Nothing is thrown away, and a second run writes the same."""
    kept, receipt = committed_prefix(lines)
    lost = lines.join(kept.select("file", "no"), ["file", "no"], "left_anti")
    kept.select("file", "no", "line").write.mode("overwrite").parquet(f"{path}/kept")
    lost.select("file", "no", "line", "problem").write.mode("overwrite").parquet(f"{path}/forensic")
    return receipt


def any_of(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, by column names."""
    return reduce(DataFrame.unionByName, tables)
