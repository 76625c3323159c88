"""Tables that leave the engine and come back: exports with a manifest, checks on import, bundles for one reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that give back what was written, to the microsecond and in UTC.
SPELLING = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def digest(name: str, rows: DataFrame) -> DataFrame:
    """name, n, digest of a table's rows whatever their order and place: a sum over hashes of all columns by name."""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    piece = F.pmod(F.xxhash64(*columns), F.lit(1_000_000_007))
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(piece), F.lit(0).cast("long")).alias("digest"))


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [digest(name, rows) for name, rows in tables.items()])


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as open JSON lines in ``folder``, and a manifest of their counts and digests beside them."""
    for name, rows in tables.items():
        rows.write.options(**SPELLING).json(f"{folder}/{name}")
    digests(tables).write.json(f"{folder}/manifest")


def imported(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """The tables of an export, read with the schemas of ``tables``."""
    return {name: spark.read.schema(rows.schema).options(**SPELLING).json(f"{folder}/{name}") for name, rows in tables.items()}


def verified(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """name, n, n_read, equal: what the manifest declares against what is there; members that it does not name are absent."""
    declared = spark.read.schema("name string, n long, digest long").json(f"{folder}/manifest")
    there = digests(imported(spark, tables, folder)).withColumnsRenamed({"n": "n_read", "digest": "_read"})
    return declared.join(there, "name", "left").select("name", "n", F.coalesce("n_read", F.lit(0)).alias("n_read"), F.col("digest").eqNullSafe(F.col("_read")).alias("equal"))


def equal_views(original: dict[str, DataFrame], again: dict[str, DataFrame]) -> DataFrame:
    """check, equal: whether each view of the original and of what was imported holds the same rows."""
    was, now = digests(original), digests(again).withColumnsRenamed({"n": "_n", "digest": "_digest"})
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest"))
    return was.join(now, "name", "full_outer").select(F.col("name").alias("check"), same.alias("equal"))


def dissemination(members: dict[str, DataFrame], visible: DataFrame, key: str) -> dict[str, DataFrame]:
    """The rows of each member that a reader may see, by the key that all members have; hidden keys leave no trace."""
    return {name: rows.join(visible.select(key), key, "left_semi") for name, rows in members.items()}
