"""The driver's tables in the roles of the evidence log: events, versions, markings, documents, forecasts.

``DUCK`` holds the same roles as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worldlog.operators.graph import dealt

SNAPSHOT = "2001-12-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in log order; every eleventh k reports an hour late."""
    k = F.get_json_object("props", "$.k").cast("long")
    late = F.when(k % 11 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("event_type").alias("source_id"),
        F.col("user_id").alias("subject"),
        k.alias("k"),
        "value",
        F.col("ts").alias("recorded_time"),
        (F.col("ts") - late).alias("source_time"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of its customer for each order; the order key is when it became known."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("object_id"),
        F.row_number().over(line).cast("long").alias("version"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("valid_from"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("value"),
    )


def markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id with its owner, compartments, releasability and least role."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("object_id"),
        F.col("r_name").alias("owning_authority"),
        F.array(F.concat(F.lit("C"), (F.col("c_nationkey") % 5).cast("string"))).alias("compartments"),
        F.when(segment == "AUTOMOBILE", F.array().cast("array<string>"))
        .when(segment == "BUILDING", F.array(F.lit("BUILDING"), F.lit("SHARED")))
        .otherwise(F.array(segment))
        .alias("releasability"),
        F.when(F.col("c_acctbal") < 0, "OBSERVER").when(F.col("c_acctbal") < 5000, "ANALYST").otherwise("SUPERVISOR").alias("min_role"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved forecasts: a probability for each order, and whether it was filled."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("forecast_id"),
        F.col("o_orderpriority").alias("author"),
        F.year("o_orderdate").cast("long").alias("domain"),
        ((F.col("o_orderkey") * 37 % 99 + 1) / 100.0).alias("probability"),
        (F.col("o_orderstatus") == "F").alias("outcome"),
        (F.col("o_orderkey") % 120).alias("days"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customer to supplier edges, with how many lines each has."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = lines.count()
    lines = dealt(lines, n, "l_orderkey")
    ends = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), "l_returnflag")
    return dealt(ends, n, "source_id", "target_id").groupBy("source_id", "target_id").agg(F.count("*").alias("n_lines"), F.max("l_returnflag").alias("flag"))


DUCK = {
    "log": """SELECT event_id + 1 AS seq, event_type AS source_id, user_id AS subject, CAST(props->>'$.k' AS BIGINT) AS k, value,
        ts AS recorded_time, ts - CASE WHEN CAST(props->>'$.k' AS BIGINT) % 11 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS source_time FROM events""",
    "objects": """SELECT o_custkey AS object_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
        o_orderkey AS seq, o_orderdate AS valid_from, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS value FROM orders""",
    "markings": """SELECT c_custkey AS object_id, r_name AS owning_authority, ['C' || (c_nationkey % 5)] AS compartments,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN [] WHEN 'BUILDING' THEN ['BUILDING', 'SHARED'] ELSE [c_mktsegment] END AS releasability,
        CASE WHEN c_acctbal < 0 THEN 'OBSERVER' WHEN c_acctbal < 5000 THEN 'ANALYST' ELSE 'SUPERVISOR' END AS min_role
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "forecasts": """SELECT o_orderkey AS forecast_id, o_orderpriority AS author, year(o_orderdate) AS domain, (o_orderkey * 37 % 99 + 1) / 100.0::DOUBLE AS probability,
        o_orderstatus = 'F' AS outcome, o_orderkey % 120 AS days FROM orders""",
    "relations": """SELECT o_custkey AS source_id, l_suppkey AS target_id, count(*) AS n_lines, max(l_returnflag) AS flag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
}


def duck(query: str, *names: str, recursive: bool = False) -> str:
    """``query`` with the named roles before it; a query that begins with a comma adds tables of its own to them."""
    roles = ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{roles}{'' if query.lstrip().startswith(',') else ' '}{query.lstrip()}"
