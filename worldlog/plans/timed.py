"""Queries over timers, stream-stream joins, sliding windows and typed paths, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.operators import graph
from worldlog.roles import duck, table
from worldlog.streaming import live, timers

from .ingest import _folder


def _streamed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows as a stream, by way of files."""
    path = _folder(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of one watch for each user: some fail, others return two records."""
    k = F.get_json_object("props", "$.k").cast("long")
    records = F.map_from_arrays(F.array(F.concat(F.lit("a"), k % 4), F.concat(F.lit("b"), k % 5)), F.array(F.concat(F.lit("t"), k % 3), F.lit("t0")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("watch_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("run_time"), ((F.col("user_id") % 3 + 1) * 21_600).alias("cadence_s"),
        F.when(k % 7 == 3, "SOURCE_FAILED").otherwise("EXECUTED_WITH_RESULTS").alias("outcome"), records.alias("records"),
    )


def r05_watch_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches that fell due and had not run, told by timers, the changes of each poll, and its failures."""
    found = live.run_to_end(timers.watch_changes(_streamed(spark, _polls(spark, sf_dir), "polls")), "watches")
    return found.select("watch_id", _stamp(F.col("at_ms")).alias("at"), "change_type", "ref")


def r09_horizon_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as forecasts of a user's great click within half a day: borne out, or false when the horizon passes."""
    kind = F.when(F.col("event_type") == "purchase", "POSED").when((F.col("event_type") == "click") & (F.col("value") >= 60), "MATCH")
    at = F.col("ts").cast("timestamp")
    acts = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), at.alias("at"), kind.alias("kind"), (at + F.expr("INTERVAL 12 HOURS")).alias("horizon")).filter("kind IS NOT NULL")
    found = live.run_to_end(timers.horizon_verdicts(_streamed(spark, acts, "acts")), "horizons")
    return found.select("subject", "forecast_id", "verdict", _stamp(F.col("at_ms")).alias("at"))


def r15_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, and what the same user bought within six hours after: two streams joined by interval under two watermarks."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "event_type")
    of = lambda kind: _streamed(spark, rows.filter(F.col("event_type") == kind).drop("event_type"), kind)
    found = live.run_to_end(timers.interval_matches(of("click"), of("purchase"), "user_id", "6 HOURS", "1 hour"), "matches")
    return found.select("user_id", "left_id", "right_id")


def r15_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.log(spark, sf_dir).withColumn("source_time", F.col("source_time").cast("timestamp"))
    found = timers.sliding(rows, "6 hours", "2 hours")
    return found.select("source_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


TYPES = [f"T{i}" for i in range(7)]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade relations with a type and a status."""
    n = F.col("source_id") * 7 + F.col("target_id")
    return roles.relations(spark, sf_dir).select(
        F.concat_ws("-", "source_id", "target_id").alias("relation_id"), F.concat(F.lit("c"), "source_id").alias("src"), F.concat(F.lit("s"), "target_id").alias("dst"),
        F.concat(F.lit("T"), n % 9).alias("relation_type"), F.when((F.col("source_id") + F.col("target_id")) % 10 == 0, "ENDED").otherwise("ACTIVE").alias("status"),
    )


def g07_typed_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two relations of two types of the first customer of each nation."""
    seeds = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c")).select(F.concat(F.lit("c"), "c").alias("node"))
    return graph.neighbourhood(_typed(spark, sf_dir), seeds, 2, ["T0", "T4"])


def g08_typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of at most three trade relations from the first customer of each nation to the first supplier and customer of the next one."""
    edges = _typed(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey")).alias("nation")).agg(F.min("c_custkey").alias("c"))
    suppliers = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey")).alias("nation")).agg(F.min("s_suppkey").alias("s"))
    after = F.expr("(nation + 1) % 25").alias("next")
    seeds = customers.select(F.concat(F.lit("c"), "c").alias("seed"), after)
    targets = customers.select(F.concat(F.lit("c"), "c").alias("target"), F.col("nation").alias("next")).union(suppliers.select(F.concat(F.lit("s"), "s"), "nation"))
    return graph.typed_paths(edges, seeds.join(targets, "next").select("seed", "target"), TYPES)


SQL = {
    "r05_watch_timers": """WITH p AS (SELECT user_id AS w, event_id AS seq, epoch_us(ts) // 1000 AS t, CAST(props->>'$.k' AS BIGINT) AS k, (user_id % 3 + 1) * 21600000 AS c FROM events),
        r AS (SELECT *, k % 7 = 3 AS failed, CASE WHEN k % 7 = 3 THEN map([]::VARCHAR[], []::VARCHAR[]) ELSE map(['a' || k % 4, 'b' || k % 5], ['t' || k % 3, 't0']) END AS now FROM p),
        l AS (SELECT *, lag(now) OVER o AS before, lead(t) OVER o AS next, max(t) OVER () AS last FROM r WINDOW o AS (PARTITION BY w ORDER BY t, seq)),
        f AS (SELECT w, t + c AS moment, 'DUE' AS change_type, '' AS ref FROM l WHERE next > t + c OR (next IS NULL AND last >= t + c)
          UNION ALL SELECT w, t, 'RETRIEVAL_FAILURE', '' FROM l WHERE failed
          UNION ALL SELECT w, t, CASE WHEN before[i] IS NULL THEN 'NEW_OBJECT' ELSE 'CHANGED_SOURCE_RECORD' END, i FROM (SELECT *, unnest(map_keys(now)) AS i FROM l WHERE NOT failed AND before IS NOT NULL) WHERE before[i] IS NULL OR before[i] <> now[i]
          UNION ALL SELECT w, t, 'DISAPPEARED_OBJECT', i FROM (SELECT *, unnest(map_keys(before)) AS i FROM l WHERE NOT failed AND before IS NOT NULL) WHERE now[i] IS NULL)
        SELECT w AS watch_id, strftime(make_timestamp(moment * 1000), '%Y-%m-%d %H:%M:%S.%g') AS "at", change_type, ref FROM f""",
    "r09_horizon_timers": """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS t FROM events), last AS (SELECT max(t) AS t FROM e WHERE event_type = 'purchase' OR event_type = 'click' AND value >= 60),
        p AS (SELECT user_id, event_id, t, (SELECT min(m.t) FROM e m WHERE m.user_id = e.user_id AND m.event_type = 'click' AND m.value >= 60 AND m.t > e.t AND m.t <= e.t + 43200000) AS hit FROM e WHERE event_type = 'purchase')
        SELECT user_id AS subject, event_id AS forecast_id, CASE WHEN hit IS NOT NULL THEN 'TRUE' ELSE 'FALSE_BY_ABSENCE' END AS verdict, strftime(make_timestamp(coalesce(hit, p.t + 43200000) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS "at"
        FROM p, last WHERE hit IS NOT NULL OR last.t >= p.t + 43200000""",
    "r15_stream_join": """SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS
        WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
    "r15_sliding": duck(
        """, w AS (SELECT source_id, value, unnest([time_bucket(INTERVAL 2 HOUR, source_time), time_bucket(INTERVAL 2 HOUR, source_time) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, source_time) - INTERVAL 4 HOUR]) AS s FROM log)
        SELECT source_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""", "log"),
    "g07_typed_hop": duck(
        """, e AS (SELECT 'c' || source_id AS a, 's' || target_id AS b FROM relations WHERE (source_id * 7 + target_id) % 9 IN (0, 4)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT 'c' || min(c_custkey) AS node, CAST(0 AS BIGINT) AS hop FROM customer GROUP BY c_nationkey UNION SELECT b, hop + 1 FROM r JOIN u ON a = node WHERE hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY 1""", "relations", recursive=True),
    "g08_typed_paths": duck(
        f""", e AS (SELECT source_id || '-' || target_id AS id, 'c' || source_id AS a, 's' || target_id AS b, 'T' || (source_id * 7 + target_id) % 9 AS type FROM relations WHERE (source_id + target_id) % 10 <> 0 AND (source_id * 7 + target_id) % 9 < 7),
        u AS MATERIALIZED (SELECT id, a, b, type FROM e UNION ALL SELECT id, b, a, type FROM e), c AS (SELECT c_nationkey AS n, min(c_custkey) AS k FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1),
        t AS (SELECT n, 'c' || k AS target FROM c UNION ALL SELECT n, 's' || k FROM s), w AS MATERIALIZED (SELECT 'c' || c.k AS seed, target FROM c JOIN t ON t.n = (c.n + 1) % 25),
        way AS (SELECT DISTINCT seed, seed AS node, 0 AS hop FROM w UNION SELECT seed, b, hop + 1 FROM way JOIN u ON a = node WHERE hop < 3),
        met AS MATERIALIZED (SELECT seed, node, min(hop) AS hop FROM way GROUP BY 1, 2),
        pred AS MATERIALIZED (SELECT m.seed, m.node, m.hop, min({{'id': u.id, 'prev': u.a, 'type': u.type}}) AS p FROM met m JOIN u ON u.b = m.node JOIN met q ON q.seed = m.seed AND q.node = u.a AND q.hop = m.hop - 1 GROUP BY 1, 2, 3),
        back AS (SELECT w.seed, target, pred.node, pred.hop, p FROM w JOIN pred ON pred.seed = w.seed AND pred.node = target UNION ALL SELECT back.seed, target, pred.node, pred.hop, pred.p FROM back JOIN pred ON pred.seed = back.seed AND pred.node = back.p.prev)
        SELECT seed, target, CAST(hop AS INT) AS step, p.prev AS src, p.id AS relation_id, p.type AS relation_type, node AS dst FROM back""", "relations", recursive=True),
}

QUERIES = {f.__name__: f for f in (r05_watch_timers, r09_horizon_timers, r15_stream_join, r15_sliding, g07_typed_hop, g08_typed_paths)}
