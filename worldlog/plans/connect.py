"""Queries over connectors, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.operators import ingest, log, versions
from worldlog.operators.ingest import any_of
from worldlog.roles import duck, table
from worldlog.sources import connectors

from .ingest import _folder

#: Bytes of a range: far below a segment's, so that ranges begin and end within lines.
RANGE_BYTES = 250_007


def x1_log_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in three segments read by ranges that cut its lines; some lines are empty, torn or end in a carriage return."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 50
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", "props"))
    line = F.when(k == 3, "").when(k == 5, F.concat(whole, F.lit("\r"))).when(k == 7, F.expr("substring(event_type, 1, 3)")).otherwise(whole)
    path = _folder(spark, "ranges")
    e.select(line.alias("value")).coalesce(3).write.text(path)
    found = connectors.segments(spark, path, RANGE_BYTES)
    event = F.from_json("line", "event_id long, user_id long, event_type string, props string")
    return found.select(event.alias("e"), F.coalesce("problem", F.lit("NONE")).alias("problem"), F.length("line").cast("long").alias("n_chars")).select("e.event_id", "e.user_id", "e.event_type", "problem", "n_chars")


def s10_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures of three feeds, each read by the connector of its kind: bodies, malformed ones, repeats of events and of contents."""
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 30
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = table(spark, sf_dir, "orders").select(
        key.alias("payload_id"), F.concat(F.lit("s"), key % 5).alias("source_id"), k.alias("_k"),
        F.when(k == 0, say("id,amount\n", key, "\n")).when(k == 3, "id,amount\n").when(k == 6, say("id,amount,ok\n", F.col("o_custkey") % 7, ",x,YES\n")).when(k % 3 == 0, say("id,amount,ok\n", key, ",", (key % 9).cast("double"), ",no\n,,\n"))
        .when(k == 1, "{").when(k == 4, "[]").when(k % 3 == 1, say('{"event":"', F.col("o_custkey") % 100, '","n":', key, "}"))
        .when(k == 2, say('{"type":"Feature","n":', key, "}")).otherwise(say('{"type":"FeatureCollection","features":[],"n":', F.col("o_custkey") % 50, "}")).alias("body"),
    )
    kinds = [
        connectors.connector("csv", "rows", "orders", types={"id": "integer", "amount": "number", "ok": "boolean"}),
        connectors.connector("json", "notes", "notes", "event"),
        connectors.connector("geojson", "places", "places"),
    ]
    read = any_of(*(c.payloads(rows.filter(F.col("_k") % 3 == i)) for i, c in enumerate(kinds)))
    return connectors.ingestions(read).select("payload_id", "connector_id", "body", "problem", "duplicate_of")


def s22_delta_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's first two thirds as a store, all of it dealt to 25 bundles of different bases, some of them wrong: verdicts."""
    parts = ["seq", "source_id", "subject"]
    whole = roles.log(spark, sf_dir).select("seq", log.entry_hash(*parts).alias("entry_hash"))
    head = whole.agg(F.floor(F.max("seq") * 2 / 3).alias("head"))
    store = whole.join(F.broadcast(head)).filter("seq <= head").drop("head")
    b = F.col("bundle_id")
    base = F.when(b % 5 == 0, F.col("head") + 1 + b).when(b == 4, 0).otherwise(F.floor(F.col("head") * b / 30))
    bases = spark.range(25).withColumnRenamed("id", "bundle_id").join(F.broadcast(head)).withColumn("base_seq", base.cast("long"))
    hashed = bases.join(whole.withColumnRenamed("seq", "base_seq"), "base_seq", "left")
    manifests = hashed.select("bundle_id", "base_seq", F.when(b % 5 == 1, "other").when(F.col("base_seq") == 0, log.GENESIS).otherwise(F.col("entry_hash")).alias("base_entry_hash"))
    dealt = whole.withColumn("bundle_id", F.col("seq") % 25).join(F.broadcast(bases), "bundle_id").filter((F.col("seq") > F.col("base_seq")) & ((b % 5 != 3) | (F.col("seq") <= F.col("head"))))
    events = dealt.select("bundle_id", "seq", F.when((b % 5 == 2) & (F.col("seq") % 4 == 0), "other").otherwise(F.col("entry_hash")).alias("entry_hash"))
    receipts, applied = log.delta_imports(store, manifests, events)
    return receipts.join(applied.groupBy("bundle_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last")), "bundle_id", "left")


def s25_forensic_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recovery of torn segments leaves: kept lines and, apart, the lost ones with what was wrong."""
    torn = F.col("seq").isin(700, 1_500, 2_500, 2_600)
    rows = roles.log(spark, sf_dir).select(F.col("source_id").alias("file"), F.col("seq").alias("no"), F.when(torn, "{").otherwise("{}").alias("line"), F.when(torn, "TORN_OR_INVALID").alias("problem"))
    path = _folder(spark, "recovery")
    ingest.recovered(rows, path)
    of = lambda part, problem: spark.read.parquet(f"{path}/{part}").select("file", "no", "line", problem.alias("problem"), F.lit(part).alias("part"))
    return of("kept", F.lit(None).cast("string")).union(of("forensic", F.col("problem")))


def w01_tie_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each customer's is current by three more rules: valid point, stated version, last appended of each kind."""
    n = F.col("seq")
    when = lambda k, days: F.when(n % 3 >= k, F.col("valid_from") + F.expr(f"INTERVAL {days} DAYS"))
    rows = roles.objects(spark, sf_dir).select("object_id", "seq", F.when(n % 4 > 0, F.col("version") % 3).cast("long").alias("version"), when(2, 0).alias("valid_from"), when(1, 100).alias("source_time"), (F.col("valid_from") + F.expr("INTERVAL 200 DAYS")).alias("recorded_time"), "status")
    row = lambda df, rule: df.select(F.lit(rule).alias("rule"), "object_id", "seq")
    return any_of(row(versions.current_by_valid_point(rows.fillna(0, ["version"])), "valid point"), row(versions.current_by_stated_version(rows), "stated version"), row(versions.last_appended(rows, "status", "object_id"), "last appended"))


SQL = {
    "s22_delta_imports": duck(
        """, e AS (SELECT seq, sha256(seq || '|' || source_id || '|' || subject) AS h FROM log), k AS (SELECT max(seq) * 2 // 3 AS head FROM e),
        b AS (SELECT b, head, CASE WHEN b % 5 = 0 THEN head + 1 + b WHEN b = 4 THEN 0 ELSE head * b // 30 END AS base FROM range(25) t(b), k),
        v AS (SELECT b.b, base, head, e.seq, CASE WHEN b.b % 5 = 2 AND e.seq % 4 = 0 THEN 'other' ELSE h END AS h, h AS own FROM b LEFT JOIN e ON e.seq % 25 = b.b AND e.seq > base AND (b.b % 5 <> 3 OR e.seq <= head)),
        g AS (SELECT b, base, head, count(*) FILTER (WHERE seq > head) AS new, count(*) FILTER (WHERE seq <= head AND h <> own) AS other, min(seq) FILTER (WHERE seq > head) AS f, max(seq) FILTER (WHERE seq > head) AS l FROM v GROUP BY ALL),
        r AS (SELECT *, CASE WHEN head < base THEN 'MISSING_BASE' WHEN b % 5 = 1 THEN 'WRONG_BASE' WHEN other > 0 THEN 'DIVERGED_OVERLAP' WHEN new = 0 THEN 'DUPLICATE_DELTA' ELSE 'APPLIED' END AS verdict FROM g)
        SELECT b AS bundle_id, verdict, CASE WHEN verdict = 'APPLIED' THEN new ELSE 0 END AS n_applied, CASE WHEN verdict = 'APPLIED' THEN f END AS "first", CASE WHEN verdict = 'APPLIED' THEN l END AS "last" FROM r""", "log"),
    "s25_forensic_copy": duck(
        """, t AS (SELECT source_id, min(seq) AS torn FROM log WHERE seq IN (700, 1500, 2500, 2600) GROUP BY 1)
        SELECT source_id AS file, seq AS no, CASE WHEN seq IN (700, 1500, 2500, 2600) THEN '{' ELSE '{}' END AS line, CASE WHEN seq IN (700, 1500, 2500, 2600) THEN 'TORN_OR_INVALID' END AS problem, CASE WHEN seq >= torn THEN 'forensic' ELSE 'kept' END AS part FROM log LEFT JOIN t USING (source_id)""", "log"),
    "w01_tie_rules": duck(
        """, r AS (SELECT object_id, seq, status, CASE WHEN seq % 4 > 0 THEN version % 3 END AS v, CASE seq % 3 WHEN 2 THEN valid_from WHEN 1 THEN valid_from + INTERVAL 100 DAY ELSE valid_from + INTERVAL 200 DAY END AS p FROM objects)
        SELECT 'valid point' AS rule, object_id, arg_max(seq, (p, coalesce(v, 0))) AS seq FROM r GROUP BY object_id UNION ALL SELECT 'stated version', object_id, arg_max(seq, (coalesce(v, 1), seq)) FROM r GROUP BY object_id
        UNION ALL SELECT 'last appended', object_id, max(seq) FROM r GROUP BY status, object_id""", "objects"),
    "x1_log_ranges": """WITH e AS (SELECT *, event_id % 50 AS k, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}' AS w FROM events)
        SELECT CASE WHEN k NOT IN (3, 7) THEN event_id END AS event_id, CASE WHEN k NOT IN (3, 7) THEN user_id END AS user_id, CASE WHEN k NOT IN (3, 7) THEN event_type END AS event_type,
          CASE k WHEN 3 THEN 'EMPTY_LINE' WHEN 5 THEN 'CARRIAGE_RETURN' WHEN 7 THEN 'INVALID_JSON' ELSE 'NONE' END AS problem, CAST(CASE k WHEN 3 THEN 0 WHEN 5 THEN length(w) + 1 WHEN 7 THEN 3 ELSE length(w) END AS BIGINT) AS n_chars FROM e""",
    "s10_connectors": r"""WITH o AS (SELECT o_orderkey AS payload_id, o_orderkey % 30 AS k, 's' || o_orderkey % 5 AS s, o_custkey AS c FROM orders),
        b AS (SELECT *, ['rows', 'notes', 'places'][k % 3 + 1] AS connector_id, CASE WHEN k IN (0, 3, 1, 4, 2) THEN 'MALFORMED_PAYLOAD' END AS problem,
          CASE WHEN k = 6 THEN '{"rows":[{"id":' || c % 7 || ',"amount":"x","ok":true}]}' WHEN k % 3 = 0 THEN '{"rows":[{"id":' || payload_id || ',"amount":' || payload_id % 9 || '.0,"ok":false},{"id":null,"amount":null,"ok":null}]}'
            WHEN k % 3 = 1 THEN '{"event":"' || c % 100 || '","n":' || payload_id || '}' ELSE '{"type":"FeatureCollection","features":[],"n":' || c % 50 || '}' END AS body,
          CASE WHEN k = 3 THEN 'c3' WHEN k = 0 THEN 'c0' || payload_id WHEN k = 6 THEN 'c6' || c % 7 WHEN k % 3 = 0 THEN 'c' || payload_id WHEN k = 1 THEN 'j1' WHEN k = 4 THEN 'j4' WHEN k % 3 = 1 THEN 'e' || c % 100 WHEN k = 2 THEN 'h' || payload_id ELSE 'g' || c % 50 END AS key FROM o),
        f AS (SELECT *, min(payload_id) OVER (PARTITION BY connector_id, s, key) AS first FROM b)
        SELECT payload_id, connector_id, CASE WHEN problem IS NULL THEN body END AS body, problem, CASE WHEN first <> payload_id THEN first END AS duplicate_of FROM f""",
}

QUERIES = {f.__name__: f for f in (x1_log_ranges, s10_connectors, s22_delta_imports, s25_forensic_copy, w01_tie_rules)}
