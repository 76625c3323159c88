"""Queries over versions, access and the log, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.functions import scalar
from worldlog.operators import access, blocks, log, versions
from worldlog.roles import SNAPSHOT, duck

READER = access.Context("EUROPE", ("C0", "C1", "C2"), ("BUILDING", "MACHINERY"), "ANALYST")
VISIBLE_SQL = """SELECT object_id FROM markings WHERE min_role <> 'SUPERVISOR' AND list_has_all(['C0', 'C1', 'C2'], compartments)
  AND CASE WHEN len(releasability) > 0 THEN list_has_any(releasability, ['BUILDING', 'MACHINERY']) ELSE owning_authority = 'EUROPE' END"""
CUT, AT = 9_000, "1998-06-30 00:00:00"
CURRENT = "SELECT object_id, version, status, value FROM objects QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY {}) = 1"


def text(column: str) -> F.Column:
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(column)


SHORT = ("object_id", "version", "status", "value")


def q01_mission_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What this reader sees as current at a time, and how stale it is: counts by status and freshness."""
    seen = access.visible(roles.markings(spark, sf_dir), READER).select("object_id")
    current = versions.valid_at(versions.known_by(roles.objects(spark, sf_dir), CUT), AT)
    fresh = versions.freshness(F.col("valid_from"), SNAPSHOT, F.lit(24.0 * 365 * 4))
    return (
        current.join(seen, "object_id", "left_semi")
        .groupBy("status", fresh["state"].alias("freshness"))
        .agg(F.count("*").alias("n"), F.max("version").alias("most_versions"))
    )


def p06_access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible(roles.markings(spark, sf_dir), READER).select("object_id", "owning_authority", "min_role")


def w01_current_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current_by_validity(roles.objects(spark, sf_dir)).select(*SHORT)


def w01_current_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current_by_log(roles.objects(spark, sf_dir)).select(*SHORT)


def w01_latest_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current_by_version(roles.objects(spark, sf_dir)).select(*SHORT)


def w02_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.opening(roles.objects(spark, sf_dir)).select(*SHORT)


def j09_valid_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.valid_at(roles.objects(spark, sf_dir), AT).select(*SHORT)


def j10_txn_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current_by_validity(versions.known_by(roles.objects(spark, sf_dir), CUT)).select(*SHORT)


def p09_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = versions.current_by_validity(roles.objects(spark, sf_dir))
    return current.select("object_id", versions.freshness(F.col("valid_from"), SNAPSHOT, F.lit(24.0 * 365)).alias("f")).select("object_id", "f.*")


def p10_quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = versions.current_by_validity(roles.objects(spark, sf_dir))
    quality = F.create_map(
        F.lit("confidence"), ((F.col("object_id") % 10) / 10).cast("string"),
        F.lit("mapping"), F.when(F.col("object_id") % 3 == 0, "UNKNOWN").otherwise("0.9"),
        F.lit("review"), F.when(F.col("status") == "P", "UNREVIEWED").otherwise("DONE"),
    )
    state = versions.freshness(F.col("valid_from"), SNAPSHOT, F.lit(24.0 * 365))["state"]
    weak = versions.weak_dimensions(quality, state)
    return current.select("object_id", F.when(F.size(weak) > 0, "DEGRADED").otherwise("NOMINAL").alias("state"), F.array_join(weak, ",").alias("weak"))


def w03_version_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.breaks_in_sequence(roles.objects(spark, sf_dir)).select("object_id", "seq", "version", "expected")


def w04_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's log is chained, three entries are tampered with, and the verifier must name them and their heirs."""
    parts = ["source_id", "seq", "subject", "k"]
    entries = roles.log(spark, sf_dir).select(*parts, log.entry_hash(*parts).alias("entry_hash"))
    chained = blocks.previous(entries, ["source_id"], ["seq"], ["entry_hash"]).withColumn("prev_hash", F.coalesce("before.entry_hash", F.lit(log.GENESIS))).drop("before")
    torn = chained.withColumn("k", F.when(F.col("seq").isin(17, 1_000, 1_001), F.lit(-1).cast("long")).otherwise(F.col("k")))
    lost = torn.filter("seq <> 500")
    return log.broken_links(lost, "source_id", parts)


def w05_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows recorded before an earlier row of their source: by source time, late ones."""
    return log.blocked_watermarks(roles.log(spark, sf_dir), 4_096).filter("late").select("seq", "source_id")


def w06_source_watermark_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = log.blocked_watermarks(roles.log(spark, sf_dir), 4_096)
    return marked.select("seq", "source_id", text("watermark"), "late")


def w07_idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = log.deliveries(roles.log(spark, sf_dir), ["source_id", "subject", "k"])
    return keyed.select("seq", "first_seq", "duplicate")


def w08_attribute_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.changes(roles.objects(spark, sf_dir), ["status", "priority"])


def w09_trailing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.standing_since(roles.objects(spark, sf_dir), "status").select("object_id", "value", text("since"), "n")


def w10_prior_manifestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = Window.partitionBy("source_id", "subject").orderBy("seq")
    return roles.log(spark, sf_dir).select("seq", F.lag("seq").over(line).alias("prior_seq"))


def w11_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status is that of the last transition in the log, else the initial one, for every customer."""
    last = roles.objects(spark, sf_dir).groupBy("object_id").agg(F.max_by("status", "seq").alias("status"))
    every = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"))
    return every.join(last, "object_id", "left").withColumn("status", F.coalesce("status", F.lit("OPEN")))


def w12_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("O", "P"), ("P", "F"), ("O", "F")], "from_status string, to_status string")
    return versions.illegal_transitions(roles.objects(spark, sf_dir), allowed)


def w13_route_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation by falling score, ties by id."""
    from worldlog.operators import evidence

    supplier = roles.table(spark, sf_dir, "supplier")
    return evidence.ranked(supplier, "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"]).select("s_suppkey", "s_nationkey", "rank")


def w14_due_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches (source and subject) whose last run and cadence of k + 1 hours put them before the cut-off."""
    last = versions.latest(roles.log(spark, sf_dir), ["source_id", "subject"], ["recorded_time", "seq"])
    due = F.col("recorded_time") + F.make_dt_interval(F.lit(0), (F.col("k") + 1).cast("int"))
    return last.withColumn("next_due", due).filter(F.col("next_due") <= F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).select("source_id", "subject", text("next_due"))


def w16_activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 rows that the reader may see: access comes before the limit."""
    seen = access.visible(roles.markings(spark, sf_dir), READER).select("object_id")
    return roles.objects(spark, sf_dir).join(seen, "object_id", "left_semi").orderBy(F.desc("seq")).limit(50).select("seq", "object_id", "status")


def a02_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.log(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


def a16_marking_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marking of what is derived from all customers of a nation and segment."""
    customer = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), "c_nationkey", "c_mktsegment")
    n = F.col("object_id")
    caveats = F.when(n % 3 == 0, F.array(F.concat(F.lit("K"), n % 4), F.lit("NOTE"))).when(n % 3 == 1, F.array(F.concat(F.lit("K"), n % 5)))
    marked = roles.markings(spark, sf_dir).join(customer, "object_id").withColumns({"ord": n, "caveats": caveats})
    joined = access.joined_markings(marked, "c_nationkey", "c_mktsegment")
    return joined.select("c_nationkey", "c_mktsegment", "owning_authority", "min_role", "sealed", "caveats", F.array_join("compartments", ",").alias("compartments"), F.array_join("releasability", ",").alias("releasability"))


def a17_failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = roles.log(spark, sf_dir).select("subject", "seq", (F.col("value") >= 20).alias("ok"))
    return log.failure_streaks(attempts, "subject")


def a20_probability_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.moves(roles.objects(spark, sf_dir), "value", AT)


def a18_ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, repeated, late and quarantined rows of each source."""
    rows = log.deliveries(log.blocked_watermarks(roles.log(spark, sf_dir), 4_096), ["source_id", "subject", "k"])
    bad = F.col("value") < 1
    return rows.groupBy("source_id").agg(
        F.count("*").alias("received"), F.count_if("duplicate").alias("duplicates"), F.count_if("late").alias("late"),
        F.count_if(bad & ~F.col("duplicate")).alias("quarantined"), F.count_if(~bad & ~F.col("duplicate")).alias("accepted"),
    )


def t03_topk_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.objects(spark, sf_dir).orderBy(F.desc("valid_from"), F.desc("seq")).limit(10).select("seq", "object_id", text("valid_from"))


def t07_cap_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.log(spark, sf_dir).select("source_id", F.col("seq").alias("item"))
    told = rows.select("source_id", F.col("item").cast("string").alias("item"), F.col("item").alias("_o"))
    return log.with_cap(told, "source_id", ["_o"], 25)


def q03_changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came in after a log number, by status, as the reader sees them."""
    seen = access.visible(roles.markings(spark, sf_dir), READER).select("object_id")
    late = roles.objects(spark, sf_dir).filter(F.col("seq") > CUT).join(seen, "object_id", "left_semi")
    return late.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("n_objects"))


def s22_delta_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta that repeats, diverges, goes on, and leaves a gap."""
    parts = ["seq", "source_id", "subject"]
    whole = roles.log(spark, sf_dir).select("seq", log.entry_hash(*parts).alias("entry_hash"))
    bundle = whole.filter("seq > 400 AND seq NOT BETWEEN 501 AND 510").withColumn(
        "entry_hash", F.when(F.col("seq") % 97 == 0, F.lit("other")).otherwise(F.col("entry_hash"))
    )
    return log.delta_verdict(whole.filter("seq <= 500"), bundle)


def x_digest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.log(spark, sf_dir)
    return rows.select("seq", scalar.digest_id("ingest", F.col("source_id"), F.col("subject"), F.col("k")).alias("ingestion_id"))


_WEAK = """list_filter([CASE WHEN object_id % 10 < 5 THEN 'confidence' END, CASE WHEN object_id % 3 = 0 THEN 'mapping' END,
  CASE WHEN status = 'P' THEN 'review' END, CASE WHEN epoch(TIMESTAMP '2001-12-31' - valid_from) / 3600 > 8760 THEN 'freshness' END], lambda x: x IS NOT NULL)"""
_LATE = "max(source_time) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FIRST = "min(seq) OVER (PARTITION BY source_id, subject, k)"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

SQL = {
    "q01_mission_view": duck(
        f"""SELECT status, CASE WHEN epoch(TIMESTAMP '{SNAPSHOT}' - valid_from) / 3600 > 24 * 365 * 4 THEN 'STALE' ELSE 'FRESH' END AS freshness,
        count(*) AS n, max(version) AS most_versions FROM (SELECT * FROM objects WHERE seq <= {CUT} AND valid_from <= TIMESTAMP '{AT}'
        QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY valid_from DESC, version DESC) = 1) WHERE object_id IN ({VISIBLE_SQL}) GROUP BY 1, 2""",
        "objects", "markings",
    ),
    "p06_access_filter": duck(f"SELECT object_id, owning_authority, min_role FROM markings WHERE object_id IN ({VISIBLE_SQL})", "markings"),
    "w01_current_object": duck(CURRENT.format("valid_from DESC, version DESC"), "objects"),
    "w01_current_by_log": duck(CURRENT.format("seq DESC"), "objects"),
    "w01_latest_by_version": duck(CURRENT.format("version DESC, seq DESC"), "objects"),
    "w02_opening": duck(CURRENT.format("version"), "objects"),
    "j09_valid_asof": duck(f"SELECT object_id, version, status, value FROM objects WHERE valid_from <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY valid_from DESC, version DESC) = 1", "objects"),
    "j10_txn_asof": duck(f"SELECT object_id, version, status, value FROM objects WHERE seq <= {CUT} QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY valid_from DESC, version DESC) = 1", "objects"),
    "p09_freshness": duck(
        f"""SELECT object_id, CASE WHEN age_hours > 8760 THEN 'STALE' ELSE 'FRESH' END AS state, age_hours FROM (
        SELECT object_id, epoch(TIMESTAMP '{SNAPSHOT}' - max(valid_from)) / 3600 AS age_hours FROM objects GROUP BY 1)""", "objects"),
    "p10_quality_rollup": duck(
        f"""SELECT object_id, CASE WHEN len(weak) > 0 THEN 'DEGRADED' ELSE 'NOMINAL' END AS state, array_to_string(weak, ',') AS weak FROM (SELECT object_id, {_WEAK} AS weak FROM objects
        QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY valid_from DESC, version DESC) = 1)""", "objects"),
    "w03_version_continuity": duck("SELECT * FROM (SELECT object_id, seq, version, coalesce(lag(version) OVER (PARTITION BY object_id ORDER BY seq), 0) + 1 AS expected FROM objects) WHERE version <> expected", "objects"),
    "w04_hash_chain": duck(
        """, e AS (SELECT *, sha256(source_id || '|' || seq || '|' || subject || '|' || k) AS h FROM log),
        c AS (SELECT *, lag(h, 1, repeat('0', 64)) OVER (PARTITION BY source_id ORDER BY seq) AS p FROM e),
        t AS (SELECT *, sha256(source_id || '|' || seq || '|' || subject || '|' || CASE WHEN seq IN (17, 1000, 1001) THEN -1 ELSE k END) = h AS own_ok FROM c WHERE seq <> 500)
        SELECT * FROM (SELECT source_id, seq, own_ok, p = lag(h, 1, repeat('0', 64)) OVER (PARTITION BY source_id ORDER BY seq) AS link_ok FROM t) WHERE NOT own_ok OR NOT link_ok""", "log"),
    "w05_time_order": duck(f"SELECT seq, source_id FROM (SELECT *, {_LATE} AS before FROM log) WHERE source_time < before", "log"),
    "w06_source_watermark_late": duck(f"SELECT seq, source_id, {_STAMP.format('w')} AS watermark, coalesce(source_time < w, false) AS late FROM (SELECT *, {_LATE} AS w FROM log)", "log"),
    "w07_idempotent_ingest": duck(f"SELECT seq, {_FIRST} AS first_seq, seq > {_FIRST} AS duplicate FROM log", "log"),
    "w08_attribute_diff": duck(
        """, p AS (SELECT *, lag(status) OVER w AS s0, lag(priority) OVER w AS p0 FROM objects WINDOW w AS (PARTITION BY object_id ORDER BY version))
        SELECT object_id, version, 'status' AS attribute, s0 AS before, status AS after FROM p WHERE version > 1 AND s0 IS DISTINCT FROM status
        UNION ALL SELECT object_id, version, 'priority', p0, priority FROM p WHERE version > 1 AND p0 IS DISTINCT FROM priority""", "objects"),
    "w09_trailing_run": duck(
        f""", s AS (SELECT *, max(version) OVER (PARTITION BY object_id) AS top FROM objects),
        e AS (SELECT object_id, arg_max(status, version) AS value FROM objects GROUP BY 1),
        d AS (SELECT o.object_id, e.value, coalesce(max(o.version) FILTER (WHERE o.status <> e.value), 0) AS last_other FROM objects o JOIN e ON e.object_id = o.object_id GROUP BY 1, 2)
        SELECT d.object_id, d.value, {_STAMP.format('arg_min(o.valid_from, o.version)')} AS since, count(*) AS n FROM objects o JOIN d USING (object_id) WHERE o.version > last_other GROUP BY d.object_id, d.value""", "objects"),
    "w10_prior_manifestation": duck("SELECT seq, lag(seq) OVER (PARTITION BY source_id, subject ORDER BY seq) AS prior_seq FROM log", "log"),
    "w11_status_fold": "SELECT c_custkey AS object_id, coalesce(arg_max(o_orderstatus, o_orderkey), 'OPEN') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "w12_illegal_transitions": duck(
        """SELECT object_id, version, from_status, status AS to_status FROM (SELECT *, lag(status) OVER (PARTITION BY object_id ORDER BY version) AS from_status FROM objects)
        WHERE from_status <> status AND (from_status, status) NOT IN (('O', 'P'), ('P', 'F'), ('O', 'F'))""", "objects"),
    "w13_route_rank": "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier",
    "w14_due_watches": duck(
        f"""SELECT source_id, subject, {_STAMP.format('d')} AS next_due FROM (SELECT source_id, subject, arg_max(recorded_time + to_hours(k + 1), seq) AS d FROM log GROUP BY 1, 2)
        WHERE d <= TIMESTAMP '2024-01-29 12:00:00'""", "log"),
    "w16_activity_feed": duck(f"SELECT seq, object_id, status FROM objects WHERE object_id IN ({VISIBLE_SQL}) ORDER BY seq DESC LIMIT 50", "objects", "markings"),
    "a02_counts_by_type": duck("SELECT source_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high FROM log GROUP BY 1", "log"),
    "a16_marking_join": duck(
        """, m AS (SELECT * FROM markings JOIN customer ON c_custkey = object_id),
        g AS (SELECT c_nationkey, c_mktsegment, arg_min(owning_authority, object_id) AS owning_authority, count(DISTINCT owning_authority) AS owners, count(*) AS n,
          max(CASE min_role WHEN 'OBSERVER' THEN 0 WHEN 'ANALYST' THEN 1 ELSE 2 END) AS r, max(len(releasability)) AS longest FROM m GROUP BY 1, 2),
        c AS (SELECT c_nationkey, c_mktsegment, string_agg(DISTINCT x, ',' ORDER BY x) AS compartments FROM (SELECT *, unnest(compartments) AS x FROM m) GROUP BY 1, 2),
        l AS (SELECT c_nationkey, c_mktsegment, string_agg(x, ',' ORDER BY x) AS releasability FROM (SELECT c_nationkey, c_mktsegment, x, count(*) AS k FROM (SELECT *, unnest(releasability) AS x FROM m) GROUP BY ALL)
          JOIN g USING (c_nationkey, c_mktsegment) WHERE k = n GROUP BY 1, 2),
        e AS (SELECT c_nationkey, c_mktsegment, object_id * 2 + i AS p, x FROM (SELECT *, unnest(CASE object_id % 3 WHEN 0 THEN ['K' || object_id % 4, 'NOTE'] WHEN 1 THEN ['K' || object_id % 5] ELSE [] END) AS x, unnest(CASE object_id % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE [] END) AS i FROM m)),
        k AS (SELECT c_nationkey, c_mktsegment, string_agg(x, '; ' ORDER BY p) AS told FROM (SELECT c_nationkey, c_mktsegment, x, min(p) AS p FROM e GROUP BY ALL) GROUP BY 1, 2)
        SELECT c_nationkey, c_mktsegment, owning_authority, CASE WHEN s THEN 'SUPERVISOR' ELSE ['OBSERVER', 'ANALYST', 'SUPERVISOR'][r + 1] END AS min_role, s AS sealed, concat_ws('; ', told, CASE WHEN s THEN 'SEALED_UNJOINABLE_MARKINGS' END) AS caveats,
          compartments || CASE WHEN s THEN ',worldlog:unjoinable-seal' ELSE '' END AS compartments,
          CASE WHEN s THEN '' ELSE coalesce(releasability, '') END AS releasability
        FROM (SELECT *, releasability IS NULL AND (owners > 1 OR longest > 0) AS s FROM g JOIN c USING (c_nationkey, c_mktsegment) LEFT JOIN l USING (c_nationkey, c_mktsegment) LEFT JOIN k USING (c_nationkey, c_mktsegment))""", "markings"),
    "a17_failure_streak": duck("SELECT subject, count(*) FILTER (WHERE value < 20 AND seq > last) AS streak FROM log JOIN (SELECT subject, coalesce(max(seq) FILTER (WHERE value >= 20), -1) AS last FROM log GROUP BY 1) USING (subject) GROUP BY 1", "log"),
    "a20_probability_moves": duck(
        f"""SELECT object_id, count(*) FILTER (WHERE m) AS n_moves, count(*) FILTER (WHERE m AND valid_from > TIMESTAMP '{AT}') AS n_late
        FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY object_id ORDER BY version)) > 1e-9 AS m FROM objects) GROUP BY 1""", "objects"),
    "a18_ingest_metrics": duck(
        f"""SELECT source_id, count(*) AS received, count(*) FILTER (WHERE d) AS duplicates, count(*) FILTER (WHERE source_time < w) AS late,
        count(*) FILTER (WHERE value < 1 AND NOT d) AS quarantined, count(*) FILTER (WHERE NOT value < 1 AND NOT d) AS accepted
        FROM (SELECT *, {_LATE} AS w, seq > {_FIRST} AS d FROM log) GROUP BY 1""", "log"),
    "t03_topk_recent": duck(f"SELECT seq, object_id, {_STAMP.format('valid_from')} AS valid_from FROM (SELECT * FROM objects ORDER BY valid_from DESC, seq DESC LIMIT 10)", "objects"),
    "t07_cap_with_remainder": duck(
        """, r AS (SELECT source_id, seq, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM log)
        SELECT source_id, CAST(seq AS VARCHAR) AS item, CAST(1 AS BIGINT) AS n_items FROM r WHERE n <= 25 UNION ALL SELECT source_id, '(more)', count(*) - 25 FROM r GROUP BY 1 HAVING count(*) > 25""", "log"),
    "q03_changes_since": duck(f"SELECT status, count(*) AS n, count(DISTINCT object_id) AS n_objects FROM objects WHERE seq > {CUT} AND object_id IN ({VISIBLE_SQL}) GROUP BY 1", "objects", "markings"),
    "s22_delta_verdict": duck(
        """, d AS (SELECT seq, CASE WHEN seq > 500 THEN 'NEW' WHEN seq % 97 = 0 THEN 'DIVERGED' ELSE 'DUPLICATE' END AS verdict FROM log WHERE seq > 400 AND seq NOT BETWEEN 501 AND 510)
        SELECT verdict, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT 'MISSING_BASE', min(seq) - 501 FROM d WHERE verdict = 'NEW' HAVING min(seq) > 501""", "log"),
    "x_digest_ids": duck("SELECT seq, 'ingest-' || substr(sha256(source_id || '|' || subject || '|' || k), 1, 24) AS ingestion_id FROM log", "log"),
}

QUERIES = {
    f.__name__: f
    for f in (
        q01_mission_view, p06_access_filter, w01_current_object, w01_current_by_log, w01_latest_by_version, w02_opening, j09_valid_asof,
        j10_txn_asof, p09_freshness, p10_quality_rollup, w03_version_continuity, w04_hash_chain, w05_time_order, w06_source_watermark_late,
        w07_idempotent_ingest, w08_attribute_diff, w09_trailing_run, w10_prior_manifestation, w11_status_fold, w12_illegal_transitions,
        w13_route_rank, w14_due_watches, w16_activity_feed, a02_counts_by_type, a16_marking_join, a17_failure_streak, a20_probability_moves,
        a18_ingest_metrics, t03_topk_recent, t07_cap_with_remainder, q03_changes_since, s22_delta_verdict, x_digest_ids,
    )
}
