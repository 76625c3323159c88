"""Queries of the read models, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.operators import access, blocks, versions, views
from worldlog.roles import duck, table
from worldlog.streaming import live

from .state import CUT, READER, VISIBLE_SQL


def s03_family_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.log(spark, sf_dir).filter("source_id = 'click' AND seq <= 800").select("seq", "subject", "value")


def s15_custody_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return views.damaged(held, "content", "digest").select("doc_id")


def s17_response_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.log(spark, sf_dir)
    status = F.get(F.array(*map(F.lit, (200, 200, 401, 403, 404, 451, 500, 200))), (F.col("k") % 8).cast("int"))
    kind = views.response_class(status, F.when(F.col("k") % 23 == 0, F.lit("timeout")), F.floor(F.col("value") % 2))
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def s19_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.addressed(table(spark, sf_dir, "documents"), "text", "doc_id")


def p07_path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", views.path_value(F.col("props"), "k").alias("k"), views.path_value(F.col("props"), "a.b").alias("ab"))


def p12_capable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that serve a nation or all, speak a language or all, and answer fast enough."""
    languages = F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("mul"))).when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("de"), F.lit("fr"))).otherwise(F.array(F.lit("en")))
    places = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(-1))).otherwise(F.array("s_nationkey"))
    rows = table(spark, sf_dir, "supplier").withColumns({"languages": languages, "places": places})
    return rows.filter("arrays_overlap(languages, array('de', 'mul')) AND arrays_overlap(places, array(3, -1)) AND s_acctbal > 0").select("s_suppkey")


def p16_theme_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("k"))
    status = F.when(F.col("k") < 3, "CANDIDATE").when(F.col("k") < F.col("n"), "CONTESTED").when(F.col("n") >= 20, "ESTABLISHED").otherwise("EMERGING")
    return rows.select("source", "lang", status.alias("status"))


def p18_map_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.when(F.col("vec_id") % 5 > 0, F.col("embedding")[0]).alias("lon"))
    return e.groupBy("label").agg(F.count_if(F.col("lon").isNotNull()).alias("located"), F.count_if(F.col("lon").isNull()).alias("unlocated"))


def p19_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").filter(late & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_orderstatus")


def p20_inbound_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" see doc-"), (F.col("conv_id") * 13 + F.col("turn")).cast("string"), F.lit(", item-3.")).alias("said"))
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id")).union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id"))))
    keyed = rows.withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return views.cited_ids(keyed, "at", "said", known).filter("token LIKE 'doc-%' OR token LIKE 'item-%'")


def j17_overlapping_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers any of whose orders is among the changed ones, and how many."""
    orders = table(spark, sf_dir, "orders")
    changed = orders.filter("o_totalprice > 300000").select("o_orderkey")
    return orders.join(changed, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


def j19_resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a kind, of any kind, pinned to a version or not, some to nothing."""
    rows = roles.objects(spark, sf_dir)
    records = rows.select(F.when(F.col("object_id") % 2 == 0, "object").otherwise("claim").alias("kind"), F.col("object_id").cast("string").alias("id"), "version")
    cited = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 9).alias("id"))
    ids = cited.select(F.col("id").cast("string").alias("i"), F.get(F.array(*map(F.lit, ("object", "*", "claim"))), (F.col("id") % 3).cast("int")).alias("k"), F.when(F.col("id") % 4 == 0, "@v2").otherwise("").alias("v"))
    return views.resolved(ids.select(F.concat("k", F.lit(":"), "i", "v").alias("ref")), records)


def j23_stakeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is tied to the relevant set by a relation, with the role: customers of its suppliers, suppliers of its customers."""
    rows, own = roles.relations(spark, sf_dir), ("source_id", "target_id")
    nations = table(spark, sf_dir, "nation").filter("n_nationkey < 3").select("n_nationkey")
    relevant = {
        "source_id": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("relevant"), F.col("c_nationkey").alias("n_nationkey")),
        "target_id": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("relevant"), F.col("s_nationkey").alias("n_nationkey")),
    }
    sides = [
        rows.join(relevant[b].join(nations, "n_nationkey", "left_semi"), rows[b] == F.col("relevant"), "left_semi")
        .groupBy(F.lit(a.removesuffix("_id")).alias("role"), F.col(a).alias("stakeholder"))
        .agg(F.count("*").alias("n_ties"), F.sum("n_lines").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))
        for a, b in (own, own[::-1])
    ]
    return sides[0].union(sides[1])


def a03_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the overview, one row each, after access."""
    seen = access.visible(roles.markings(spark, sf_dir), READER).select("object_id")
    mine = roles.objects(spark, sf_dir).join(seen, "object_id", "left_semi")
    one = mine.agg(F.count("*").alias("versions"), F.count_distinct("object_id").alias("objects"), F.count_if(F.col("status") == "O").alias("open"), F.count_if(F.col("priority") == "1-URGENT").alias("urgent"))
    return one.unpivot([], ["versions", "objects", "open", "urgent"], "measure", "n")


def a10_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's id is the hash of its sorted members: the same members give the same id."""
    members = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s_suppkey")), lambda x: x.cast("string")), "|").alias("m"))
    return members.select("s_nationkey", F.substring(F.sha2("m", 256), 1, 24).alias("group_id"))


def a15_weakest_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.get(F.array(*map(F.lit, views.AUTHORITY)), (F.col("o_orderkey") % 11 % 4).cast("int")).alias("authority"))
    return views.weakest_authority(rows, "o_custkey")


def a19_hypothesis_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts behind the documents that still stand, by language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 0 OR toxic = 1")
    return docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count_distinct(F.md5("text")).alias("n_groups"), F.count("*").alias("n"))


def a21_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"))


def t04_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open ones first, then by time."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("late"), "o_orderdate")
    return blocks.placed(rows, ["late", "o_orderdate", "o_orderkey"]).select("o_orderkey", "late", "place")


def t08_least_exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes (suppliers) by distinct disruptions (parts), and the least exposed one's mark."""
    lines = table(spark, sf_dir, "lineitem")
    found = lines.select(F.col("l_suppkey").alias("route"), F.col("l_partkey").alias("disruption"), F.col("l_linestatus").alias("condition"), F.col("l_linenumber").alias("rank"))
    exposed = views.route_exposure(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route")), found)
    least = exposed.agg(F.min_by("route", F.struct("n", "route")).alias("best"))
    return exposed.join(F.broadcast(least)).select("route", "n", (F.col("route") == F.col("best")).alias("least"))


def g03_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents against those of conversations: in one only, or in both."""
    a, b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("left"))).union(b.subtract(a).withColumn("side", F.lit("right")))


def g12_ascent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rests on each nation's suppliers: lines, orders, customers."""
    lines, orders, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    way = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return way.groupBy("s_nationkey").agg(F.count("*").alias("n_lines"), F.count_distinct("o_orderkey").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


def g14_invalidated_assumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part fails: orders with it are stale, and their customers exposed by how many stale orders."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    stale = lines.filter("l_partkey % 97 = 5").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders.join(stale, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n_stale"), F.sum("o_totalprice").alias("value"))


def f15_name_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(views.folded(F.col("text"))).alias("folded"))


def f16_quoted_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('The firm "'), "c_name", F.lit('" of '), "c_mktsegment").alias("said"))
    return rows.select("c_custkey", F.regexp_extract("said", '"([^"]{3,})"', 1).alias("name"))


def f31_edge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the edges of one path, ten fields an edge, in the order of their keys."""
    ten = {
        "from_kind": F.lit("customer"), "from_id": F.col("o_custkey").cast("string"), "to_kind": F.lit("order"), "to_id": F.col("o_orderkey").cast("string"), "edge_kind": F.col("o_orderstatus"),
        "effect_order": F.when(F.col("o_orderkey") % 2 == 0, "FIRST").otherwise("SECOND"), "authority": F.lit("OBSERVED"), "basis_ids": F.array(F.lit("b1"), F.col("o_orderpriority")),
        "assumption_ids": F.array().cast("array<string>"), "note": F.repeat(F.lit("why "), 90),
    }
    edges = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct(*[c.alias(n) for n, c in ten.items()]).alias("edge"))
    paths = edges.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "edge"))).alias("e"))
    return paths.select("o_custkey", views.edge_chain(F.col("e.edge")).alias("chain"))


def q33_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit counts: anchors that do not resolve, and versions older than what they replace."""
    objects = roles.objects(spark, sf_dir)
    line = Window.partitionBy("object_id").orderBy("version")
    older = objects.select((F.col("seq") < F.lag("seq").over(line)).alias("late")).agg(F.count_if("late").alias("n"))
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    lost = lines.select((F.col("l_partkey") + 3).alias("p_partkey")).join(parts, "p_partkey", "left_anti").agg(F.count("*").alias("n"))
    return older.select(F.lit("REPLACES_NEWER").alias("finding"), "n").union(lost.select(F.lit("ANCHOR_UNRESOLVED"), "n"))


def q34_stale_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale records of several families in one list."""
    orders = table(spark, sf_dir, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1998-02-01 00:00:00'").select(F.lit("order").alias("family"), F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ '1998-02-01 00:00:00'").select(F.lit("line"), F.col("l_orderkey")).distinct()
    return orders.union(lines)


def q38_action_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a signed action, each of the ten refusals for some of them."""
    rows, k = roles.log(spark, sf_dir), F.col("k")
    bad = lambda n: k % 23 == n
    actions = rows.select(
        F.col("seq").alias("action_id"), (F.col("subject") % 50).alias("session_id"), F.when(bad(2), -1).otherwise(F.col("subject") % 50).alias("actor"), F.when(bad(3), "other").otherwise("mission").alias("mission_id"),
        F.when(bad(4), "x").otherwise("object").alias("target"), F.when(bad(5), F.lit(None)).otherwise(F.col("subject") * 1000 + k).alias("nonce"), F.when(bad(6), 1).otherwise(2).alias("version"),
        F.when(bad(7), F.lit(None)).when(bad(8), 1400).otherwise(1000 + k % 300).alias("at"), F.md5(k.cast("string")).alias("digest"), F.md5(F.when(bad(9), "x").otherwise(k.cast("string"))).alias("said_digest"),
    )
    n = F.col("id")
    sessions = spark.range(50).filter("id % 7 <> 1").select(n.alias("session_id"), n.alias("actor"), n.alias("key_id"))
    keys = spark.range(50).filter("id % 11 <> 4").select(n.alias("key_id"), F.when(n % 5 == 0, 1100).otherwise(10).alias("status_time"), n.alias("seq"), F.lit("VALID").alias("status"))
    keys = keys.union(keys.filter("key_id % 9 = 3").select("key_id", "status_time", F.col("seq") + 100, F.lit("REVOKED")))
    return views.admission(actions, sessions, keys, {"mission_id": "mission", "target": "object", "version": 2}, 1000)


def f29_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that cite documents, those of toxic labels hidden."""
    cite = F.concat(F.lit("see doc-"), (F.col("conv_id") * 3 % 900).cast("string"), F.lit("@v2, doc-"), F.col("conv_id").cast("string"), F.lit(" and item-1."))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ref"), cite.alias("said"))
    hidden = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"))
    return views.redacted(rows, "ref", "said", hidden)


def p03_field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a feed: status in upper case, price as a number, a day, a default for what is missing."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lower("o_orderpriority").alias("urgency"), F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise("2.5").alias("price"),
        F.when(F.col("o_orderkey") % 3 > 0, F.lit("2024-03-05T10:00:00Z")).alias("seen"), F.lit("x").alias("unmapped"),
    )
    return views.mapped(rows, "o_orderkey", [("priority", "urgency", "upper", None), ("price", "price", "number", None), ("day", "seen", "day", "UNKNOWN")])


def r08_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [(1, "click", 99.9, "2024-01-03", "view"), (2, "click", 50.0, "2024-01-20", "view"), (3, "view", 1000.0, "2024-01-20", "click"), (4, "view", 1000.0, "2024-03-20", "click"), (5, "none", 0.0, "2024-01-02", "nobody")]
    indicators = spark.createDataFrame(named, "indicator_id long, attribute string, least double, day string, source string").withColumn("deadline", F.col("day").cast("timestamp_ntz"))
    rows = roles.log(spark, sf_dir)
    return live.absent(indicators, rows.withColumnRenamed("source_id", "attribute"), rows.select(F.col("source_id").alias("source"), F.col("recorded_time").alias("searched_time")))


def r10_changed_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose state or value class moved between the cut and now: what a pass appends."""
    rows = roles.objects(spark, sf_dir)
    state = lambda some: versions.current_by_log(some).select("object_id", "status", F.when(F.col("value") > 100_000, "HIGH").alias("band"))
    return live.changed_only(state(versions.known_by(rows, CUT)), state(rows), "object_id", ["status", "band"])


_CODES = "['OBSERVED', 'DERIVED', 'INFERRED', 'ASSUMED']"
SQL = {
    "s03_family_scan": duck("SELECT seq, subject, value FROM log WHERE source_id = 'click' AND seq <= 800", "log"),
    "s15_custody_damage": "SELECT doc_id FROM documents WHERE doc_id % 50 = 7",
    "s17_response_class": duck(
        """SELECT CASE WHEN s IN (401, 403, 451) THEN 'ACCESS_RESTRICTED' WHEN s >= 400 OR k % 23 = 0 THEN 'FAILED' WHEN floor(value % 2) > 0 THEN 'OK' ELSE 'EMPTY' END AS outcome, count(*) AS n
        FROM (SELECT *, [200, 200, 401, 403, 404, 451, 500, 200][k % 8 + 1] AS s FROM log) GROUP BY 1""", "log"),
    "s19_content_addressed": "SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS n, left(sha256(text), 2) AS shelf FROM documents GROUP BY text",
    "p07_path_projection": "SELECT event_id, props->>'$.k' AS k, 'UNKNOWN' AS ab FROM events",
    "p12_capable_sources": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND (s_suppkey % 3 = 0 OR s_nationkey = 3) AND s_acctbal > 0",
    "p16_theme_status": "SELECT source, lang, CASE WHEN k < 3 THEN 'CANDIDATE' WHEN k < n THEN 'CONTESTED' WHEN n >= 20 THEN 'ESTABLISHED' ELSE 'EMERGING' END AS status FROM (SELECT source, lang, count(*) AS n, count(DISTINCT text) AS k FROM documents GROUP BY 1, 2)",
    "p18_map_view": "SELECT label, count(*) FILTER (WHERE vec_id % 5 > 0) AS located, count(*) FILTER (WHERE vec_id % 5 = 0) AS unlocated FROM embeddings GROUP BY 1",
    "p19_overdue": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderstatus <> 'F'",
    "p20_inbound_references": r"""WITH f AS (SELECT DISTINCT conv_id * 1000 + turn AS "at", unnest(regexp_extract_all(text || ' see doc-' || (conv_id * 13 + turn) || ', item-3.', '\b([a-z]+-[0-9]+)\b', 1)) AS token FROM conversations)
        SELECT "at", token FROM f WHERE (token LIKE 'doc-%' OR token LIKE 'item-%') AND token NOT IN (SELECT 'doc-' || doc_id FROM documents UNION ALL SELECT 'item-' || item_id FROM benchmark)""",
    "j17_overlapping_basis": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1",
    "j19_resolve_references": duck(
        """, r AS (SELECT CASE WHEN object_id % 2 = 0 THEN 'object' ELSE 'claim' END AS kind, object_id AS id, version FROM objects),
        a AS (SELECT c_custkey + 9 AS i, ['object', '*', 'claim'][i % 3 + 1] AS k, i % 4 = 0 AS pinned FROM customer)
        SELECT k || ':' || i || CASE WHEN pinned THEN '@v2' ELSE '' END AS ref, max(kind) AS kind, max(version) AS version FROM a LEFT JOIN r ON r.id = i AND (k = '*' OR k = kind) AND (NOT pinned OR version = 2) GROUP BY 1""", "objects"),
    "j23_stakeholders": duck(
        """SELECT 'source' AS role, source_id AS stakeholder, count(*) AS n_ties, CAST(sum(n_lines) AS BIGINT) AS n_lines, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags
        FROM relations WHERE target_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 3) GROUP BY 2 UNION ALL
        SELECT 'target', target_id, count(*), CAST(sum(n_lines) AS BIGINT), string_agg(DISTINCT flag, ',' ORDER BY flag) FROM relations WHERE source_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 3) GROUP BY 2""", "relations"),
    "a03_overview": duck(
        f""", m AS (SELECT * FROM objects WHERE object_id IN ({VISIBLE_SQL})) SELECT 'versions' AS measure, count(*) AS n FROM m UNION ALL SELECT 'objects', count(DISTINCT object_id) FROM m
        UNION ALL SELECT 'open', count(*) FILTER (WHERE status = 'O') FROM m UNION ALL SELECT 'urgent', count(*) FILTER (WHERE priority = '1-URGENT') FROM m""", "objects", "markings"),
    "a10_group_ids": "SELECT s_nationkey, left(sha256(string_agg(CAST(s_suppkey AS VARCHAR), '|' ORDER BY s_suppkey)), 24) AS group_id FROM supplier GROUP BY 1",
    "a15_weakest_authority": f"SELECT o_custkey, {_CODES}[max(o_orderkey % 11 % 4) + 1] AS authority FROM orders GROUP BY 1",
    "a19_hypothesis_independence": "SELECT lang, count(DISTINCT text) AS n_groups, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1) GROUP BY 1",
    "a21_status_counts": "SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY 1",
    "t04_review_queue": "SELECT o_orderkey, late, row_number() OVER (ORDER BY late, o_orderdate, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS late FROM orders)",
    "t08_least_exposed": """WITH e AS (SELECT s_suppkey AS route, count(DISTINCT l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)
        SELECT route, n, route = (SELECT route FROM e ORDER BY n, route LIMIT 1) AS least FROM e""",
    "g03_set_difference": """WITH a AS (SELECT doc_id AS id FROM documents), b AS (SELECT conv_id AS id FROM conversations)
        SELECT id, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT id, 'left' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT id, 'right' FROM (FROM b EXCEPT FROM a)""",
    "g12_ascent": "SELECT s_nationkey, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "g14_invalidated_assumption": "SELECT o_custkey, count(*) AS n_stale, sum(o_totalprice) AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 97 = 5) GROUP BY 1",
    "f15_name_folding": "SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS folded FROM documents",
    "f16_quoted_name": "SELECT c_custkey, c_name AS name FROM customer",
    "f31_edge_chain": """SELECT o_custkey, string_agg('edgefp-' || left(sha256(concat_ws('|', 'customer', o_custkey, 'order', o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'FIRST' ELSE 'SECOND' END,
        'OBSERVED', 'b1,' || o_orderpriority, '', left(repeat('why ', 90), 300))), 24), '>' ORDER BY o_orderkey) AS chain FROM orders GROUP BY 1""",
    "q33_faithfulness": duck(
        """SELECT 'REPLACES_NEWER' AS finding, count(*) AS n FROM (SELECT seq, lag(seq) OVER (PARTITION BY object_id ORDER BY version) AS p FROM objects) WHERE seq < p
        UNION ALL SELECT 'ANCHOR_UNRESOLVED', count(*) FROM lineitem WHERE l_partkey + 3 NOT IN (SELECT p_partkey FROM part)""", "objects"),
    "q34_stale_listing": "SELECT 'order' AS family, o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1998-02-01' UNION ALL SELECT DISTINCT 'line', l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-02-01'",
    "q38_action_admission": duck(
        """, a AS (SELECT seq, subject % 50 AS s, k % 23 AS b, subject * 1000 + k AS nonce, CASE k % 23 WHEN 7 THEN NULL WHEN 8 THEN 1400 ELSE 1000 + k % 300 END AS "at" FROM log),
        f AS (SELECT *, min(seq) OVER (PARTITION BY CASE WHEN b <> 5 THEN nonce END) AS first FROM a)
        SELECT seq AS action_id, CASE WHEN s % 7 = 1 THEN 'EXPIRED_SESSION' WHEN b = 2 THEN 'WRONG_ACTOR' WHEN b = 3 THEN 'WRONG_MISSION' WHEN b = 4 THEN 'WRONG_TARGET'
          WHEN b = 5 OR seq > first THEN 'REPLAYED_NONCE' WHEN b = 6 THEN 'STALE_VERSION' WHEN b IN (7, 8) THEN 'CLOCK_SKEW' WHEN s % 11 = 4 OR b = 9 THEN 'INVALID_SIGNATURE'
          WHEN s % 9 = 3 OR (s % 5 = 0 AND "at" < 1100) THEN 'KEY_NOT_VALID' END AS code FROM f""", "log"),
    "f29_redaction": """WITH t AS (SELECT conv_id * 1000 + turn AS ref, conv_id * 3 % 900 AS a, conv_id AS b FROM conversations), h AS (SELECT doc_id FROM labels WHERE toxic = 1)
        SELECT ref, 'see ' || CASE WHEN a IN (FROM h) THEN 'REDACTED' ELSE 'doc-' || a || '@v2' END || ', ' || CASE WHEN b IN (FROM h) THEN 'REDACTED' ELSE 'doc-' || b END || ' and item-1.' AS said FROM t""",
    "p03_field_mapping": """SELECT o_orderkey, upper(o_orderpriority) AS priority, CASE WHEN o_orderkey % 4 <> 0 THEN '2.5' END AS price, CASE WHEN o_orderkey % 3 > 0 THEN '2024-03-05' ELSE 'UNKNOWN' END AS day,
        concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'price lost by number' END, CASE WHEN o_orderkey % 3 = 0 THEN 'seen missing' END) AS warnings FROM orders""",
    "r08_absence": duck(
        """, i AS (SELECT * FROM (VALUES (1::BIGINT, 'click', 99.9, TIMESTAMP '2024-01-03', 'view'), (2, 'click', 50.0, TIMESTAMP '2024-01-20', 'view'), (3, 'view', 1000.0, TIMESTAMP '2024-01-20', 'click'),
          (4, 'view', 1000.0, TIMESTAMP '2024-03-20', 'click'), (5, 'none', 0.0, TIMESTAMP '2024-01-02', 'nobody')) v(indicator_id, attribute, least, deadline, source))
        SELECT indicator_id, CASE WHEN EXISTS (SELECT 1 FROM log WHERE source_id = attribute AND value >= least AND source_time <= deadline) THEN 'DEFEATED'
          WHEN EXISTS (SELECT 1 FROM log WHERE source_id = i.source AND recorded_time > deadline) THEN 'FIRED' ELSE 'BLOCKED' END AS verdict FROM i""", "log"),
    "r10_changed_warnings": duck(
        f""", s AS (SELECT object_id, arg_max(status, seq) AS status, CASE WHEN arg_max(value, seq) > 100000 THEN 'HIGH' END AS band FROM objects GROUP BY 1),
        w AS (SELECT object_id, arg_max(status, seq) AS s0, CASE WHEN arg_max(value, seq) > 100000 THEN 'HIGH' END AS b0 FROM objects WHERE seq <= {CUT} GROUP BY 1)
        SELECT object_id, status, band FROM s LEFT JOIN w USING (object_id) WHERE s0 IS NULL OR status <> s0 OR band IS DISTINCT FROM b0""", "objects"),
}

QUERIES = {
    f.__name__: f
    for f in (
        s03_family_scan, s15_custody_damage, s17_response_class, s19_content_addressed, p07_path_projection, p12_capable_sources, p16_theme_status,
        p18_map_view, p19_overdue, p20_inbound_references, j17_overlapping_basis, j19_resolve_references, j23_stakeholders, a03_overview,
        a10_group_ids, a15_weakest_authority, a19_hypothesis_independence, a21_status_counts, t04_review_queue, t08_least_exposed,
        g03_set_difference, g12_ascent, g14_invalidated_assumption, f15_name_folding, f16_quoted_name, f31_edge_chain, q33_faithfulness,
        q34_stale_listing, q38_action_admission, f29_redaction, p03_field_mapping, r08_absence, r10_changed_warnings,
    )
}
