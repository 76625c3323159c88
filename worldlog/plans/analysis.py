"""Queries over evidence, coverage, calibration, association and graphs, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.functions import scalar
from worldlog.operators import access, evidence, graph, log, versions
from worldlog.roles import duck, table

from .state import AT, CUT, READER, VISIBLE_SQL

HORIZON = "1999-06-30 00:00:00"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations; labels of quality 0 degrade what rests on them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        "lang", F.col("source").alias("source_id"), F.col("doc_id").alias("observation_id"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("degraded"), F.col("n_chars").alias("state_time"), "text",
    )


def a01_evidence_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _claims(spark, sf_dir).withColumn("bucket", F.col("observation_id") % 100)
    return evidence.basis(links, "bucket")


def f25_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _claims(spark, sf_dir).withColumn("bucket", F.col("observation_id") % 400)
    rest = evidence.basis(links, "bucket")
    return rest.select("bucket", scalar.evidence_confidence(F.col("n_sources"), F.col("n_degraded")).alias("confidence"))


def j02_claim_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"))
    state = F.when(F.col("toxic") == 1, "WITHDRAWN").when(F.col("quality") == 0, "DISPUTED").otherwise("CURRENT")
    states = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), state.alias("state"), F.col("doc_id").alias("seq"))
    return evidence.standing(claims, states, "UNREVIEWED")


def a08_source_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts, languages and distinct texts stand behind each source's documents."""
    keyed = _claims(spark, sf_dir).withColumn("digest", F.md5("text"))
    return keyed.groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_distinct("digest").alias("n_texts"), F.count_distinct("lang").alias("n_languages"),
        (F.max("state_time") - F.min("state_time")).alias("spread"),
    )


def a09_dependence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two documents or more share: size, the least member, and how many sources repeat it."""
    keyed = _claims(spark, sf_dir).withColumn("group_id", F.sha2("text", 256))
    groups = keyed.groupBy("group_id").agg(F.count("*").alias("n"), F.min("observation_id").alias("first"), F.count_distinct("source_id").alias("n_sources"))
    return groups.filter("n >= 2")


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and conversation turns as searches of the document that they name; most documents have none."""
    names = F.array(*map(F.lit, ("EXECUTED_WITH_RESULTS", "EXECUTED_EMPTY", "ACCESS_RESTRICTED", "SOURCE_FAILED", "POLICY_REFUSED", "OTHER")))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, F.col("quality")).otherwise((F.col("doc_id") + F.col("toxic")) % 6).alias("which"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), ((F.col("conv_id") + F.col("turn")) % 4).alias("which"))
    return labels.union(turns).select("source_id", F.get(names, F.col("which").cast("int")).alias("outcome"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.concat_ws("/", "source", "lang")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), family.alias("family"), (F.col("doc_id") % 7 != 0).alias("has_profile"))
    return evidence.coverage(sources, _executions(spark, sf_dir))


def a05_coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).select("source_id", "state")


def a06_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each state, and families none of whose sources was searched."""
    rows = _coverage(spark, sf_dir)
    by_state = rows.groupBy(F.col("state").alias("label")).agg(F.count("*").alias("n"))
    unsearched = rows.groupBy("family").agg(F.bool_and(F.col("state").isin("NOT_SEARCHED", "UNKNOWN")).alias("none")).filter("none")
    return by_state.union(unsearched.agg(F.lit("(families unsearched)"), F.count("*")))


def a07_coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ["COVERED", "PARTIALLY_COVERED", "NOT_SEARCHED", "UNKNOWN"]
    cells = _coverage(spark, sf_dir).groupBy("family").pivot("state", states).agg(F.count(F.lit(1)))
    return cells.select("family", *[F.coalesce(s, F.lit(0).cast("long")).alias(s.lower()) for s in states])


def a11_scoreboard_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scoreboard(evidence.scored(roles.forecasts(spark, sf_dir)), "author", "domain", "band")


def a12_reliability_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reliability(roles.forecasts(spark, sf_dir))


def a13_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.calibration_error(roles.forecasts(spark, sf_dir))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible(roles.markings(spark, sf_dir), READER).select("object_id")


def j03_visible_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose two ends the reader may see: the customer, and the supplier's nation through some visible customer."""
    seen = _seen(spark, sf_dir)
    nations = table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == seen.object_id, "left_semi").select("c_nationkey").distinct()
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == nations.c_nationkey, "left_semi").select("s_suppkey")
    rows = roles.relations(spark, sf_dir)
    ends = rows.join(seen, rows.source_id == seen.object_id, "left_semi").join(suppliers, F.col("target_id") == suppliers.s_suppkey, "left_semi")
    return ends.select("source_id", "target_id", "n_lines")


def j04_visible_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplies (a part from a supplier) all of whose buyers the reader may see: a hidden buyer hides the supply; no list
    of buyers is collected."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supply = ["l_partkey", "l_suppkey"]
    buyers = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(*supply, F.col("o_custkey").alias("object_id")).distinct()
    hidden = buyers.join(_seen(spark, sf_dir), "object_id", "left_anti").select(*supply).distinct()
    return buyers.select(*supply).distinct().join(hidden, supply, "left_anti")


def j05_unprocessed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "source")


def j06_phantom_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that nothing has, and how often they are cited."""
    cited = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 40).alias("cited"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cited"))
    return cited.groupBy("cited").agg(F.count("*").alias("n")).join(known, "cited", "left_anti")


def j07_observation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the customers' current states say now against what they said at the cut."""
    kinds = F.array(*map(F.lit, ("RELATION", "EVENT", "ENTITY_ATTRIBUTE", "ROLE_SIGNAL", "MEASURE")))
    told = lambda rows: versions.current_by_log(rows).filter("seq % 5 <> 0").select("object_id", F.get(kinds, (F.col("object_id") % 5).cast("int")).alias("kind"), F.col("status").alias("value"), (F.col("object_id") % 11 == 0).alias("corrects"))
    rows = roles.objects(spark, sf_dir)
    return evidence.observation_changes(told(versions.known_by(rows, CUT)), told(rows), ["object_id"])


def j08_feed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls of a feed: current states known by the cut, of those that it had, and all of them now."""
    rows = roles.objects(spark, sf_dir).withColumn("digest", F.md5("status"))
    was = versions.current_by_log(versions.known_by(rows, CUT // 10))
    now = versions.current_by_log(rows).filter("object_id % 13 <> 0")
    return log.snapshot_diff(was, now, "object_id", "digest")


def j11_standing_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = roles.objects(spark, sf_dir).withColumn("probability", (F.col("seq") * 37 % 99 + 1) / 100.0)
    horizons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), F.lit(HORIZON).cast("timestamp_ntz").alias("horizon"))
    return evidence.standing_probability(told, horizons)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (e[0].cast("double") * 180).alias("lon"), (e[1].cast("double") * 90).alias("lat"))


def j12_spatial_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    near = evidence.within_distance(points, points, 400_000.0).filter("id < place_id")
    return near.select("id", "place_id", F.round("metres", 3).alias("metres"))


def j13_conflicting_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("target"), F.col("l_returnflag").alias("status"), F.col("l_partkey").alias("report_id"))
    return evidence.conflicting_reports(reports)


def j14_shared_identifier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.lit("text").alias("system"), F.md5("text").alias("external_id"))
    return evidence.shared_identifiers(refs)


def j15_association_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's version against the next one, as if they were two objects."""
    rows = roles.objects(spark, sf_dir)
    side = lambda p, shift: rows.select(
        "object_id", (F.col("version") + shift).alias("version"), F.when(F.col("seq") % 4 > 0, "A").otherwise("B").alias(f"{p}_type"),
        F.when(F.col("seq") % 3 == 0, F.col("object_id")).alias(f"{p}_ref"), F.col("valid_from").alias(f"{p}_time"),
        (F.col("seq") % 360 - 180.0).alias(f"{p}_lon"), (F.col("seq") % 170 - 85.0).alias(f"{p}_lat"), F.col("status").alias(f"{p}_status"),
    )
    pairs = side("l", 0).join(side("r", -1), ["object_id", "version"])
    return evidence.association_features(pairs).select("object_id", "version", "identifier", "type", "temporal", "geospatial", "contradiction", "outcome")


def j16_propagation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.md5(scalar.normal_statement(F.col("text"))).alias("statement"), "doc_id", "source", F.col("doc_id").alias("at"))
    return evidence.propagation(rows).select("doc_id", "origin", "relation")


def j18_dependency_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each customer, part and supplier, as counts of the bridge's rows."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("on")
    bridge = (
        orders.select(key("customer", "o_custkey"), F.col("o_orderkey").alias("dependent"))
        .unionByName(lines.select(key("part", "l_partkey"), F.col("l_orderkey").alias("dependent")))
        .unionByName(lines.select(key("supplier", "l_suppkey"), F.col("l_orderkey").alias("dependent")))
    )
    return bridge.groupBy("on").agg(F.count_distinct("dependent").alias("n"))


def j21_path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a part with returned lines of the first supplier."""
    lines = table(spark, sf_dir, "lineitem")
    cited = lines.filter("l_suppkey = 1 AND l_returnflag = 'R'").select("l_partkey").distinct()
    return lines.join(cited, "l_partkey", "left_semi").select("l_orderkey").distinct()


def j20_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.log(spark, sf_dir).filter(F.col("recorded_time").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-06 12:00:00").cast("timestamp_ntz")))
    return rows.select("seq", "source_id")


def g01_timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of record on one line of time, counted by day and kind."""
    day = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd").alias("day")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kinds = (
        orders.select(day("o_orderdate"), F.lit("ORDERED").alias("kind"))
        .unionByName(lines.select(day("l_shipdate"), F.lit("SHIPPED").alias("kind")))
        .unionByName(roles.log(spark, sf_dir).select(day("recorded_time"), F.lit("RECORDED").alias("kind")))
    )
    return kinds.filter("day IS NOT NULL").groupBy("day", "kind").agg(F.count("*").alias("n"))


def _same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text are the same, and so are those of one source, language and length: stars on the least one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.concat_ws("/", "source", "lang", "n_chars").alias("shape"))
    star = lambda key: docs.join(docs.groupBy(key).agg(F.min("doc_id").alias("dst")), key).select(F.col("doc_id").alias("src"), "dst")
    return star("digest").union(star("shape"))


def g05_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_same_as(spark, sf_dir))


def g06_theme_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of at least three claims (documents): how many each has."""
    sizes = graph.components(_same_as(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.filter("n >= 3")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.relations(spark, sf_dir)
    return rows.select(F.concat(F.lit("c"), F.col("source_id")).alias("src"), F.concat(F.lit("s"), F.col("target_id")).alias("dst"))


def g07_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(_trade(spark, sf_dir), spark.createDataFrame([("c1",), ("c2",)], "node string"), 2)


def g08_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_hops(_trade(spark, sf_dir), "c7", 3)


def _rests_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document rests on that of its half number, if both have the language: a forest with deep chains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    up = docs.select(F.col("doc_id").alias("src"), F.col("lang").alias("_lang"))
    return docs.filter("doc_id > 0").join(up, (F.expr("doc_id div 2") == up.src) & (docs.lang == up["_lang"])).select("src", F.col("doc_id").alias("dst"))


def g09_transitive_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependents(_rests_on(spark, sf_dir), spark.range(1, 64).withColumnRenamed("id", "node"))


def g11_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, order, customer, nation, region; what the reader may not see is a REDACTED hop that does not end the way."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    seen = _seen(spark, sf_dir).withColumn("visible", F.lit(True))
    way = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(seen, F.col("c_custkey") == seen.object_id, "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return way.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("visible"), F.col("c_name")).otherwise("REDACTED").alias("customer"), F.col("r_name").alias("region"))


def q14_hypothesis_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against statuses: how many lines support, how many contradict."""
    stance = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("s"), "l_linestatus")
    cells = stance.groupBy("l_partkey").pivot("l_linestatus", ["F", "O"]).agg(F.sum("s"))
    return cells.select("l_partkey", *[F.coalesce(c, F.lit(0).cast("long")).alias(c.lower()) for c in ("F", "O")])


def f08_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", F.round(scalar.haversine_m(F.col("lon"), F.col("lat"), F.lit(13.4), F.lit(52.5)), 3).alias("metres"))


def f09_point_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))])
    return _points(spark, sf_dir).select("id", F.round(scalar.point_to_line_m(F.col("lon"), F.col("lat"), line), 2).alias("metres"))


def f25_warning_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    consequence = F.get(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), (F.col("forecast_id") % 4).cast("int"))
    confidence = F.get(F.array(*map(F.lit, ("NONE", "WEAK", "MODERATE", "STRONG"))), (F.col("forecast_id") % 7 % 4).cast("int"))
    rows = roles.forecasts(spark, sf_dir).select(
        "forecast_id", scalar.probability_band(F.col("probability")).alias("band"), consequence.alias("consequence"),
        scalar.time_pressure(F.col("days") * 24 - 240).alias("pressure"), confidence.alias("confidence"),
    )
    return rows.withColumn("tier", scalar.warning_tier(F.col("band"), F.col("consequence"), F.col("pressure"), F.col("confidence")))


def f26_route_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted factors of each supplier, zero where independence is asked for and absent."""
    rows = table(spark, sf_dir, "supplier")
    score = 0.5 * F.col("s_acctbal") / 10_000 + 0.3 * (F.col("s_nationkey") / 25.0) + 0.2 * (F.col("s_suppkey") % 10 / 10.0)
    return rows.select("s_suppkey", F.when(F.col("s_suppkey") % 6 == 0, 0.0).otherwise(score).alias("score"))


_CLAIMS = """, claims AS (SELECT lang, source AS source_id, doc_id AS observation_id, coalesce(quality = 0, false) AS degraded, n_chars AS state_time, text FROM documents LEFT JOIN labels USING (doc_id))"""
_BASIS = """SELECT observation_id % {} AS bucket, count(DISTINCT observation_id) AS n_observations, count(DISTINCT source_id) AS n_sources, count(DISTINCT lang) AS n_languages,
  count(*) FILTER (WHERE degraded) AS n_degraded, min(state_time) AS first_time, max(state_time) AS last_time FROM claims GROUP BY 1"""
_CLAIMS = "WITH" + _CLAIMS[1:]
_COVERAGE = """WITH w AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN quality ELSE (doc_id + toxic) % 6 END AS i FROM labels UNION ALL SELECT conv_id, (conv_id + turn) % 4 FROM conversations),
  e AS (SELECT source_id, ['EXECUTED_WITH_RESULTS', 'EXECUTED_EMPTY', 'ACCESS_RESTRICTED', 'SOURCE_FAILED', 'POLICY_REFUSED', 'OTHER'][i + 1] AS outcome FROM w),
  f AS (SELECT source_id, bool_or(outcome LIKE 'EXECUTED%') AS x, bool_or(outcome IN ('ACCESS_RESTRICTED', 'POLICY_REFUSED')) AS r, bool_or(outcome = 'SOURCE_FAILED') AS d FROM e GROUP BY 1),
  coverage AS (SELECT doc_id AS source_id, documents.source || '/' || lang AS family, CASE WHEN x IS NULL THEN CASE WHEN doc_id % 7 <> 0 THEN 'NOT_SEARCHED' ELSE 'UNKNOWN' END
    WHEN x AND NOT d AND NOT r THEN 'COVERED' WHEN x THEN 'PARTIALLY_COVERED' WHEN r AND NOT d THEN 'ACCESS_RESTRICTED' WHEN d THEN 'SOURCE_FAILED' ELSE 'UNKNOWN' END AS state
    FROM documents LEFT JOIN f ON doc_id = source_id) """
_FORECASTS = ", f AS (SELECT *, power(probability - outcome::INT, 2) AS b, -ln(CASE WHEN outcome THEN probability ELSE 1 - probability END) AS s, CASE WHEN days <= 7 THEN 'SHORT' WHEN days <= 90 THEN 'MEDIUM' ELSE 'LONG' END AS band FROM forecasts)"
_BUCKETS = ", b AS (SELECT least(CAST(floor(probability * 10) AS INT), 9) AS bucket, count(*) AS n, avg(probability) AS p, avg(outcome::INT) AS r FROM forecasts GROUP BY 1)"
_POINTS = "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 180 AS lon, embedding[2]::DOUBLE * 90 AS lat FROM embeddings) "
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians({2}.lat - {1}.lat) / 2), 2) + cos(radians({1}.lat)) * cos(radians({2}.lat)) * power(sin(radians({2}.lon - {1}.lon) / 2), 2))))"
_DIST = lambda a, b: _HAVERSINE.replace("{1}", a).replace("{2}", b)
_TRADE = ", e AS (SELECT 'c' || source_id AS a, 's' || target_id AS b FROM relations), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"
_KINDS = "['RELATION', 'EVENT', 'ENTITY_ATTRIBUTE', 'ROLE_SIGNAL', 'MEASURE'][object_id % 5 + 1]"
_SAME_AS = "SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang, n_chars) FROM documents"
_COMPONENTS = f"""WITH RECURSIVE e AS ({_SAME_AS}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a), c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1) """


def _segment(ax: float, ay: float, bx: float, by: float) -> str:
    k = "radians(1) * 6371008.8"
    a, b = (f"({ax} - lon) * {k} * cos(radians(lat))", f"({ay} - lat) * {k}"), (f"({bx} - lon) * {k} * cos(radians(lat))", f"({by} - lat) * {k}")
    dx, dy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    t = f"greatest(0, least(1, -({a[0]} * {dx} + {a[1]} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(power({a[0]} + {t} * {dx}, 2) + power({a[1]} + {t} * {dy}, 2))"


SQL = {
    "a01_evidence_basis": f"{_CLAIMS} {_BASIS.format(100)}",
    "f25_confidence": f"""{_CLAIMS}, b AS ({_BASIS.format(400)}) SELECT bucket, CASE n_sources - (n_degraded > 0)::INT WHEN 0 THEN 'NONE' WHEN 1 THEN 'WEAK' WHEN 2 THEN 'MODERATE' ELSE 'STRONG' END AS confidence FROM b""",
    "j02_claim_standing": "SELECT doc_id AS claim_id, CASE WHEN toxic = 1 THEN 'WITHDRAWN' WHEN quality = 0 THEN 'DISPUTED' WHEN quality IS NULL THEN 'UNREVIEWED' ELSE 'CURRENT' END AS state FROM documents LEFT JOIN labels USING (doc_id)",
    "a08_source_independence": "SELECT source AS source_id, count(*) AS n, count(DISTINCT md5(text)) AS n_texts, count(DISTINCT lang) AS n_languages, max(n_chars) - min(n_chars) AS spread FROM documents GROUP BY 1",
    "a09_dependence_groups": "SELECT sha256(text) AS group_id, count(*) AS n, min(doc_id) AS first, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) >= 2",
    "a05_coverage_state": f"{_COVERAGE} SELECT source_id, state FROM coverage",
    "a06_coverage_summary": f"""{_COVERAGE} SELECT state AS label, count(*) AS n FROM coverage GROUP BY 1
        UNION ALL SELECT '(families unsearched)', count(*) FROM (SELECT family FROM coverage GROUP BY 1 HAVING bool_and(state IN ('NOT_SEARCHED', 'UNKNOWN')))""",
    "a07_coverage_matrix": f"""{_COVERAGE} SELECT family, count(*) FILTER (WHERE state = 'COVERED') AS covered, count(*) FILTER (WHERE state = 'PARTIALLY_COVERED') AS partially_covered,
        count(*) FILTER (WHERE state = 'NOT_SEARCHED') AS not_searched, count(*) FILTER (WHERE state = 'UNKNOWN') AS unknown FROM coverage GROUP BY 1""",
    "a11_scoreboard_grouping_sets": duck(
        f"""{_FORECASTS} SELECT CASE WHEN grouping(author) = 0 THEN 'author' WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(band) = 0 THEN 'band' ELSE 'all' END AS grouping,
        coalesce(author, CAST(domain AS VARCHAR), band, '') AS value, count(*) AS n, avg(b) AS brier_mean, avg(s) AS log_score_mean, avg(outcome::INT) AS base_rate
        FROM f GROUP BY GROUPING SETS ((), (author), (domain), (band))""", "forecasts"),
    "a12_reliability_buckets": duck(f"{_BUCKETS} SELECT CAST(i AS INT) AS bucket, coalesce(n, 0) AS n, p AS mean_probability, r AS observed_rate FROM range(10) t(i) LEFT JOIN b ON bucket = i", "forecasts"),
    "a13_ece": duck(f"{_BUCKETS} SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * abs(p - r)) / sum(n) AS ece FROM b", "forecasts"),
    "j03_visible_relationships": duck(
        f"""SELECT source_id, target_id, n_lines FROM relations WHERE source_id IN ({VISIBLE_SQL}) AND target_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (
        SELECT c_nationkey FROM customer WHERE c_custkey IN ({VISIBLE_SQL})))""", "relations", "markings"),
    "j04_visible_activities": duck(f"SELECT l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING bool_and(o_custkey IN ({VISIBLE_SQL}))", "markings"),
    "j05_unprocessed_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j06_phantom_refs": "SELECT o_custkey + 40 AS cited, count(*) AS n FROM orders WHERE o_custkey + 40 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "j07_observation_diff": duck(
        f""", told AS (SELECT object_id, seq, status FROM objects), w AS (SELECT object_id, arg_max(status, seq) AS v, max(seq) AS m FROM told WHERE seq <= {CUT} GROUP BY 1 HAVING max(seq) % 5 <> 0),
        n AS (SELECT object_id, arg_max(status, seq) AS v, max(seq) AS m FROM told GROUP BY 1 HAVING max(seq) % 5 <> 0)
        SELECT * FROM (SELECT object_id, CASE WHEN w.v IS NULL THEN CASE {_KINDS} WHEN 'RELATION' THEN 'RELATION_ADDED' WHEN 'EVENT' THEN 'EVENT_ADDED' ELSE CASE WHEN object_id % 11 = 0 THEN 'SOURCE_CORRECTION' ELSE 'NEW_PROPOSITION' END END
          WHEN n.v IS NULL THEN CASE {_KINDS} WHEN 'RELATION' THEN 'RELATION_REMOVED' ELSE 'REMOVED_PROPOSITION' END
          WHEN w.v <> n.v THEN CASE WHEN object_id % 11 = 0 THEN 'SOURCE_CORRECTION' WHEN {_KINDS} = 'ENTITY_ATTRIBUTE' THEN 'ENTITY_ATTRIBUTE_CHANGED' WHEN {_KINDS} = 'ROLE_SIGNAL' THEN 'ROLE_CHANGED'
            WHEN {_KINDS} = 'EVENT' THEN 'EVENT_UPDATED' ELSE 'VALUE_CHANGED' END END AS change_class FROM w FULL JOIN n USING (object_id)) WHERE change_class IS NOT NULL""", "objects"),
    "j08_feed_diff": duck(
        f""", w AS (SELECT object_id, arg_max(status, seq) AS v FROM objects WHERE seq <= {CUT // 10} GROUP BY 1), n AS (SELECT object_id, arg_max(status, seq) AS v FROM objects WHERE object_id % 13 <> 0 GROUP BY 1)
        SELECT * FROM (SELECT object_id, CASE WHEN w.v IS NULL THEN 'NEW' WHEN n.v IS NULL THEN 'DISAPPEARED' WHEN w.v <> n.v THEN 'CHANGED' END AS kind FROM w FULL JOIN n USING (object_id)) WHERE kind IS NOT NULL""", "objects"),
    "j11_standing_probability": duck(
        f"""SELECT object_id, coalesce(arg_max(p, version) FILTER (WHERE valid_from <= TIMESTAMP '{HORIZON}'), arg_min(p, version)) AS probability
        FROM (SELECT *, (seq * 37 % 99 + 1) / 100.0::DOUBLE AS p FROM objects) GROUP BY 1""", "objects"),
    "j12_spatial_within": f"{_POINTS} SELECT a.id, b.id AS place_id, round({_DIST('a', 'b')}, 3) AS metres FROM p a JOIN p b ON a.id < b.id WHERE {_DIST('a', 'b')} <= 400000",
    "j13_conflicting_reports": """SELECT l_orderkey * 10 + l_linenumber AS target, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS statuses, count(*) AS n_reports, min(l_partkey) AS first_report
        FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""",
    "j14_shared_identifier_pairs": "SELECT doc_id AS object_id, head, 'text' AS system FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS head FROM documents) WHERE doc_id > head",
    "j15_association_decide": duck(
        f""", o AS (SELECT object_id, version, CASE WHEN seq % 4 > 0 THEN 'A' ELSE 'B' END AS type, CASE WHEN seq % 3 = 0 THEN object_id END AS ref, valid_from AS t, seq % 360 - 180.0::DOUBLE AS lon, seq % 170 - 85.0::DOUBLE AS lat, status FROM objects),
        p AS (SELECT l.object_id, l.version, l.type = r.type AS same, l.ref AS lr, r.ref AS rr, abs(epoch(r.t - l.t)) / 3600 AS gap, {_DIST('l', 'r')} AS metres, l.status <> r.status AS contradiction FROM o l JOIN o r ON l.object_id = r.object_id AND r.version = l.version + 1),
        f AS (SELECT object_id, version, CASE WHEN lr = rr THEN 'SYSTEM_MATCH' WHEN lr IS NOT NULL AND rr IS NOT NULL THEN 'CONFLICT' ELSE 'ABSENT' END AS identifier, CASE WHEN same THEN 'MATCH' ELSE 'MISMATCH' END AS type,
          CASE WHEN gap <= 12 THEN 'COMPATIBLE' ELSE 'INCOMPATIBLE' END AS temporal, CASE WHEN metres <= 80000 * greatest(gap, 0.25) THEN 'COMPATIBLE' ELSE 'IMPLAUSIBLE_SPEED' END AS geospatial, contradiction FROM p)
        SELECT *, CASE WHEN type = 'MISMATCH' OR identifier = 'CONFLICT' OR (geospatial = 'IMPLAUSIBLE_SPEED' AND identifier <> 'SYSTEM_MATCH') THEN 'REJECT_ASSOCIATION' WHEN contradiction THEN 'UNKNOWN'
          WHEN identifier = 'SYSTEM_MATCH' AND temporal <> 'INCOMPATIBLE' THEN 'AUTO_ASSOCIATE' WHEN temporal = 'COMPATIBLE' AND geospatial = 'COMPATIBLE' THEN 'PROPOSE_ASSOCIATION' ELSE 'UNKNOWN' END AS outcome FROM f""", "objects"),
    "j16_propagation_edges": r"""WITH s AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' .,;:!?"''«»“”') AS t FROM documents)
        SELECT doc_id, origin, CASE WHEN source = o_source THEN 'SAME_FAMILY' ELSE 'DERIVATIVE' END AS relation FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS origin, arg_min(source, doc_id) OVER (PARTITION BY t) AS o_source FROM s) WHERE doc_id <> origin""",
    "j18_dependency_bridge": """SELECT "on", count(DISTINCT d) AS n FROM (SELECT 'customer:' || o_custkey AS "on", o_orderkey AS d FROM orders UNION ALL SELECT 'part:' || l_partkey, l_orderkey FROM lineitem
        UNION ALL SELECT 'supplier:' || l_suppkey, l_orderkey FROM lineitem) GROUP BY 1""",
    "j21_path_overlap": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 AND l_returnflag = 'R')",
    "j20_interval": duck("SELECT seq, source_id FROM log WHERE recorded_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'", "log"),
    "g01_timeline_union": duck(
        """SELECT strftime(t, '%Y-%m-%d') AS day, kind, count(*) AS n FROM (SELECT o_orderdate AS t, 'ORDERED' AS kind FROM orders UNION ALL SELECT l_shipdate, 'SHIPPED' FROM lineitem UNION ALL SELECT recorded_time, 'RECORDED' FROM log) WHERE t IS NOT NULL GROUP BY 1, 2""", "log"),
    "g05_components": f"{_COMPONENTS} SELECT node, component FROM c",
    "g06_theme_candidates": f"{_COMPONENTS} SELECT component, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3",
    "g07_k_hop": duck(f"{_TRADE}, r AS (SELECT 'c1' AS node, CAST(0 AS BIGINT) AS hop UNION SELECT 'c2', 0 UNION SELECT u.b, hop + 1 FROM r JOIN u ON r.node = u.a WHERE hop < 2) SELECT node, min(hop) AS hop FROM r GROUP BY 1", "relations", recursive=True),
    "g08_shortest_path": duck(f"{_TRADE}, r AS (SELECT 'c7' AS node, CAST(0 AS BIGINT) AS hop UNION SELECT u.b, hop + 1 FROM r JOIN u ON r.node = u.a WHERE hop < 3) SELECT node, min(hop) AS hop FROM r GROUP BY 1", "relations", recursive=True),
    "g09_transitive_dependents": """WITH RECURSIVE e AS (SELECT u.doc_id AS a, d.doc_id AS b FROM documents d JOIN documents u ON u.doc_id = d.doc_id // 2 AND u.lang = d.lang WHERE d.doc_id > 0),
        r AS (SELECT unnest(range(1, 64)) AS node UNION SELECT b FROM r JOIN e ON r.node = e.a) SELECT node FROM r WHERE node NOT BETWEEN 1 AND 63""",
    "g11_descent": duck(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c_custkey IN ({VISIBLE_SQL}) THEN c_name ELSE 'REDACTED' END AS customer, r_name AS region
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", "markings"),
    "q14_hypothesis_matrix": "SELECT l_partkey, CAST(coalesce(sum(s) FILTER (WHERE l_linestatus = 'F'), 0) AS BIGINT) AS f, CAST(coalesce(sum(s) FILTER (WHERE l_linestatus = 'O'), 0) AS BIGINT) AS o FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s FROM lineitem) GROUP BY 1",
    "f08_haversine": f"{_POINTS}, b AS (SELECT 13.4 AS lon, 52.5 AS lat) SELECT p.id, round({_DIST('p', 'b')}, 3) AS metres FROM p, b",
    "f09_point_to_line": f"{_POINTS} SELECT id, round(least({_segment(0.0, 0.0, 10.0, 0.0)}, {_segment(10.0, 0.0, 10.0, 10.0)}), 2) AS metres FROM p",
    "f25_warning_tier": duck(
        """, f AS (SELECT forecast_id, CASE WHEN probability < 0.15 THEN 'REMOTE' WHEN probability < 0.45 THEN 'POSSIBLE' WHEN probability < 0.75 THEN 'LIKELY' ELSE 'VERY_LIKELY' END AS band,
          ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][forecast_id % 4 + 1] AS consequence, CASE WHEN days * 24 - 240 <= 0 THEN 'PASSED' WHEN days * 24 - 240 <= 72 THEN 'IMMINENT' WHEN days * 24 - 240 <= 336 THEN 'CLOSE'
          WHEN days * 24 - 240 <= 1440 THEN 'NEAR' ELSE 'DISTANT' END AS pressure, ['NONE', 'WEAK', 'MODERATE', 'STRONG'][forecast_id % 7 % 4 + 1] AS confidence FROM forecasts),
        t AS (SELECT *, CASE consequence || '/' || band WHEN 'CRITICAL/REMOTE' THEN 1 WHEN 'CRITICAL/POSSIBLE' THEN 2 WHEN 'CRITICAL/LIKELY' THEN 3 WHEN 'CRITICAL/VERY_LIKELY' THEN 3 WHEN 'HIGH/REMOTE' THEN 0 WHEN 'HIGH/POSSIBLE' THEN 1
          WHEN 'HIGH/LIKELY' THEN 2 WHEN 'HIGH/VERY_LIKELY' THEN 3 WHEN 'MEDIUM/REMOTE' THEN 0 WHEN 'MEDIUM/POSSIBLE' THEN 1 WHEN 'MEDIUM/LIKELY' THEN 1 WHEN 'MEDIUM/VERY_LIKELY' THEN 2 WHEN 'LOW/REMOTE' THEN 0 WHEN 'LOW/POSSIBLE' THEN 0 ELSE 1 END AS i FROM f)
        SELECT forecast_id, band, consequence, pressure, confidence, ['ROUTINE', 'ATTENTION', 'PRIORITY', 'CRITICAL'][least(CASE WHEN pressure = 'IMMINENT' THEN least(i + 1, 3) ELSE i END, CASE WHEN confidence IN ('NONE', 'WEAK') THEN 2 ELSE 3 END) + 1] AS tier FROM t""", "forecasts"),
    "f26_route_score": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 0.0::DOUBLE ELSE 0.5 * s_acctbal / 10000 + 0.3 * (s_nationkey / 25.0::DOUBLE) + 0.2 * (s_suppkey % 10 / 10.0::DOUBLE) END AS score FROM supplier",
}

QUERIES = {
    f.__name__: f
    for f in (
        a01_evidence_basis, f25_confidence, j02_claim_standing, a08_source_independence, a09_dependence_groups, a05_coverage_state,
        a06_coverage_summary, a07_coverage_matrix, a11_scoreboard_grouping_sets, a12_reliability_buckets, a13_ece, j03_visible_relationships,
        j04_visible_activities, j05_unprocessed_anti, j06_phantom_refs, j07_observation_diff, j08_feed_diff, j11_standing_probability,
        j12_spatial_within, j13_conflicting_reports, j14_shared_identifier_pairs, j15_association_decide, j16_propagation_edges,
        j18_dependency_bridge, j21_path_overlap, j20_interval, g01_timeline_union, g05_components, g06_theme_candidates, g07_k_hop,
        g08_shortest_path, g09_transitive_dependents, g11_descent, q14_hypothesis_matrix, f08_haversine, f09_point_to_line,
        f25_warning_tier, f26_route_score,
    )
}
