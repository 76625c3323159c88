"""Queries of the world model, its bundles and its structured records, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.operators import access, bundles, evidence, graph, versions, world
from worldlog.operators.graph import dealt
from worldlog.roles import duck, table
from worldlog.sources import feeds, structured

from .state import CUT, READER, VISIBLE_SQL

CLASSES = ("SOURCE_CORRECTION", "VALUE_CHANGED", "ENTITY_ATTRIBUTE_CHANGED", "REMOVED_PROPOSITION", "NEW_PROPOSITION", "ROLE_CHANGED", "SEMANTICALLY_UNCHANGED", "SOURCE_RETRACTION")
STATES = ("CURRENT", "STALE", "DISPUTED", "SUPERSEDED", "RETRACTED")
STATUSES = ("O", "F", "P")
KINDS = ("analytic_assumption", "mission_objective", "analytic_theme")
RESOLUTIONS = ("ACCEPTED", "REJECTED", "SPLIT", "REVERSED", "DEFERRED")
OUTCOMES = ("AUTO_ASSOCIATE", "PROPOSE_ASSOCIATION", "UNKNOWN")
FORECAST = ("OPEN", "UPDATE_REQUIRED", "HORIZON_PASSED", "RESOLVED_TRUE")
BASIS = ("n_support", "n_degraded", "n_contradicting", "n_families", "n_observations")


def _pick(values: tuple[str, ...], n: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def _advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a claim that its orders bear on: status from a publisher (priority) at a time, some times unknown."""
    o = table(spark, sf_dir, "orders")
    time = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    return world.advanced_claims(o.select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("family"), time.alias("state_time")))


def _claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("claim_id"), _pick(STATES, c % 5).alias("state"), (c * 9).alias("at"))


def q05_advanced_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _advances(spark, sf_dir).withColumn("families", F.array_join("families", ","))


def q06_settled_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.settled_standing(_advances(spark, sf_dir), _claim_states(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("change_id"), o.alias("position"), _pick(CLASSES, o % 8).alias("change_class"), F.col("o_custkey").alias("claim_id"), F.col("o_orderstatus").alias("current_value"), F.col("o_orderdate").alias("state_time")
    )


def r07_propagated_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes, customers as claims with a version and evidence of their own age."""
    c = F.col("c_custkey")
    claims = table(spark, sf_dir, "customer").select(
        c.alias("claim_id"), _pick(STATUSES, c % 3).alias("value"), (c * 3).alias("position"), F.expr("TIMESTAMP '1994-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 3000 AS int))").alias("evidence_time")
    )
    return world.propagated_changes(_changes(spark, sf_dir), claims, _claim_states(spark, sf_dir))


def r11_carried_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of a nation's customers, of three kinds, reached by the changes of their claims."""
    c = F.col("c_custkey")
    rests = table(spark, sf_dir, "customer").select(c.alias("ref"), _pick(KINDS, c % 3).alias("kind"), F.col("c_nationkey").alias("dependent"))
    return world.carried_changes(_changes(spark, sf_dir).withColumnRenamed("claim_id", "ref"), rests)


def r11_questioned_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as supports of assumptions (their orders), their parts' keys as claims."""
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assumption_id"), F.when(F.col("l_orderkey") % 4 > 0, "HELD").otherwise("INVALIDATED").alias("status"), F.col("l_partkey").alias("claim_id"))
    weak = _claim_states(spark, sf_dir).filter("state <> 'CURRENT'").select("claim_id")
    return world.questioned_assumptions(held, _changes(spark, sf_dir), weak)


def q09_association_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of each customer and the next, and their orders as resolutions."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    proposals = table(spark, sf_dir, "customer").select(c.alias("left"), (c + 1).alias("right"), F.lit(-1).cast("long").alias("at"), _pick(OUTCOMES, c % 3).alias("outcome"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left"), (F.col("o_custkey") + 1).alias("right"), o.alias("at"), _pick(RESOLUTIONS, o % 5).alias("resolution"))
    return world.association_links(proposals, steps)


def q08_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as raises and transitions of one alert each."""
    rows = roles.log(spark, sf_dir).select(F.col("subject").cast("string").alias("dedup_key"), F.col("seq").alias("at"), "k")
    moved = rows.filter("k % 5 = 0").select("dedup_key", "at", F.when(F.col("k") % 2 == 0, "ACKNOWLEDGED").otherwise("RESOLVED").alias("to_status"), F.when(F.col("k") % 4 == 0, "HUMAN").otherwise("SERVICE").alias("actor_kind"))
    return world.alerts(rows.filter("k % 5 <> 0"), moved)


def q08_frozen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions on the objects of their lines, some of them pinned to the first version already."""
    s = F.col("l_suppkey").cast("string")
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.when(F.col("l_linenumber") == 2, F.concat(s, F.lit("@v1"))).otherwise(s).alias("ref"))
    rows = roles.objects(spark, sf_dir)
    content = rows.select("object_id", "version", F.concat_ws("/", "status", "priority").alias("content"))
    return world.frozen_evidence(refs, rows.groupBy("object_id").agg(F.max("version").alias("version")), content)


def _themes(docs: DataFrame, bad: DataFrame) -> DataFrame:
    met = docs.join(bad.select("doc_id", "toxic", "quality"), "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return met.groupBy(F.substring(F.lower("text"), 1, 2).alias("theme_id")).agg(
        F.count("*").alias("n_support"), F.count_if(flag(F.col("quality") == 0)).alias("n_degraded"), F.count_if(flag(F.col("toxic") == 1)).alias("n_contradicting"),
        F.count_distinct("source").alias("n_families"), F.sum(F.length("text")).alias("n_observations"),
    )


def q18_refreshed_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes as recorded over German and French documents, against all documents and their labels."""
    docs, labels = table(spark, sf_dir, "documents").filter("text <> ''"), table(spark, sf_dir, "labels")
    before = _themes(docs.filter("lang IN ('de', 'fr')"), labels.filter("quality = 1"))
    status = F.when(F.ascii("theme_id") % 7 == 0, "RESOLVED").otherwise(world.theme_status())
    return world.refreshed_themes(before.withColumn("status", status), _themes(docs, labels))


def q22_update_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as acts on orders as forecasts, with suppliers as indicators."""
    k, e, s = F.col("k"), F.col("seq"), F.col("s_suppkey")
    acts = roles.log(spark, sf_dir).select(
        e.alias("act_id"), (e * 7 % 20_000).alias("forecast_id"), e.alias("at"), F.when(k % 13 == 0, 1.0).otherwise((k % 3 + 1) / 10.0).alias("probability"), F.when(k % 17 == 0, "").otherwise("seen").alias("reason"),
        F.when(k % 2 == 0, "HUMAN").otherwise("SERVICE").alias("actor_kind"), F.when((k % 2 == 1) | (k % 10 == 0), F.concat(F.lit("i"), e % 10)).otherwise("").alias("indicator_id"),
    )
    forecasts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("forecast_id"), _pick(FORECAST, F.col("o_orderkey") % 4).alias("status"))
    armed = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("i"), s).alias("indicator_id"), F.when(s % 4 == 0, "ARMED").otherwise("FIRED").alias("status"), F.sequence(F.lit(0).cast("long"), F.lit(9_000).cast("long"), F.lit(1).cast("long")).alias("forecast_ids"),
        F.lit("APPLY_PROBABILITY").alias("mode"), F.lit(0.2).alias("target"),
    )
    return world.update_verdict(acts, forecasts, armed)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON records of the three kinds."""
    c = F.col("c_custkey")
    registry = F.format_string(
        '{"data":[{"id":"L%d","attributes":{"lei":"L%d","entity":{"legalName":{"name":"%s"},"status":"%s","otherNames":[{"name":"%s"}],"successorEntity":{"lei":"L%d"}},"registration":{"lastUpdateDate":"2020-01-05"}}},{"attributes":{"entity":{"status":"X"}}}]}',
        c, c, F.col("c_name"), F.col("c_mktsegment"), F.col("c_mktsegment"), c + 1)
    entity = F.format_string('{"entities":{"Q%d":{"labels":{"en":{"value":"%s"}},"aliases":{"de":[{"value":"%s"}]},"claims":{"P1278":[{"mainsnak":{"datavalue":{"value":"L%d"}}}],"P856":[{"mainsnak":{"datavalue":{"value":"https://x%d.org"}}}],"P9":[{"mainsnak":{"datavalue":{"value":"z"}}}]}}}}', c, F.col("c_name"), F.col("c_mktsegment"), c, c)
    hits = F.format_string('{"hits":{"hits":[{"_id":"h%d","_source":{"adsh":"a%d","ciks":["000%d"],"file_date":"2021-03-04","file_type":"10-K","display_names":["%s (CIK 000%d)"]}},{"_source":{"adsh":"b"}}]}}', c, c, c, F.col("c_name"), c)
    customers = table(spark, sf_dir, "customer")
    customers = dealt(customers.select("c_custkey", "c_name", "c_mktsegment"), customers.count(), each=20_000)  # work of a row is heavy, and a file may have few splits
    return customers.select("c_custkey", F.when(c % 3 == 0, registry).when(c % 3 == 1, entity).otherwise(hits).alias("body"))


def f21_structured_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = feeds.json_fields(_bodies(spark, sf_dir), "c_custkey", "body")
    return structured.observations(fields, "c_custkey").drop("path")


def j15_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's version against the next one as two objects, with references, attributes and sources."""
    rows, q = roles.objects(spark, sf_dir), F.col("seq")
    side = lambda p, shift: rows.select(
        "object_id", (F.col("version") + shift).alias("version"), F.when(q % 4 > 0, "A").otherwise("B").alias(f"{p}_type"),
        F.when(q % 3 == 0, F.array(F.struct(F.lit("sys").alias("system"), (q % 2).cast("string").alias("external_id")))).otherwise(F.array().cast("array<struct<system:string,external_id:string>>")).alias(f"{p}_refs"),
        F.create_map(F.lit("hull_id"), F.when(q % 5 == 0, F.lit("UNKNOWN")).otherwise((q % 2).cast("string")), F.lit("speed"), (q % 6 + 20).cast("string"), F.lit("observed_at"), q.cast("string"), F.lit("status"), F.when(q % 2 == 0, "UNKNOWN").otherwise(F.col("status"))).alias(f"{p}_attributes"),
        F.when(q % 7 > 0, F.col("valid_from")).alias(f"{p}_time"), (q % 2 / 10.0).alias(f"{p}_lon"), (q % 3 / 10.0).alias(f"{p}_lat"),
        F.when(q % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("priority")).alias(f"{p}_sources"), F.when(q % 8 > 0, q % 8 / 8.0).alias(f"{p}_confidence"),
    )
    pairs = side("l", 0).join(side("r", -1), ["object_id", "version"])
    negative = F.when((F.col("object_id") + F.col("version")) % 10 == 0, F.array(F.lit("seen apart"))).otherwise(F.array().cast("array<string>"))
    found = evidence.pair_features(pairs.withColumn("negative", negative))
    return found.select("object_id", "version", "identifier", "type", "temporal", "geospatial", "sources", F.array_join("contradictions", ",").alias("contradictions"), "confidence", "outcome")


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    named = {"log": roles.log, "objects": roles.objects, "markings": roles.markings, "decisions": roles.forecasts, "relationships": roles.relations}
    return {name: role(spark, sf_dir) for name, role in named.items()}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{graph.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s21_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole store as open JSON, read again and held against its manifest."""
    tables, folder = _store(spark, sf_dir), _folder(spark, "export")
    bundles.export_tables(tables, folder)
    return bundles.verified(spark, tables, folder)


def _views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    objects, markings = tables["objects"], tables["markings"]
    current = versions.current_by_validity(objects)
    return {
        "event_count_equal": tables["log"].agg(F.count("*").alias("n")), "log_order_equal": tables["log"].select("seq", "source_time", "recorded_time"),
        "log_contents_equal": tables["log"], "projection_equal": current.join(access.visible(markings, READER).select("object_id"), "object_id", "left_semi"),
        "object_ids_preserved": objects.select("object_id").distinct(), "history_preserved": objects.select("object_id", "version"), "markings_preserved": markings,
        "contents_preserved": objects, "decisions_preserved": tables["decisions"], "relationships_preserved": tables["relationships"],
    }


def q30_exit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equalities of the store and of what comes back from its export."""
    tables, folder = _store(spark, sf_dir), _folder(spark, "exit")
    bundles.export_tables(tables, folder)
    return bundles.equal_views(_views(tables), _views(bundles.imported(spark, tables, folder)))


def s23_dissemination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six members for one reader, written with their manifest and held against it."""
    rows, markings = roles.objects(spark, sf_dir), roles.markings(spark, sf_dir)
    current = versions.current_by_validity(rows)
    members = {
        "projection": current, "changes": rows.filter(F.col("seq") > CUT), "alerts": current.filter("status = 'P'"), "decisions": roles.forecasts(spark, sf_dir).filter("outcome").withColumn("object_id", F.col("forecast_id")),
        "provenance_refs": roles.relations(spark, sf_dir).withColumnRenamed("source_id", "object_id"), "sitrep": current.select("object_id", "status"),
    }
    given, folder = bundles.dissemination(members, access.visible(markings, READER), "object_id"), _folder(spark, "bundle")
    bundles.export_tables(given, folder)
    return bundles.verified(spark, given, folder)


def _picked(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({n} AS INT) + 1]"


_ADVANCE = """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS pos, o_orderstatus AS v, o_orderpriority AS f, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    r AS (SELECT c, i, pos, 'RECORDED' AS outcome, 1 AS version, v, [f] AS fs, t FROM o WHERE i = 1
      UNION ALL SELECT c, i, pos, outcome, version + CASE WHEN outcome IN ('BASIS_ADDED', 'REPLACED') THEN 1 ELSE 0 END, CASE outcome WHEN 'REPLACED' THEN nv ELSE v END,
        CASE outcome WHEN 'REPLACED' THEN [nf] WHEN 'BASIS_ADDED' THEN list_append(fs, nf) ELSE fs END, CASE outcome WHEN 'REPLACED' THEN nt WHEN 'BASIS_ADDED' THEN greatest(coalesce(t, nt), coalesce(nt, t)) ELSE t END
      FROM (SELECT r.c, o.i, o.pos, r.version, r.v, r.fs, r.t, o.v AS nv, o.f AS nf, o.t AS nt, CASE WHEN o.v = r.v THEN CASE WHEN list_contains(r.fs, o.f) THEN 'NO_NEW_BASIS' ELSE 'BASIS_ADDED' END
          WHEN o.t IS NULL OR r.t IS NULL OR o.t <= r.t THEN 'NOT_NEWER' WHEN NOT list_contains(r.fs, o.f) THEN 'CONFLICT' ELSE 'REPLACED' END AS outcome FROM r JOIN o ON o.c = r.c AND o.i = r.i + 1))"""
_S = _picked(STATES, "c_custkey % 5")
_CH = f"ch AS (SELECT o_orderkey AS id, {_picked(CLASSES, 'o_orderkey % 8')} AS class, o_custkey AS c, o_orderstatus AS v, o_orderdate AS t FROM orders)"
_PIECE = "CAST('0x' || left({}, 15) AS BIGINT) % 1000003"
_GROUPED = """SELECT left(lower(text), 2) AS theme_id, count(*) AS n_support, count(*) FILTER (WHERE quality = 0 {q}) AS n_degraded, count(*) FILTER (WHERE toxic = 1 {q}) AS n_contradicting, count(DISTINCT source) AS n_families, sum(length(text)) AS n_observations
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id {q} WHERE text <> '' {d} GROUP BY 1"""
_STATUS = "CASE WHEN n_support <= n_degraded THEN 'STALE' WHEN n_contradicting > 0 THEN 'CONTESTED' WHEN n_families >= 2 THEN 'ACTIVE' ELSE 'EMERGING' END"
_CURRENT = "(SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY valid_from DESC, version DESC) = 1)"


def _counts(pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, ({query}) AS n, ({query}) AS n_read, true AS equal" for name, query in pairs.items())


SQL = {
    "q05_advanced_claims": f"{_ADVANCE} SELECT c AS claim_id, pos AS \"at\", outcome, CAST(version AS BIGINT) AS version, v AS value, array_to_string(list_sort(fs), ',') AS families FROM r",
    "q06_settled_standing": f"""{_ADVANCE}, l AS (SELECT * FROM r WHERE outcome IN ('RECORDED', 'BASIS_ADDED', 'REPLACED') QUALIFY row_number() OVER (PARTITION BY c ORDER BY version DESC) = 1)
        SELECT c AS claim_id, CAST(version AS BIGINT) AS version, {_S} AS prior, CASE WHEN c_custkey * 9 >= pos THEN 'STANDS' WHEN {_S} IN ('STALE', 'SUPERSEDED') THEN 'RESET' WHEN {_S} = 'CURRENT' THEN 'NONE' ELSE 'REVIEW' END AS action
        FROM l JOIN customer ON c_custkey = c WHERE outcome = 'REPLACED'""",
    "r07_propagated_changes": f"""WITH {_CH}, m AS (SELECT *, max(id) OVER (PARTITION BY c) AS last, CASE class WHEN 'SOURCE_CORRECTION' THEN 'CORRECTED' WHEN 'SOURCE_RETRACTION' THEN 'RETRACTED' WHEN 'ENTITY_ATTRIBUTE_CHANGED' THEN 'SUPERSEDED' WHEN 'VALUE_CHANGED' THEN 'STALE'
          WHEN 'ROLE_CHANGED' THEN 'STALE' ELSE '' END AS goal FROM ch WHERE class NOT IN ('NEW_PROPOSITION', 'SEMANTICALLY_UNCHANGED'))
        SELECT id AS change_id, c AS claim_id, CASE WHEN id = last AND c_custkey * 3 <= id AND TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 3000 AS INT)) <= t AND goal <> '' AND {_picked(STATUSES, 'c_custkey % 3')} <> v AND {_S} IN ('CURRENT', 'STALE', 'SUPERSEDED') AND {_S} <> goal THEN goal END AS state,
          CASE class WHEN 'SOURCE_CORRECTION' THEN 'SOURCE_CORRECTED' WHEN 'SOURCE_RETRACTION' THEN 'SOURCE_RETRACTED' ELSE 'MANIFESTATION_CHANGED' END AS review FROM m JOIN customer ON c_custkey = c""",
    "r11_carried_changes": f"""WITH {_CH} SELECT {_picked(KINDS, 'c_custkey % 3')} AS kind, c_nationkey AS dependent, count(*) AS n_changes, string_agg(DISTINCT class, ',' ORDER BY class) AS classes, CAST(sum({_PIECE.format('md5(id::VARCHAR)')}) AS BIGINT) AS changeset, max(id) AS latest
        FROM ch JOIN customer ON c_custkey = c WHERE class <> 'SEMANTICALLY_UNCHANGED' GROUP BY 1, 2""",
    "r11_questioned_assumptions": f"""WITH {_CH}, f AS (SELECT c, min(id) AS id FROM ch LEFT JOIN customer ON c_custkey = c WHERE class <> 'SEMANTICALLY_UNCHANGED' AND ({_S} <> 'CURRENT' OR class IN ('SOURCE_RETRACTION', 'SOURCE_CORRECTION', 'VALUE_CHANGED', 'ENTITY_ATTRIBUTE_CHANGED')) GROUP BY 1)
        SELECT l_orderkey AS assumption_id, min(id) AS caused_by FROM lineitem JOIN f ON c = l_partkey WHERE l_orderkey % 4 > 0 GROUP BY 1""",
    "q09_association_links": f"""WITH s AS (SELECT o_custkey AS c, o_orderkey AS pos, {_picked(RESOLUTIONS, 'o_orderkey % 5')} AS x FROM orders), e AS (SELECT c_custkey AS c, -1 AS pos, 'SAME_AS' AS k, 'ACTIVE' AS st FROM customer WHERE c_custkey % 3 = 0
          UNION ALL SELECT c_custkey, -1, 'POSSIBLY_SAME_AS', 'PROPOSED' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c, pos, 'SAME_AS', 'ACTIVE' FROM s WHERE x = 'ACCEPTED'
          UNION ALL SELECT c, pos, unnest(['SAME_AS', 'POSSIBLY_SAME_AS']), CASE x WHEN 'REVERSED' THEN 'RETIRED' ELSE 'REJECTED' END FROM s WHERE x IN ('REJECTED', 'SPLIT', 'REVERSED')),
        w AS (SELECT *, lag(st) OVER (PARTITION BY c, k ORDER BY pos) AS before FROM e) SELECT c AS "left", c + 1 AS "right", k AS relation_type, arg_max(st, pos) AS status, count(*) AS version FROM w WHERE st IN ('ACTIVE', 'PROPOSED') OR before IN ('ACTIVE', 'PROPOSED') GROUP BY c, k""",
    "q08_alerts": duck(
        """, f AS (SELECT subject, min(seq) AS first_at, count(*) - 1 AS retriggered FROM log WHERE k % 5 <> 0 GROUP BY 1), t AS (SELECT subject, seq, CASE WHEN k % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS st FROM log WHERE k % 5 = 0 AND (k % 2 <> 0 OR k % 4 = 0))
        SELECT 'alert-' || left(sha256(subject::VARCHAR), 24) AS alert_id, subject::VARCHAR AS dedup_key, first_at, retriggered, coalesce((SELECT arg_max(st, seq) FROM t WHERE t.subject = f.subject AND seq > first_at), 'OPEN') AS status FROM f""", "log"),
    "q08_frozen_evidence": duck(
        f""", a AS (SELECT DISTINCT l_orderkey AS d, l_suppkey AS s, l_linenumber = 2 AS fixed FROM lineitem), n AS (SELECT object_id, max(version) AS version FROM objects GROUP BY 1),
        p AS (SELECT d, NOT fixed AND n.version IS NOT NULL AS pinned, s::VARCHAR || CASE WHEN fixed THEN '@v1' WHEN n.version IS NOT NULL THEN '@v' || n.version ELSE '' END AS ref, s, CASE WHEN fixed THEN 1 ELSE n.version END AS v FROM a LEFT JOIN n ON object_id = s)
        SELECT d AS decision_id, count(*) AS n_refs, count(*) FILTER (WHERE pinned) AS n_pinned, count(*) FILTER (WHERE status IS NULL) AS n_unresolved, CAST(sum({_PIECE.format("sha256(ref || '|' || coalesce(status || '/' || priority, 'unresolved_reference'))")}) AS BIGINT) AS snapshot
        FROM p LEFT JOIN objects o ON o.object_id = s AND o.version = v GROUP BY 1""", "objects"),
    "q18_refreshed_themes": f"""WITH a AS ({_GROUPED.format(q='AND quality = 1', d="AND lang IN ('de', 'fr')")}), n AS ({_GROUPED.format(q='', d='')}), b AS (SELECT *, {_STATUS} AS was FROM a WHERE ascii(theme_id) % 7 <> 0), m AS (SELECT *, {_STATUS} AS status FROM n)
        SELECT theme_id, was, m.status, array_to_string(list_filter([CASE WHEN b.n_families <> m.n_families THEN 'SOURCE_DIVERSITY_CHANGED' END, CASE WHEN was <> m.status THEN CASE m.status WHEN 'CONTESTED' THEN 'CONTRADICTION_ADDED' WHEN 'STALE' THEN 'STALE' WHEN 'ACTIVE' THEN 'STRENGTHENED' ELSE 'WEAKENED' END END,
          CASE WHEN b.n_observations <> m.n_observations AND was = m.status THEN 'EVIDENCE_UPDATED' END, CASE WHEN m.n_degraded > b.n_degraded THEN 'WEAKENED' END], lambda x: x IS NOT NULL), ',') AS transitions
        FROM b JOIN m USING (theme_id) WHERE was <> m.status OR (b.n_support, b.n_degraded, b.n_contradicting, b.n_families, b.n_observations) IS DISTINCT FROM (m.n_support, m.n_degraded, m.n_contradicting, m.n_families, m.n_observations)""",
    "q22_update_verdicts": duck(
        f""", a AS (SELECT seq, seq * 7 % 20000 AS f, CASE WHEN k % 13 = 0 THEN 1.0 ELSE (k % 3 + 1) / 10.0 END AS p, k % 17 = 0 AS mute, k % 2 = 0 AS human, k % 2 = 1 OR k % 10 = 0 AS rule, seq % 10 AS i FROM log),
        j AS (SELECT a.*, {_picked(FORECAST, 'o_orderkey % 4')} AS st, CASE WHEN o_orderkey IS NULL THEN 'UNKNOWN_FORECAST' WHEN o_orderkey % 4 = 3 THEN 'CLOSED' WHEN mute THEN 'NO_REASON' WHEN rule AND human THEN 'INDICATOR_ON_HUMAN_ACT' WHEN NOT rule AND NOT human THEN 'NO_AUTHORITY'
          WHEN rule AND (s_suppkey IS NULL OR s_suppkey % 4 = 0) THEN 'NOT_FIRED' WHEN rule AND f > 9000 THEN 'NOT_NAMED' WHEN rule AND abs(p - 0.2) > 1e-9 THEN 'NOT_AUTHORIZED' WHEN p >= 1 THEN 'OUT_OF_RANGE' END AS code FROM a LEFT JOIN orders ON o_orderkey = f LEFT JOIN supplier ON s_suppkey = i),
        k AS (SELECT *, coalesce(code, CASE WHEN rule AND row_number() OVER (PARTITION BY code, rule, i, f ORDER BY seq) > 1 THEN 'SPENT' ELSE 'UPDATED' END) AS verdict FROM j)
        SELECT seq AS act_id, verdict, CASE WHEN verdict = 'UPDATED' AND NOT rule AND st = 'UPDATE_REQUIRED' THEN 'OPEN' ELSE st END AS status FROM k""", "log"),
    "f21_structured_observations": """WITH c AS (SELECT *, c_custkey AS k FROM customer), e AS (SELECT k, unnest(CASE k % 3
        WHEN 0 THEN [['ENTITY_IDENTIFIER', 'LEI:L' || k, 'LEI', 'L' || k, '', '2020-01-05T00:00:00+00:00'], ['ENTITY_NAME', 'LEI:L' || k, 'legal_name', c_name, '', '2020-01-05T00:00:00+00:00'], ['ENTITY_ATTRIBUTE', 'LEI:L' || k, 'entity_status', c_mktsegment, '', '2020-01-05T00:00:00+00:00'],
          ['ENTITY_NAME', 'LEI:L' || k, 'other_name', c_mktsegment, '', '2020-01-05T00:00:00+00:00'], ['RELATION', 'LEI:L' || k, 'SUCCESSOR_OF', 'L' || (k + 1), 'LEI:L' || (k + 1), '2020-01-05T00:00:00+00:00']]
        WHEN 1 THEN [['ENTITY_IDENTIFIER', 'WIKIDATA_QID:Q' || k, 'WIKIDATA_QID', 'Q' || k, '', NULL], ['ENTITY_NAME', 'WIKIDATA_QID:Q' || k, 'label', c_name, '', NULL], ['ENTITY_NAME', 'WIKIDATA_QID:Q' || k, 'alias', c_mktsegment, '', NULL],
          ['ENTITY_IDENTIFIER', 'WIKIDATA_QID:Q' || k, 'LEI', 'L' || k, '', NULL], ['RELATION', 'WIKIDATA_QID:Q' || k, 'OPERATES', 'https://x' || k || '.org', 'URL:https://x' || k || '.org', NULL]]
        ELSE [['ENTITY_IDENTIFIER', 'SEC_CIK:' || k, 'SEC_CIK', '000' || k, '', NULL], ['ENTITY_NAME', 'SEC_CIK:' || k, 'display_name', c_name, '', NULL], ['EVENT', 'SEC_CIK:' || k, 'filing_published', '10-K', 'SEC_ACCESSION:a' || k || '#h' || k, '2021-03-04T00:00:00+00:00']] END) AS x FROM c)
        SELECT k AS c_custkey, x[1] AS type, x[2] AS subject, x[3] AS attribute, x[4] AS value, x[5] AS object_ref, x[6] AS source_time FROM e""",
    "j15_pair_features": duck(
        """, s AS (SELECT *, seq % 4 > 0 AS a, seq % 3 = 0 AS r, seq % 5 = 0 AS u, CASE WHEN seq % 7 > 0 THEN valid_from END AS t FROM objects),
        p AS (SELECT l.object_id, l.version, l.a = x.a AS same, CASE WHEN l.r AND x.r THEN CASE WHEN l.seq % 2 = x.seq % 2 THEN 'SYSTEM_MATCH' ELSE 'CONFLICT' END WHEN l.u OR x.u THEN 'ABSENT' WHEN l.seq % 2 = x.seq % 2 THEN 'ATTRIBUTE_MATCH' ELSE 'CONFLICT' END AS identifier,
          abs(epoch(x.t) - epoch(l.t)) / 3600 AS gap, radians(l.seq % 3 / 10.0) AS la, radians(x.seq % 3 / 10.0) AS lb, radians((x.seq % 2 - l.seq % 2) / 10.0) AS dl,
          CASE WHEN l.seq % 9 = 0 OR x.seq % 9 = 0 THEN 'UNKNOWN' WHEN l.priority = x.priority THEN 'SAME_SOURCE' ELSE 'DIFFERENT_SOURCES' END AS sources,
          concat_ws(',', CASE WHEN abs(l.seq % 6 - x.seq % 6) > 0.2 * greatest(l.seq % 6 + 20, x.seq % 6 + 20) THEN 'speed' END, CASE WHEN l.seq % 2 = 1 AND x.seq % 2 = 1 AND l.status <> x.status THEN 'status' END) AS contradictions,
          CASE WHEN l.seq % 8 > 0 AND x.seq % 8 > 0 THEN least(l.seq % 8, x.seq % 8) / 8.0 END AS confidence FROM s l JOIN s x ON x.object_id = l.object_id AND x.version = l.version + 1),
        d AS (SELECT *, CASE WHEN gap IS NULL THEN 'UNKNOWN' WHEN gap <= 12 THEN 'COMPATIBLE' ELSE 'INCOMPATIBLE' END AS temporal, CASE WHEN gap IS NULL THEN 'UNKNOWN' WHEN 2 * 6371008.8 * asin(sqrt(sin((lb - la) / 2) ** 2 + cos(la) * cos(lb) * sin(dl / 2) ** 2)) <= 80000 * greatest(gap, 0.25) THEN 'COMPATIBLE' ELSE 'IMPLAUSIBLE_SPEED' END AS geospatial FROM p)
        SELECT object_id, version, identifier, CASE WHEN same THEN 'MATCH' ELSE 'MISMATCH' END AS type, temporal, geospatial, sources, contradictions, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN NOT same OR (object_id + version) % 10 = 0 OR identifier = 'CONFLICT' OR (geospatial = 'IMPLAUSIBLE_SPEED' AND identifier <> 'SYSTEM_MATCH') THEN 'REJECT_ASSOCIATION'
          WHEN contradictions <> '' THEN 'UNKNOWN' WHEN identifier = 'SYSTEM_MATCH' AND temporal <> 'INCOMPATIBLE' THEN 'AUTO_ASSOCIATE' WHEN identifier = 'ATTRIBUTE_MATCH' OR (temporal = 'COMPATIBLE' AND geospatial = 'COMPATIBLE') THEN 'PROPOSE_ASSOCIATION' ELSE 'UNKNOWN' END AS outcome FROM d""", "objects"),
    "s21_export_import": duck(_counts({"log": "SELECT count(*) FROM log", "objects": "SELECT count(*) FROM objects", "markings": "SELECT count(*) FROM markings", "decisions": "SELECT count(*) FROM forecasts", "relationships": "SELECT count(*) FROM relations"}), "log", "objects", "markings", "forecasts", "relations"),
    "q30_exit_test": "SELECT unnest(['event_count_equal', 'log_order_equal', 'log_contents_equal', 'projection_equal', 'object_ids_preserved', 'history_preserved', 'markings_preserved', 'contents_preserved', 'decisions_preserved', 'relationships_preserved']) AS \"check\", true AS equal",
    "s23_dissemination": duck(
        f", v AS ({VISIBLE_SQL}), c AS {_CURRENT} " + _counts({
            "projection": "SELECT count(*) FROM c WHERE object_id IN (FROM v)", "changes": f"SELECT count(*) FROM objects WHERE seq > {CUT} AND object_id IN (FROM v)", "alerts": "SELECT count(*) FROM c WHERE status = 'P' AND object_id IN (FROM v)",
            "decisions": "SELECT count(*) FROM forecasts WHERE outcome AND forecast_id IN (FROM v)", "provenance_refs": "SELECT count(*) FROM relations WHERE source_id IN (FROM v)", "sitrep": "SELECT count(*) FROM c WHERE object_id IN (FROM v)",
        }), "objects", "markings", "forecasts", "relations"),
}

QUERIES = {
    f.__name__: f
    for f in (
        q05_advanced_claims, q06_settled_standing, r07_propagated_changes, r11_carried_changes, r11_questioned_assumptions, q09_association_links, q08_alerts, q08_frozen_evidence,
        q18_refreshed_themes, q22_update_verdicts, f21_structured_observations, j15_pair_features, s21_export_import, q30_exit_test, s23_dissemination,
    )
}
