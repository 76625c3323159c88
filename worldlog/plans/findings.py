"""Queries of rules and of report findings, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog.operators import graph, rules, sitrep
from worldlog.operators.ingest import any_of
from worldlog.roles import SNAPSHOT, table

ROUTE_METRES = 3_000.0
_STATUSES = ("OPERATIONAL", "DAMAGED", "BLOCKED", "UNKNOWN", "DEGRADED")


def _scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as places of six types over some hundred kilometres, relations by their numbers, labels as dependence groups."""
    n, e = F.col("vec_id"), F.col("embedding")
    lon, lat = F.round(e[0].cast("double") * 4, 6), F.round(e[1].cast("double") * 4, 6)
    types = ("OPERATIONAL_CONCERN", "INFRASTRUCTURE", "ROUTE", "MOVEMENT", "OBSERVATION", "RESOURCE_STOCK")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    line = F.when(n % 6 == 2, F.array(F.array(lon, lat), F.array(lon + 0.1, lat + 0.05), F.array(lon + 0.1, lat + 0.2)))
    point = ~(n % 6).isin(2, 3)
    objects = table(spark, sf_dir, "embeddings").select(
        n.alias("object_id"), pick(types, n % 6).alias("object_type"), F.when(n % 5 == 4, "CLOSED").otherwise("ACTIVE").alias("lifecycle"), F.when(n % 13 == 1, "DISPUTED").otherwise("REPORTED").alias("epistemic_state"),
        pick(_STATUSES, F.floor(n / 6) % 5).alias("status"), F.when(n % 6 == 4, pick(_STATUSES, F.floor(n / 6) % 5)).alias("reported_status"), (n % 4 == 1).alias("stale"),
        F.when(point, lon).alias("lon"), F.when(point, lat).alias("lat"), line.alias("line"), F.col("label").cast("long").alias("group_id"),
    )
    relation = lambda kind, when, source, target: objects.filter(when).select(F.lit(kind).alias("relation_type"), source.alias("source_id"), target.alias("target_id"))
    o = F.col("object_id")
    relations = any_of(
        relation("REPORTS_ON", o % 6 == 4, o, o - 3), relation("REPORTS_ON", (o % 6 == 4) & (o % 4 == 0), o, o + 3), relation("DEPENDS_ON", o % 6 == 2, o, o - 1), relation("PLANNED_FOR", o % 6 == 3, o, o - 1),
        relation("ALTERNATE_OF", (o % 6 == 2) & (o % 4 == 0), o, o + 6), relation("AFFECTS", (o % 6 == 0) & (o % 10 == 0), o, o + 2),
    )
    known = objects.select("object_id")
    for end in ("source_id", "target_id"):
        relations = relations.join(known.withColumnRenamed("object_id", end), end, "left_semi")
    # every rule reads them: plans begin at what is written
    objects, relations = graph.saved(objects, "objects"), graph.saved(relations.select("relation_type", "source_id", "target_id"), "relations")
    groups = objects.filter("object_type = 'OBSERVATION'").select("group_id", "object_id")
    return objects.drop("group_id"), relations, groups


def q07_six_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that six rules propose over a scene: alerts, states, relationships, assessments, recommendations."""
    return rules.proposals(*_scene(spark, sf_dir), route_metres=ROUTE_METRES)


def q07_route_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, relations, _ = _scene(spark, sf_dir)
    return rules.exposure(objects, relations, ROUTE_METRES)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, relations, groups = _scene(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    sources = events.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    none = spark.createDataFrame([], "decision_id string, state string, actor string, rationale string")
    exposed = graph.saved(rules.exposure_counts(objects, relations, ROUTE_METRES), "exposure")
    proposed = rules.proposals(objects, relations, groups, route_metres=ROUTE_METRES, exposed=exposed, pairs=False)
    # a report tells alerts and recommendations alone, in three of its sections
    told = graph.saved(proposed.filter(F.col("kind").isin("ALERT", "RECOMMENDATION")), "proposals")
    return sitrep.items(objects, exposed, told, groups, none, sources)


def q10_report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The situation report's twelve sections, item by item."""
    return _report(spark, sf_dir)


def s24_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as lines of four formats, in their order."""
    found = graph.saved(_report(spark, sf_dir), "items")
    return any_of(*(sitrep.lines(found, f).select(F.lit(f).alias("format"), "place", "line") for f in sitrep.FORMATS))


def q26_eleven_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as sentences of reports on orders (claims), customers (forecasts) and documents (manifestations)."""
    c, t = F.col("conv_id"), F.col("turn")
    k = c * 5 + t
    ref = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    refs = (
        F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 9 == 1, F.array(ref("clm", c * 3), ref("clm", c * 7 + 1))).when(k % 9 == 2, F.array(ref("fct", c), ref("clm", t)))
        .when(k % 9 == 3, F.array(ref("fct", c), ref("fct", c + 1))).when(k % 9 == 4, F.array(ref("man", c), ref("man", c * 1000), ref("man", c * 1000))).when(k % 9 == 5, F.array(ref("hyp", c)))
        .when(k % 9 == 6, F.array(ref("clm", c), ref("fct", c % 7))).otherwise(F.array(ref("clm", c * 11), ref("clm", c * 13), ref("clm", c * 17)))
    )
    sentences = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", c, t).alias("sentence_id"), F.concat(F.lit("About 0."), c % 100 + 10, F.lit(" or "), c % 90, F.lit("% or ."), k % 9 + 1, F.lit(" of it, 1.5 and 1234%")).alias("text"), F.when(k % 4 == 3, "EXPLICITLY_INFERENTIAL").otherwise("SUPPORTED").alias("status"),
        F.when(k % 5 == 1, "HISTORICAL").when(k % 5 == 2, "CURRENT").otherwise("").alias("temporal_scope"), (k % 3 == 0).alias("asserts_independent"), refs.alias("basis_refs"),
    ).distinct()
    orders, o = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = F.lit(None)
    state = F.when(o % 17 == 0, "INFERRED").when(o % 19 == 0, "DISPUTED").otherwise("REPORTED")
    claims = orders.select(F.lit("semantic_claim").alias("kind"), ref("clm", o).alias("ref"), state.alias("epistemic_state"), F.when(o % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("valid_to"), (o % 4).alias("independent_basis_count"))
    other = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), id_.alias("ref"), none.cast("string").alias("epistemic_state"), none.cast("timestamp_ntz").alias("valid_to"), none.cast("long").alias("independent_basis_count"))
    records = any_of(
        claims, other(table(spark, sf_dir, "customer"), "analytic_forecast", ref("fct", F.col("c_custkey"))), other(table(spark, sf_dir, "documents"), "fabric_manifestation", ref("man", F.col("doc_id"))),
        other(table(spark, sf_dir, "supplier"), "hypothesis", ref("hyp", F.col("s_suppkey"))),
    )
    states = orders.filter("o_orderkey % 5 = 0").select(ref("clm", o).alias("claim_id"), F.when(o % 10 == 0, "RETRACTED").otherwise("CURRENT").alias("state"))
    reviews = orders.filter("o_orderstatus = 'P'").select(ref("clm", o).alias("subject_id"))
    forecasts = orders.select(ref("fct", F.col("o_custkey")).alias("forecast_id"), ((o * 37 % 99 + 1) / 100.0).cast("double").alias("probability"))
    return rules.report_findings(sentences, records, states, reviews, forecasts, F.lit(SNAPSHOT).cast("timestamp_ntz"))


def _metres(a: str, b: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


_SCENE = f"""WITH b AS (SELECT vec_id AS n, round(embedding[1]::DOUBLE * 4, 6) AS x, round(embedding[2]::DOUBLE * 4, 6) AS y, label FROM embeddings),
  o AS MATERIALIZED (SELECT n, n % 6 AS t, n % 5 <> 4 AS active, n % 13 = 1 AS disputed, ['OPERATIONAL', 'DAMAGED', 'BLOCKED', 'UNKNOWN', 'DEGRADED'][n // 6 % 5 + 1] AS status, CASE WHEN n % 6 = 4 THEN status END AS said, n % 4 = 1 AS stale, x AS lon, y AS lat, label FROM b),
  seg AS (SELECT n AS route, lon AS x1, lat AS y1, lon + 0.1 AS x2, lat + 0.05 AS y2 FROM o WHERE t = 2 UNION ALL SELECT n, lon + 0.1, lat + 0.05, lon + 0.1, lat + 0.2 FROM o WHERE t = 2),
  far AS MATERIALIZED (SELECT p.n, route, min(sqrt(pow(x1 + s * (x2 - x1), 2) + pow(y1 + s * (y2 - y1), 2))) AS m FROM (
      SELECT n, route, x1, y1, x2, y2, greatest(0, least(1, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS s FROM (
        SELECT p.n, route, (x1 - lon) * k * cos(radians(lat)) AS x1, (y1 - lat) * k AS y1, (x2 - lon) * k * cos(radians(lat)) AS x2, (y2 - lat) * k AS y2 FROM o p, seg, (SELECT radians(1.0) * 6371008.8 AS k) WHERE p.t IN (0, 4))) p GROUP BY 1, 2),
  rel AS MATERIALIZED (SELECT * FROM (SELECT 'REPORTS_ON' AS kind, n AS a, n - 3 AS b FROM o WHERE t = 4 UNION SELECT 'REPORTS_ON', n, n + 3 FROM o WHERE t = 4 AND n % 4 = 0 UNION SELECT 'DEPENDS_ON', n, n - 1 FROM o WHERE t = 2 UNION SELECT 'PLANNED_FOR', n, n - 1 FROM o WHERE t = 3
    UNION SELECT 'ALTERNATE_OF', n, n + 6 FROM o WHERE t = 2 AND n % 4 = 0 UNION SELECT 'AFFECTS', n, n + 2 FROM o WHERE t = 0 AND n % 10 = 0) WHERE b IN (SELECT n FROM o)),
  bad(s) AS (VALUES ('DAMAGED'), ('BLOCKED'), ('DEGRADED')),
  rep AS (SELECT a AS report, b AS target, said FROM rel JOIN o ON n = a WHERE kind = 'REPORTS_ON'),
  f AS (SELECT b AS route, a AS d, 0 AS r FROM rel WHERE kind = 'AFFECTS' UNION ALL SELECT a, b, 1 FROM rel JOIN o ON n = b WHERE kind = 'DEPENDS_ON' AND disputed UNION ALL SELECT a, b, 2 FROM rel JOIN o ON n = b WHERE kind = 'DEPENDS_ON' AND status IN (FROM bad)
    UNION ALL SELECT a, report, 3 FROM rel JOIN rep ON target = b WHERE kind = 'DEPENDS_ON' AND said IN (FROM bad) UNION ALL SELECT route, far.n, 4 FROM far JOIN o ON o.n = far.n WHERE m <= {ROUTE_METRES} AND (t = 0 AND active OR said IN (FROM bad))),
  ex AS MATERIALIZED (SELECT route, d, max(r) AS r FROM f WHERE route IN (SELECT n FROM o WHERE t = 2) GROUP BY 1, 2), cnt AS (SELECT o.n AS route, count(d) AS k FROM o LEFT JOIN ex ON route = o.n WHERE t = 2 GROUP BY 1)"""

_PROPOSED = f"""{_SCENE}, con AS (SELECT target, string_agg(DISTINCT said, ',' ORDER BY said) AS s, count(*) AS k FROM rep WHERE said <> 'UNKNOWN' GROUP BY 1 HAVING count(DISTINCT said) > 1),
        hit AS (SELECT n, route AS target FROM far JOIN o USING (n) WHERE t = 0 AND active AND m <= 30000 UNION SELECT a.n, b.n FROM o a JOIN o b ON b.t = 1 WHERE a.t = 0 AND a.active AND {_metres('a', 'b')} <= 30000),
        way AS (SELECT route, min(w) AS w FROM (SELECT a AS route, b AS w FROM rel WHERE kind = 'ALTERNATE_OF' UNION SELECT b, a FROM rel WHERE kind = 'ALTERNATE_OF') JOIN (SELECT route AS w FROM cnt WHERE k = 0) USING (w) GROUP BY 1),
        plan AS (SELECT a AS movement, route, k FROM rel JOIN cnt ON route = b WHERE kind = 'PLANNED_FOR' AND k > 0),
        prop AS (SELECT rule, kind, subject::VARCHAR AS subject, other, n FROM (SELECT 'infrastructure-conflict' AS rule, 'ALERT' AS kind, target AS subject, s AS other, k AS n FROM con UNION ALL SELECT 'infrastructure-conflict', 'STATE', target, 'DISPUTED', k FROM con
        UNION ALL SELECT 'reported-disruption', 'ALERT', target, rep.said, count(*) FROM rep JOIN o ON o.n = target AND t IN (1, 2) WHERE rep.said IN (FROM bad) GROUP BY target, rep.said
        UNION ALL SELECT 'hazard-impact', 'ALERT', n, NULL, count(*) FROM hit GROUP BY n UNION ALL SELECT 'hazard-impact', 'RELATIONSHIP', n, target::VARCHAR, 1 FROM hit UNION ALL SELECT 'route-exposure', 'ASSESSMENT', route, NULL, k FROM cnt WHERE k > 0
        UNION ALL SELECT 'movement-route-risk', 'ALERT', movement, route::VARCHAR, k FROM plan UNION ALL SELECT 'movement-route-risk', 'RECOMMENDATION', movement, w::VARCHAR, k FROM plan JOIN way USING (route)
        UNION ALL SELECT 'stale-stock', 'ALERT', n, NULL, 1 FROM o WHERE t = 5 AND stale UNION ALL SELECT 'source-dependence', 'ALERT', label, NULL, count(*) FROM o WHERE t = 4 GROUP BY label HAVING count(*) > 1))"""
_TITLES = "[" + ", ".join(f"'{s}'" for s in sitrep.SECTIONS) + "]"
_ITEMS = f"""{_PROPOSED}, known AS (SELECT * EXCLUDE (label), ['OPERATIONAL_CONCERN', 'INFRASTRUCTURE', 'ROUTE', 'MOVEMENT', 'OBSERVATION', 'RESOURCE_STOCK'][t + 1] AS type, n::VARCHAR AS key, 'object ' || n AS label, CASE WHEN disputed THEN 'DISPUTED' ELSE 'REPORTED' END AS e FROM o),
  item(section, key, state, label, detail) AS MATERIALIZED (SELECT 'Resources', key, e, label, 'status: ' || status || CASE WHEN stale THEN ' (STALE)' ELSE ' (FRESH)' END FROM known WHERE t = 5
    UNION ALL SELECT 'Infrastructure', key, e, label, 'status: ' || status || CASE WHEN disputed THEN ' - DISPUTED' ELSE '' END FROM known WHERE t = 1 UNION ALL SELECT 'Routes', route::VARCHAR, 'INFERRED', 'object ' || route, CASE WHEN k > 0 THEN k || ' known disruption(s)' ELSE 'no known disruption' END FROM cnt
    UNION ALL SELECT 'Movements', key, e, label, 'status: ' || status FROM known WHERE t = 3 UNION ALL SELECT 'Unresolved conflicts', subject, 'DISPUTED', 'object ' || subject, other FROM prop WHERE rule = 'infrastructure-conflict' AND kind = 'ALERT'
    UNION ALL SELECT 'Stale information', key, 'STALE', label, lower(type) FROM known WHERE stale
    UNION ALL SELECT 'Dependent reporting', label::VARCHAR, 'REPORTED', 'group ' || label, count(*) || ' reports share one underlying basis; they are not independent corroboration' FROM o WHERE t = 4 GROUP BY label HAVING count(*) > 1
    UNION ALL SELECT 'Alerts', concat_ws('/', rule, subject, other), 'OPEN', subject || ' ' || coalesce(other, ''), rule || ': ' || n FROM prop WHERE kind = 'ALERT' UNION ALL SELECT 'Recommendations', concat_ws('/', subject, other), 'PROPOSED', subject || ' ' || coalesce(other, ''), rule || ': ' || n FROM prop WHERE kind = 'RECOMMENDATION'
    UNION ALL SELECT 'Unresolved', key, 'DISPUTED', label, lower(type) FROM known WHERE disputed UNION ALL SELECT 'Provenance', event_type, 'SOURCE', event_type, count(*) || ' record(s)' FROM events GROUP BY event_type)"""

SQL = {
    "q07_route_exposure": f"{_SCENE} SELECT route AS route_id, d AS disruption_id, ['AFFECTS_RELATIONSHIP', 'DEPENDENCY_DISPUTED', 'DEPENDENCY_DISRUPTED', 'DEPENDENCY_REPORTED_DISRUPTED', 'PROXIMATE_DISRUPTION'][r + 1] AS condition FROM ex",
    "q07_six_rules": f"{_PROPOSED} SELECT * FROM prop",
    "q10_report_items": f"{_ITEMS} SELECT * FROM item",
    "s24_report_lines": f"""{_ITEMS}, tt AS (SELECT unnest(titles) AS section, generate_subscripts(titles, 1) AS no FROM (SELECT {_TITLES} AS titles)),
        ll AS (SELECT no, 0 AS r, '' AS key, section, NULL AS state, NULL AS label, NULL AS detail FROM tt UNION ALL SELECT no, 1, key, section, state, label, detail FROM item JOIN tt USING (section)
          UNION ALL SELECT no, 1, '', section, NULL, NULL, NULL FROM tt WHERE section NOT IN (SELECT section FROM item) UNION ALL SELECT no, 2, '', section, NULL, NULL, NULL FROM tt),
        ff AS (SELECT *, unnest(['json', 'markdown', 'text', 'html']) AS format FROM ll),
        hh AS (SELECT format, no, r, key, CASE format
          WHEN 'json' THEN CASE WHEN r = 0 THEN '{{"section":"' || section || '"}}' WHEN state IS NULL THEN '{{"section":"' || section || '","note":"none in this view"}}' ELSE '{{"section":"' || section || '","state":"' || state || '","label":"' || label || '","detail":"' || detail || '"}}' END
          WHEN 'markdown' THEN CASE WHEN r = 0 THEN '## ' || section WHEN r = 2 THEN '' WHEN state IS NULL THEN '- none in this view' ELSE '- **' || state || '** ' || label || ': ' || detail END
          WHEN 'text' THEN CASE WHEN r = 0 THEN upper(section) WHEN r = 2 THEN repeat('-', 72) WHEN state IS NULL THEN '  none in this view' ELSE left('  ' || state || ' ' || label || ': ' || detail, 72) END
          ELSE CASE WHEN r = 0 THEN '<h2>' || section || '</h2><ul>' WHEN r = 2 THEN '</ul>' WHEN state IS NULL THEN '<li>none in this view</li>' ELSE '<li><b>' || state || '</b> ' || label || ': ' || detail || '</li>' END END AS line FROM ff WHERE NOT (format = 'json' AND r = 2))
        SELECT format, row_number() OVER (PARTITION BY format ORDER BY no, r, key, line) AS place, line FROM hh""",
    "q26_eleven_codes": r"""WITH s AS (SELECT DISTINCT conv_id || '-' || turn AS id, conv_id AS c, turn AS t, conv_id * 5 + turn AS k FROM conversations),
        x AS MATERIALIZED (SELECT *, k % 4 <> 3 AS fact, CASE k % 5 WHEN 1 THEN 'HISTORICAL' WHEN 2 THEN 'CURRENT' ELSE '' END AS scope, k % 3 = 0 AS indep, CASE k % 9 WHEN 0 THEN [] WHEN 1 THEN ['clm' || c * 3, 'clm' || c * 7 + 1] WHEN 2 THEN ['fct' || c, 'clm' || t] WHEN 3 THEN ['fct' || c, 'fct' || c + 1]
          WHEN 4 THEN ['man' || c, 'man' || c * 1000] WHEN 5 THEN ['hyp' || c] WHEN 6 THEN ['clm' || c, 'fct' || c % 7] ELSE ['clm' || c * 11, 'clm' || c * 13, 'clm' || c * 17] END AS refs,
          [CAST('0.' || (c % 100 + 10) AS DOUBLE), c % 90 / 100.0::DOUBLE, CAST('.' || (k % 9 + 1) AS DOUBLE), 2.34] AS quoted FROM s),
        r AS (SELECT 'semantic_claim' AS kind, 'clm' || o_orderkey AS ref, CASE WHEN o_orderkey % 17 = 0 THEN 'INFERRED' WHEN o_orderkey % 19 = 0 THEN 'DISPUTED' ELSE 'REPORTED' END AS e, o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 400 DAY <= TIMESTAMP '2001-12-31' AS ended, o_orderkey % 4 AS n,
            o_orderkey % 10 = 0 AS gone, o_orderstatus = 'P' AS open FROM orders UNION ALL SELECT 'analytic_forecast', 'fct' || c_custkey, '', false, NULL, false, false FROM customer UNION ALL SELECT 'fabric_manifestation', 'man' || doc_id, '', false, NULL, false, false FROM documents
          UNION ALL SELECT 'hypothesis', 'hyp' || s_suppkey, '', false, NULL, false, false FROM supplier),
        m AS MATERIALIZED (SELECT x.*, u.ref AS ref, kind, e, ended, n, gone, open FROM (SELECT DISTINCT id, unnest(refs) AS ref FROM x) u JOIN x USING (id) LEFT JOIN r ON r.ref = u.ref),
        g AS (SELECT id, scope, count(*) AS all_, count(*) FILTER (WHERE ended) AS over FROM m WHERE fact AND kind = 'semantic_claim' GROUP BY 1, 2),
        p AS (SELECT 'fct' || o_custkey AS ref, (o_orderkey * 37 % 99 + 1) / 100.0::DOUBLE AS p FROM orders),
        q AS (SELECT DISTINCT x.id, q.q FROM x, unnest(quoted) q(q) WHERE id IN (SELECT id FROM m WHERE kind = 'analytic_forecast')),
        f AS (SELECT id, 'NO_EVIDENCE_BASIS' AS code, NULL AS ref FROM x WHERE fact AND len(refs) = 0 UNION ALL SELECT id, 'UNRESOLVABLE_BASIS', ref FROM m WHERE kind IS NULL
          UNION ALL SELECT id, 'INFERENCE_AS_OBSERVATION', ref FROM m WHERE fact AND (kind IN ('analytic_forecast', 'hypothesis') OR kind = 'semantic_claim' AND e = 'INFERRED') UNION ALL SELECT id, 'STALE_BASIS', ref FROM m WHERE fact AND gone
          UNION ALL SELECT id, 'CONTESTED_AS_SETTLED', ref FROM m WHERE fact AND kind = 'semantic_claim' AND (e = 'DISPUTED' OR open)
          UNION ALL SELECT id, CASE WHEN over = all_ THEN 'HISTORICAL_AS_CURRENT' WHEN scope = '' THEN 'TEMPORAL_SCOPE_REQUIRED' ELSE 'PARTIALLY_HISTORICAL_BASIS' END, NULL FROM g WHERE over > 0 AND scope <> 'HISTORICAL'
          UNION ALL SELECT id, 'INDEPENDENCE_MISREPRESENTED', NULL FROM m WHERE fact AND indep GROUP BY id HAVING coalesce(max(n), 0) < 2 UNION ALL SELECT id, 'MULTI_FORECAST_NUMERIC_AMBIGUITY', NULL FROM m WHERE kind = 'analytic_forecast' GROUP BY id HAVING count(*) > 1
          UNION ALL SELECT DISTINCT id, 'FORECAST_PROBABILITY_MISMATCH', NULL FROM q WHERE NOT EXISTS (SELECT 1 FROM m JOIN p ON p.ref = m.ref WHERE m.id = q.id AND abs(p.p - q.q) < 0.005))
        SELECT id AS sentence_id, code, ref, code NOT IN ('PARTIALLY_HISTORICAL_BASIS', 'MULTI_FORECAST_NUMERIC_AMBIGUITY') AS blocking FROM f""",
}

QUERIES = {f.__name__: f for f in (q07_six_rules, q07_route_exposure, q10_report_items, s24_report_lines, q26_eleven_codes)}
