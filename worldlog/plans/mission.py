"""Queries over a mission of nine families of records, made from the tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from worldlog import roles
from worldlog.operators import access, explain, reads, redaction, references
from worldlog.operators.graph import kept_by
from worldlog.operators.references import Blob, DynamicRef, Label, OwnId, Ref, RefPairs, annotated
from worldlog.roles import duck, table

READER = access.Context("EUROPE", ("C0", "C1", "C2"), (), "ANALYST")
MARKING = ["owning_authority", "compartments", "releasability", "min_role"]
ALIASES = {"object": "entity"}
#: From a kind to what it names, which is also walked back when a basis is closed.
BACKWARD = {("claim", "observation"), ("observation", "manifestation"), ("assumption", "objective"), ("impact_path", "objective")}


def _id(kind: str, n: Column | str | int) -> Column:
    n = F.col(n) if isinstance(n, str) else F.lit(n) if isinstance(n, int) else n
    return F.concat(F.lit(f"{kind}-"), F.substring(F.md5(n.cast("long").cast("string")), 1, 20))


def _marked(df: DataFrame, n: str) -> DataFrame:
    n = F.col(n)
    return df.withColumns(
        {
            "owning_authority": F.when(n % 7 == 3, "ASIA").otherwise("EUROPE"),
            "compartments": F.array(F.concat(F.lit("C"), n % 11 % 4)),
            "releasability": F.array().cast("array<string>"),
            "min_role": F.when(n % 13 == 5, "SUPERVISOR").otherwise("OBSERVER"),
        }
    )


def _struct(**fields: tuple) -> StructType:
    return StructType([StructField(n, t, True, m) for n, (t, m) in fields.items()])


def _families(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Manifestations, observations, claims, entities, assumptions, objectives, impact paths, forecasts and warnings."""
    text, texts = StringType(), ArrayType(StringType())
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    docs = _marked(table(spark, sf_dir, "documents"), "doc_id")
    prior = F.when(F.col("doc_id") % 10 == 1, _id("man", F.col("doc_id") - 1))
    manifestation = docs.select(_id("man", "doc_id").alias("manifestation_id"), say("src-", F.col("source")).alias("source_id"), prior.alias("prior_manifestation_id"), *MARKING)

    anchors = ArrayType(_struct(manifestation_id=(text, Ref("manifestation")), place=(text, None)))
    events = _marked(table(spark, sf_dir, "events"), "event_id")
    anchor = F.array(F.struct(_id("man", F.col("event_id") % 900).alias("manifestation_id"), F.lit("head").alias("place"))).cast(anchors)
    observation = events.select(_id("obs", "event_id").alias("observation_id"), anchor.alias("anchors"), _id("ent", "user_id").alias("subject_id"), F.md5("props").alias("inference_id"), F.col("ts").alias("observed_time"), *MARKING)

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    blob = say('{"note":"see ', _id("clm", k + 1), '","about":[{"claim_id":"', _id("clm", k - 1), '","said":"x"},{"subject_kind":"Object","subject_ref":"', _id("ent", c + 1), '"}],"assumption_ids":["', _id("asm", k % 90), '",""]}')
    claim = _marked(table(spark, sf_dir, "orders"), "o_orderkey").select(
        _id("clm", k).alias("claim_id"), F.array(_id("obs", k % 9000), _id("obs", c), F.lit("")).alias("observation_ids"), F.when(k % 2 == 0, "object").otherwise("relation").alias("subject_kind"),
        F.when(k % 2 == 0, _id("ent", c)).otherwise(_id("rel", k)).alias("subject_ref"), blob.alias("payload"), *MARKING,
    )
    n = F.col("c_custkey")
    customers = _marked(table(spark, sf_dir, "customer"), "c_custkey")
    entity = customers.select(_id("ent", n).alias("entity_id"), F.col("c_name").alias("name"), *MARKING)
    basis = _struct(supporting_claim_ids=(texts, Ref("claim")), contradicting_claim_ids=(texts, Ref("claim")))
    support = F.struct(F.array(_id("clm", n * 9), _id("clm", n * 5)).alias("supporting_claim_ids"), F.array(_id("clm", n * 7 + 1)).alias("contradicting_claim_ids")).cast(basis)
    forecast = customers.select(_id("fct", n).alias("forecast_id"), support.alias("basis"), F.array(_id("asm", n % 90)).alias("assumption_ids"), *MARKING)
    s, p, m = F.col("s_suppkey"), F.col("p_partkey"), F.col("n_nationkey").cast("long")
    assumption = _marked(table(spark, sf_dir, "supplier"), "s_suppkey").select(_id("asm", s).alias("assumption_id"), F.array(_id("obj", "s_nationkey")).alias("objective_ids"), F.array(_id("clm", s * 3)).alias("claim_ids"), *MARKING)
    edge = _struct(from_kind=(text, None), from_id=(text, DynamicRef("from_kind")), to_kind=(text, None), to_id=(text, DynamicRef("to_kind")), basis_ids=(texts, Ref()))
    hop = lambda a, b: F.struct(F.lit("object").alias("from_kind"), _id("ent", a).alias("from_id"), F.lit("entity").alias("to_kind"), _id("ent", b).alias("to_id"), F.array(_id("clm", p)).alias("basis_ids"))
    impact_path = _marked(table(spark, sf_dir, "part"), "p_partkey").select(
        _id("pth", p).alias("path_id"), _id("obj", p % 25).alias("objective_id"), F.array(hop(p % 150, p % 70), hop(p % 70, p % 40)).cast(ArrayType(edge)).alias("edges"), F.array(_id("asm", p % 90)).alias("assumption_ids"), *MARKING,
    )
    nations = _marked(table(spark, sf_dir, "nation"), "n_nationkey")
    depends = F.array(F.struct(F.lit("object").alias("kind"), _id("ent", m).alias("ref")), F.struct(F.lit("entity").alias("kind"), _id("ent", m + 30).alias("ref")))
    objective = nations.select(_id("obj", m).alias("objective_id"), depends.alias("depends_on"), F.col("n_name").alias("title"), *MARKING)
    warning = nations.select(_id("wrn", m).alias("warning_id"), _id("fct", m * 3).alias("forecast_id"), _id("obj", m).alias("objective_id"), F.array(_id("pth", m * 2), _id("pth", m * 2 + 1)).alias("impact_path_ids"), *MARKING)
    return {
        "manifestation": annotated(manifestation, manifestation_id=OwnId(), source_id=Ref("source"), prior_manifestation_id=Ref("manifestation")),
        "observation": annotated(observation, observation_id=OwnId(), subject_id=Ref("entity"), inference_id=Label()),
        "claim": annotated(claim, claim_id=OwnId(), observation_ids=Ref("observation"), subject_ref=DynamicRef("subject_kind"), payload=Blob()),
        "entity": annotated(entity, entity_id=OwnId()),
        "assumption": annotated(assumption, assumption_id=OwnId(), objective_ids=Ref("objective"), claim_ids=Ref("claim")),
        "objective": annotated(objective, objective_id=OwnId(), depends_on=RefPairs()),
        "impact_path": annotated(impact_path, path_id=OwnId(), objective_id=Ref("objective"), assumption_ids=Ref("assumption")),
        "forecast": annotated(forecast, forecast_id=OwnId(), assumption_ids=Ref("assumption")),
        "warning": annotated(warning, warning_id=OwnId(), forecast_id=Ref("forecast"), objective_id=Ref("objective"), impact_path_ids=Ref("impact_path")),
    }


def _bridge(families: dict[str, DataFrame]) -> DataFrame:
    return references.bridge(families, ALIASES)


def _resolved(families: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """References that name a record; they may repeat. What names no family is left before any shuffle."""
    found = references.named(families, ALIASES).filter(F.col("kind").isin(references.ANY, *families))
    return references.resolved(found, records)


def x3_reference_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference that any record makes: by its family's schema, nested fields and free JSON too."""
    return _bridge(_families(spark, sf_dir))


def g10_closure_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the warnings rest on, over the bridge; what draws on an observation, a manifestation or an objective too."""
    families = _families(spark, sf_dir)
    records = kept_by(references.records_of(families), "records", "ref")
    edges = references.directions(_resolved(families, records), BACKWARD)
    found, _ = reads.closure(families["warning"].select(F.col("warning_id").alias("ref")), edges, records.select("ref").distinct(), resolved=True)
    return found.join(records, "ref").select("kind", "ref")


SECTIONS = {
    "WHAT": ("warning",), "JUDGMENT": ("forecast",), "WHY": ("claim/basis.supporting_claim_ids",), "AGAINST": ("claim/basis.contradicting_claim_ids",), "SOURCE_BASIS": ("observation", "manifestation"),
    "INFERENCES": ("assumption", "impact_path"), "MISSION_EFFECT": ("objective",), "ENTITIES": ("entity",),
}


def _descent(spark: SparkSession, sf_dir: str) -> dict:
    """What explanations of forecasts and warnings go by. Nothing is met below what is hidden, so that what hidden rows name is apart."""
    families, seen = _families(spark, sf_dir), access.can_view(READER)
    named = lambda rows: references.named({k: df.filter(rows) for k, df in families.items()}, ALIASES).filter(F.col("kind").isin(references.ANY, *families))
    seeds = families["forecast"].select(F.col("forecast_id").alias("ref")).union(families["warning"].select("warning_id"))
    return {"seeds": seeds, "edges": named(seen), "hidden": named(~seen), "records": references.records_of(families, seen.alias("visible")), "hops": 4}


def q12_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts and warnings explained in eight sections: how much each holds, how much of it is hidden, and the first visible id."""
    return explain.explained(**_descent(spark, sf_dir), places=SECTIONS)


def q12_explanation_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walks themselves: every node with the hop, the field and the record it was met by, hidden ones as stand-ins."""
    return explain.descent(**_descent(spark, sf_dir)).select("seed", "hop", "parent", "field", "kind", "ref")


def q02_redacted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader sees of entities in versions, claims, and transitions; hidden ids within words, with versions and cut short."""
    rows = roles.objects(spark, sf_dir)
    n, k = F.col("object_id"), F.col("seq")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    note = say("by ", _id("clm", k), "@v2, x", _id("ent", n + 1), "y and ", F.substring(_id("ent", n * 3), 1, 18), ".")
    entity = _marked(rows, "object_id").select(_id("ent", n).alias("entity_id"), "status", note.alias("note"), "version", *MARKING)
    claim = _marked(rows, "seq").select(_id("clm", k).alias("claim_id"), _id("ent", n).alias("subject"), F.lit(None).cast("string").alias("said"), F.lit(1).alias("version"), *MARKING)
    events = _marked(table(spark, sf_dir, "events"), "event_id")
    transition = events.select(_id("trn", "event_id").alias("transition_id"), F.array(_id("ent", F.col("user_id") * 2), _id("clm", F.col("event_id") + 1)).alias("about"), *MARKING)
    return redaction.projection({"entity": (entity, "entity_id"), "claim": (claim, "claim_id")}, {"transition": (transition, "transition_id")}, access.can_view(READER), MARKING)


def _i(kind: str, n: str) -> str:
    return f"'{kind}-' || left(md5(CAST({n} AS BIGINT)::VARCHAR), 20)"


def _seen_sql(n: str) -> str:
    return f"({n} % 7 <> 3 AND {n} % 11 % 4 <> 3 AND {n} % 13 <> 5)"


_REFS = f"""recs AS (SELECT 'manifestation' AS kind, {_i('man', 'doc_id')} AS ref, {_seen_sql('doc_id')} AS visible FROM documents UNION SELECT 'observation', {_i('obs', 'event_id')}, {_seen_sql('event_id')} FROM events
  UNION SELECT 'claim', {_i('clm', 'o_orderkey')}, {_seen_sql('o_orderkey')} FROM orders UNION SELECT 'entity', {_i('ent', 'c_custkey')}, {_seen_sql('c_custkey')} FROM customer UNION SELECT 'assumption', {_i('asm', 's_suppkey')}, {_seen_sql('s_suppkey')} FROM supplier
  UNION SELECT 'objective', {_i('obj', 'n_nationkey')}, {_seen_sql('n_nationkey')} FROM nation UNION SELECT 'impact_path', {_i('pth', 'p_partkey')}, {_seen_sql('p_partkey')} FROM part
  UNION SELECT 'forecast', {_i('fct', 'c_custkey')}, {_seen_sql('c_custkey')} FROM customer UNION SELECT 'warning', {_i('wrn', 'n_nationkey')}, {_seen_sql('n_nationkey')} FROM nation),
refs(src_kind, src, field, kind, ref) AS MATERIALIZED (
  SELECT 'manifestation', {_i('man', 'doc_id')}, 'source_id', 'source', 'src-' || source FROM documents UNION SELECT 'manifestation', {_i('man', 'doc_id')}, 'prior_manifestation_id', 'manifestation', {_i('man', 'doc_id - 1')} FROM documents WHERE doc_id % 10 = 1
  UNION SELECT 'observation', {_i('obs', 'event_id')}, 'anchors.manifestation_id', 'manifestation', {_i('man', 'event_id % 900')} FROM events UNION SELECT 'observation', {_i('obs', 'event_id')}, 'subject_id', 'entity', {_i('ent', 'user_id')} FROM events
  UNION SELECT 'claim', {_i('clm', 'o_orderkey')}, 'observation_ids', 'observation', unnest([{_i('obs', 'o_orderkey % 9000')}, {_i('obs', 'o_custkey')}]) FROM orders
  UNION SELECT 'claim', {_i('clm', 'o_orderkey')}, 'subject_ref', CASE WHEN o_orderkey % 2 = 0 THEN 'entity' ELSE 'relation' END, CASE WHEN o_orderkey % 2 = 0 THEN {_i('ent', 'o_custkey')} ELSE {_i('rel', 'o_orderkey')} END FROM orders
  UNION SELECT 'claim', {_i('clm', 'o_orderkey')}, 'payload', 'claim', {_i('clm', 'o_orderkey - 1')} FROM orders UNION SELECT 'claim', {_i('clm', 'o_orderkey')}, 'payload', 'entity', {_i('ent', 'o_custkey + 1')} FROM orders
  UNION SELECT 'claim', {_i('clm', 'o_orderkey')}, 'payload', 'assumption', {_i('asm', 'o_orderkey % 90')} FROM orders
  UNION SELECT 'assumption', {_i('asm', 's_suppkey')}, 'objective_ids', 'objective', {_i('obj', 's_nationkey')} FROM supplier UNION SELECT 'assumption', {_i('asm', 's_suppkey')}, 'claim_ids', 'claim', {_i('clm', 's_suppkey * 3')} FROM supplier
  UNION SELECT 'objective', {_i('obj', 'n_nationkey')}, 'depends_on', 'entity', unnest([{_i('ent', 'n_nationkey')}, {_i('ent', 'n_nationkey + 30')}]) FROM nation
  UNION SELECT 'impact_path', {_i('pth', 'p_partkey')}, 'objective_id', 'objective', {_i('obj', 'p_partkey % 25')} FROM part UNION SELECT 'impact_path', {_i('pth', 'p_partkey')}, 'assumption_ids', 'assumption', {_i('asm', 'p_partkey % 90')} FROM part
  UNION SELECT 'impact_path', {_i('pth', 'p_partkey')}, 'edges.from_id', 'entity', unnest([{_i('ent', 'p_partkey % 150')}, {_i('ent', 'p_partkey % 70')}]) FROM part UNION SELECT 'impact_path', {_i('pth', 'p_partkey')}, 'edges.to_id', 'entity', unnest([{_i('ent', 'p_partkey % 70')}, {_i('ent', 'p_partkey % 40')}]) FROM part
  UNION SELECT 'impact_path', {_i('pth', 'p_partkey')}, 'edges.basis_ids', '*', {_i('clm', 'p_partkey')} FROM part
  UNION SELECT 'forecast', {_i('fct', 'c_custkey')}, 'basis.supporting_claim_ids', 'claim', unnest([{_i('clm', 'c_custkey * 9')}, {_i('clm', 'c_custkey * 5')}]) FROM customer UNION SELECT 'forecast', {_i('fct', 'c_custkey')}, 'basis.contradicting_claim_ids', 'claim', {_i('clm', 'c_custkey * 7 + 1')} FROM customer
  UNION SELECT 'forecast', {_i('fct', 'c_custkey')}, 'assumption_ids', 'assumption', {_i('asm', 'c_custkey % 90')} FROM customer
  UNION SELECT 'warning', {_i('wrn', 'n_nationkey')}, 'forecast_id', 'forecast', {_i('fct', 'n_nationkey * 3')} FROM nation UNION SELECT 'warning', {_i('wrn', 'n_nationkey')}, 'objective_id', 'objective', {_i('obj', 'n_nationkey')} FROM nation
  UNION SELECT 'warning', {_i('wrn', 'n_nationkey')}, 'impact_path_ids', 'impact_path', unnest([{_i('pth', 'n_nationkey * 2')}, {_i('pth', 'n_nationkey * 2 + 1')}]) FROM nation),
edges AS MATERIALIZED (SELECT src_kind, src, field, recs.kind, ref, visible FROM refs JOIN recs USING (ref) WHERE refs.kind = '*' OR refs.kind = recs.kind)"""
_WALK = f"""WITH RECURSIVE {_REFS},
way AS (SELECT ref AS seed, 0 AS hop, kind, ref, visible FROM recs WHERE kind IN ('forecast', 'warning') AND visible
  UNION SELECT seed, hop + 1, e.kind, e.ref, e.visible FROM way w JOIN edges e ON e.src = w.ref WHERE w.visible AND hop < 4),
met AS MATERIALIZED (SELECT seed, kind, ref, visible, min(hop) AS hop FROM way GROUP BY ALL),
walk AS (SELECT m.seed, m.hop, min({{'p': e.src, 'f': e.field}}) AS b, m.kind, m.ref, m.visible FROM met m LEFT JOIN (SELECT p.seed, p.hop, e.* FROM met p JOIN edges e ON e.src = p.ref WHERE p.visible) e ON e.seed = m.seed AND e.hop = m.hop - 1 AND e.kind = m.kind AND e.ref = m.ref GROUP BY ALL)"""

SQL = {
    "x3_reference_bridge": f"WITH {_REFS} SELECT * FROM refs",
    "g10_closure_both_ways": f"""WITH RECURSIVE {_REFS},
        ways AS (SELECT src, ref FROM edges UNION SELECT ref, src FROM edges WHERE (src_kind, kind) IN (('claim', 'observation'), ('observation', 'manifestation'), ('assumption', 'objective'), ('impact_path', 'objective'))),
        reach AS (SELECT ref FROM recs WHERE kind = 'warning' UNION SELECT ways.ref FROM reach JOIN ways ON ways.src = reach.ref)
        SELECT kind, ref FROM reach JOIN recs USING (ref)""",
    "q12_explanation_walk": f"{_WALK} SELECT seed, CAST(hop AS INT) AS hop, b.p AS parent, b.f AS field, kind, CASE WHEN visible THEN ref ELSE 'REDACTED' END AS ref FROM walk",
    "q12_explanations": f"""{_WALK}, parts AS (SELECT *, unnest(list_filter([CASE WHEN kind = 'warning' THEN 'WHAT' END, CASE WHEN kind = 'forecast' THEN 'JUDGMENT' END, CASE WHEN kind = 'claim' AND b.f = 'basis.supporting_claim_ids' THEN 'WHY' END,
          CASE WHEN kind = 'claim' AND b.f = 'basis.contradicting_claim_ids' THEN 'AGAINST' END, CASE WHEN kind IN ('observation', 'manifestation') THEN 'SOURCE_BASIS' END, CASE WHEN kind IN ('assumption', 'impact_path') THEN 'INFERENCES' END,
          CASE WHEN kind = 'objective' THEN 'MISSION_EFFECT' END, CASE WHEN kind = 'entity' THEN 'ENTITIES' END], lambda x: x IS NOT NULL)) AS section FROM walk)
        SELECT seed, section, count(*) AS n, count(*) FILTER (WHERE NOT visible) AS n_hidden, min(ref) FILTER (WHERE visible) AS "first" FROM parts GROUP BY 1, 2""",
    "q02_redacted_projection": duck(
        f""", e AS (SELECT object_id AS n, count(*) AS nv, arg_max(seq, version) AS k, arg_max(status, version) AS st FROM objects GROUP BY 1),
        he AS (SELECT n FROM e WHERE NOT {_seen_sql('n')}), hc AS (SELECT seq AS n FROM objects WHERE NOT {_seen_sql('seq')})
        SELECT 'entity' AS family, {_i('ent', 'n')} AS ref, nv AS n_versions, '{{"entity_id":"' || {_i('ent', 'n')} || '","status":"' || st || '","note":"by ' || CASE WHEN k IN (FROM hc) THEN 'REDACTED' ELSE {_i('clm', 'k')} || '@v2' END || ', x'
          || CASE WHEN n + 1 IN (FROM he) THEN 'REDACTED' ELSE {_i('ent', 'n + 1')} END || 'y and ' || CASE WHEN n * 3 IN (FROM he) THEN 'REDACTED' ELSE left({_i('ent', 'n * 3')}, 18) END || '.","version":' || nv || '}}' AS record FROM e WHERE n NOT IN (FROM he)
        UNION ALL SELECT 'claim', {_i('clm', 'seq')}, 1, '{{"claim_id":"' || {_i('clm', 'seq')} || '","subject":"' || CASE WHEN object_id IN (FROM he) THEN 'REDACTED' ELSE {_i('ent', 'object_id')} END || '","said":null,"version":1}}' FROM objects WHERE seq NOT IN (FROM hc)
        UNION ALL SELECT 'transition', {_i('trn', 'event_id')}, 1, '{{"transition_id":"' || {_i('trn', 'event_id')} || '","about":["' || CASE WHEN user_id * 2 IN (FROM he) THEN 'REDACTED' ELSE {_i('ent', 'user_id * 2')} END || '","' || CASE WHEN event_id + 1 IN (FROM hc) THEN 'REDACTED' ELSE {_i('clm', 'event_id + 1')} END || '"]}}'
          FROM events WHERE {_seen_sql('event_id')}""", "objects"),
}

QUERIES = {f.__name__: f for f in (x3_reference_bridge, g10_closure_both_ways, q12_explanations, q12_explanation_walk, q02_redacted_projection)}
