"""Assessments: hypotheses by live evidence, pivots, what an invalid assumption reaches, replayed actions, definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.operators.graph import dealt
from worldlog.operators.views import first_code
from worldlog.sources import feeds

# States that degrade a claim, where a scheme's identifiers resolve, and what definitions may hold.
DEGRADED = ("DISPUTED", "RETRACTED", "CORRECTED", "STALE", "SUPERSEDED", "SOURCE_WITHDRAWN")
SOURCE_OF_SCHEME = {"LEI": "gleif", "SEC_CIK": "sec-edgar", "SEC_ACCESSION": "sec-edgar", "WIKIDATA_QID": "wikidata"}
DEFINITION_KEYS = ("record_type", "schema_id", "version", "media_type", "payload_kind", "compatible_with", "fields", "description", "source_schema", "definition_sha256")
DEFINITION_NEEDS = ("schema_id", "version", "media_type", "payload_kind", "fields")
FIELD_KEYS = ("type", "required", "format", "enum", "description")
FIELD_TYPES = ("string", "number", "integer", "boolean", "object", "array")
FIELD_FORMATS = ("iso-datetime", "sha256", "geojson-geometry")
PAYLOAD_KINDS = ("document", "rows", "geojson")


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def refreshed_hypotheses(links: DataFrame, claims: DataFrame) -> DataFrame:
    """hypothesis_id, status, independent, n_active, n_degraded, n_contradicting by the claims that stand now.

    links: hypothesis_id, claim_id, stance (SUPPORTING, CONTRADICTING); claims: claim_id, state, family. Claims of one
    family count once for independence; links to no claim and null families count for nothing. A hypothesis without any
    standing evidence is UNRESOLVED.
    """
    n = links.count()
    met = dealt(links.select("hypothesis_id", "claim_id", "stance"), n, "claim_id").distinct().join(claims, "claim_id", "left")
    supports, live = F.col("stance") == "SUPPORTING", F.col("state") == "CURRENT"
    counts = dealt(met, n, "hypothesis_id").groupBy("hypothesis_id").agg(
        F.count_distinct(F.when(supports & live, F.col("family"))).alias("independent"), F.count_distinct(F.when(supports & live, F.col("claim_id"))).alias("n_active"),
        F.count_distinct(F.when(supports & F.col("state").isin(*DEGRADED), F.col("claim_id"))).alias("n_degraded"), F.count_distinct(F.when(~supports & live, F.col("claim_id"))).alias("n_contradicting"),
    )
    status = (
        F.when((F.col("n_contradicting") > 0) & (F.col("n_active") > 0), "DISPUTED")
        .when(F.col("n_contradicting") >= 2, "REJECTED").when(F.col("n_contradicting") == 1, "DISPUTED")
        .when(F.col("independent") >= 2, "SUPPORTED").when(F.col("independent") == 1, "WEAKLY_SUPPORTED").otherwise("UNRESOLVED")
    )
    return counts.select("hypothesis_id", status.alias("status"), "independent", "n_active", "n_degraded", "n_contradicting")


def pivots(results: DataFrame) -> DataFrame:
    """response_id, from_ref, to_ref, pivot_type that the results of a response suggest, each once and without a cap.

    results: response_id, subject, native_id, kind (IDENTIFIER or ATTRIBUTE), name (scheme or key), value. Empty values and
    pivots of a thing to itself suggest nothing.
    """
    reference = F.concat("name", F.lit(":"), "value")
    source = F.try_element_at(F.create_map(*[F.lit(x) for pair in SOURCE_OF_SCHEME.items() for x in pair]), F.col("name"))
    host = F.lower(F.coalesce(F.try_parse_url("value", F.lit("HOST")), F.lit("")))
    edge = lambda a, b, kind: F.struct(a.alias("from_ref"), b.alias("to_ref"), F.lit(kind).alias("pivot_type"))
    is_id, subject, lei = F.col("kind") == "IDENTIFIER", F.col("subject"), lambda c: F.concat(F.lit("LEI:"), c)
    each = F.array(
        F.when(is_id, edge(subject, reference, "IDENTIFIER_OF")), F.when(is_id & source.isNotNull(), edge(reference, source, "LEADS_TO_SOURCE_FAMILY")),
        F.when(is_id & F.col("name").isin("OFFICIAL_WEBSITE", "URL"), edge(subject, host, "OPERATES_DOMAIN")),
        F.when(~is_id & (F.col("name") == "successor_lei"), edge(lei(F.col("native_id")), lei(F.col("value")), "SUCCESSOR_OF")),
        F.when(~is_id & F.col("name").rlike("^(alias|label):"), edge(subject, F.col("value"), "ALIAS_OF")),
    )
    made = results.filter("value <> ''").select("response_id", F.explode(F.array_compact(each)).alias("e")).select("response_id", "e.*")
    return made.filter("to_ref <> '' AND from_ref <> to_ref").distinct()


def degraded_paths(paths: DataFrame, claims: DataFrame, invalid: DataFrame) -> DataFrame:
    """kind, id, reason: paths that go STALE by an invalid assumption or a degraded claim, and objectives EXPOSED by them.

    paths: path_id, objective_id, status, basis_id (a row for each claim or assumption an edge rests on); claims:
    claim_id, state; invalid: assumption_id. Paths that are closed stay; an objective is named once.
    """
    open_ = paths.filter("status NOT IN ('INVALIDATED', 'RESOLVED')")
    weak = claims.filter(F.col("state").isin(*DEGRADED)).select(F.col("claim_id").alias("basis_id"), F.lit("EVIDENCE_DEGRADED").alias("reason"))
    bad = invalid.select(F.col("assumption_id").alias("basis_id"), F.lit("ASSUMPTION_INVALIDATED").alias("reason"))
    hit = open_.join(weak.union(bad).distinct(), "basis_id").groupBy("path_id", "objective_id").agg(F.min("reason").alias("reason"))
    stale = hit.groupBy(F.col("path_id").alias("id")).agg(F.min("reason").alias("reason")).select(F.lit("impact_path").alias("kind"), "id", "reason")
    exposed = hit.groupBy(F.col("objective_id").alias("id")).agg(F.min("reason").alias("reason")).select(F.lit("mission_objective").alias("kind"), "id", "reason")
    return stale.union(exposed)


def replay_verdicts(actions: DataFrame, keys: DataFrame, statuses: DataFrame) -> DataFrame:
    """action_id, verdict of recorded signed actions, judged anew: digest, key, signature, and the key's state at its time.

    actions: action_id, payload, payload_digest, key_id, time, signed (whether the signature verifies); keys: key_id;
    statuses: key_id, at, status. The last status at or before the action counts; of equal times the greater word. A missing
    payload or digest is a mismatch.
    """
    known = keys.select("key_id", F.lit(True).alias("_known")).distinct()
    held = actions.select("action_id", "key_id", "time").join(statuses.select("key_id", "at", F.col("status").alias("_status")), "key_id").filter("at <= time")
    state = held.groupBy("action_id").agg(F.max_by("_status", F.struct("at", "_status")).alias("_status"))
    met = actions.join(known, "key_id", "left").join(state, "action_id", "left")
    code = first_code(
        (F.col("payload").isNull() | ~F.sha2("payload", 256).eqNullSafe(F.col("payload_digest")), "DIGEST_MISMATCH"), (F.col("_known").isNull(), "KEY_UNKNOWN"), (~F.coalesce("signed", F.lit(False)), "SIGNATURE_INVALID"),
        (~F.col("_status").eqNullSafe("VALID"), "KEY_NOT_VALID_AT_TIME"),
    )
    return met.select("action_id", F.coalesce(code, F.lit("GENUINE")).alias("verdict"))


def definition_problems(body: str) -> Column:
    """What is wrong with a schema definition in JSON, as an array: unknown and missing keys, kinds, field keys, types and
    formats out of their lists; empty if it is sound. A text that is no JSON object has the one problem INVALID."""
    top = F.from_json(F.col(body), "map<string,string>")
    specs = F.coalesce(F.from_json(F.try_element_at(top, F.lit("fields")), "map<string,map<string,string>>"), F.create_map().cast("map<string,map<string,string>>"))
    keys, kind = F.map_keys(top), F.try_element_at(top, F.lit("payload_kind"))
    told = lambda values, what: F.transform(F.array_sort(values), lambda v: F.concat(F.lit(f"{what} "), v))
    fields = F.array_sort(F.map_keys(specs))
    spec = lambda name, key: F.try_element_at(F.try_element_at(specs, name), F.lit(key))
    of_fields = F.flatten(
        F.transform(
            fields,
            lambda n: F.array_compact(
                F.array(
                    F.when(F.size(F.array_except(F.map_keys(F.try_element_at(specs, n)), _texts(FIELD_KEYS))) > 0, F.concat(F.lit("keys of "), n)),
                    F.when(~F.coalesce(spec(n, "type").isin(*FIELD_TYPES), F.lit(False)), F.concat(F.lit("type of "), n)),
                    F.when(F.coalesce(~spec(n, "format").isin(*FIELD_FORMATS), F.lit(False)), F.concat(F.lit("format of "), n)),
                )
            ),
        )
    )
    bad_kind = F.when(F.coalesce(~kind.isin(*PAYLOAD_KINDS), F.lit(False)), F.array(F.lit("payload_kind"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(told(F.array_except(keys, _texts(DEFINITION_KEYS)), "unknown"), told(F.array_except(_texts(DEFINITION_NEEDS), keys), "missing"), bad_kind, of_fields)
    return F.when(feeds.strict_json(F.col(body)).isNotNull() | F.col(body).isNull(), F.array(F.lit("INVALID"))).otherwise(found)


def foreign_json(body: str) -> Column:
    """(value, repaired, problem) of foreign JSON: escapes of lone surrogates become the escape of U+FFFD and are
    told; what is still not one sound object keeps its problem and has no value. The value is JSON text and keeps its other
    escapes; escaped backslashes are no escapes. Null is INVALID, its repaired null."""
    text = F.col(body)
    lone = feeds.without_lone_surrogates(text)
    problem = feeds.strict_json(lone)
    return F.struct(F.when(problem.isNull(), lone).alias("value"), (lone != text).alias("repaired"), problem.alias("problem"))
