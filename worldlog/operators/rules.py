"""Rules over what a reader sees: conflicts, disruptions, hazards, exposed routes, stale stock, dependent reports; findings of reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.functions import scalar
from worldlog.operators import evidence, near
from worldlog.operators.graph import saved

# Fixed values.
DISRUPTED = ("DAMAGED", "BLOCKED", "OBSTRUCTED", "DESTROYED", "DEGRADED", "OUT_OF_SERVICE")
HAZARD_METRES, PROXIMITY_METRES = 30_000.0, 500.0
#: Why a route is exposed; where several hold for one disruption, the last one is told.
CONDITIONS = ("AFFECTS_RELATIONSHIP", "DEPENDENCY_DISPUTED", "DEPENDENCY_DISRUPTED", "DEPENDENCY_REPORTED_DISRUPTED", "PROXIMATE_DISRUPTION")
OBSERVATIONAL = ("semantic_claim", "semantic_observation", "fabric_manifestation")
INFERENTIAL = ("INFERRED", "PREDICTED", "PLANNED")
QUOTED = r"(?<![\d.])(0?\.\d+)(?![\d%])|(\d{1,3})\s*%"
NOT_BLOCKING = ("PARTIALLY_HISTORICAL_BASIS", "MULTI_FORECAST_NUMERIC_AMBIGUITY")


def near_geometries(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """id, target_id, metres of points (id, lon, lat) within ``metres`` of targets (object_id, lon, lat, or line: array of places).

    A point stands in one cell of the globe and a target, with its geometry, once in every cell that it reaches: a pair meets once,
    and only pairs that the exact distance leaves come out of the join. Of ids with several rows, on either side, the nearest count.
    """
    cells = evidence.reached_cells(near.along(targets, metres), metres / 2).distinct()
    middle, degree = F.expr("line[size(line) div 2]"), scalar.EARTH_RADIUS_M * math.pi / 180
    away = F.expr("array_max(transform(line, p -> sqrt(pow(p[0] - line[size(line) div 2][0], 2) + pow(p[1] - line[size(line) div 2][1], 2))))") * degree
    shape = targets.select(F.col("object_id").alias("target_id"), "line", F.coalesce("lon", middle[0]).alias("_lon"), F.coalesce("lat", middle[1]).alias("_lat"), away.alias("_away"))
    placed = cells.join(shape, cells.id == shape.target_id).drop("id")
    standing = points.select("id", "lon", "lat", *evidence.own_cell(F.col("lon"), F.col("lat"), metres / 2))
    on_line, to_line = F.col("line").isNotNull(), scalar.point_to_line_m(F.col("lon"), F.col("lat"), F.col("line"))
    to_point = scalar.haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    # on the point's flat map the way to a line is at most that to its middle corner, and shorter by the line's reach at most
    flat = F.hypot((F.col("_lon") - F.col("lon")) * F.cos(F.radians("lat")) * degree, (F.col("_lat") - F.col("lat")) * degree)
    line_near = F.when(flat < metres - 0.01, True).when(flat - F.col("_away") > metres + 0.01, False).otherwise(to_line <= metres)
    within = F.when(on_line, line_near).otherwise(to_point <= metres)
    distance = F.when(on_line, to_line).otherwise(to_point).alias("metres")
    # merged: what is thin as a table makes many pairs, which one task would make alone after a broadcast
    met = lambda some, places: some.hint("merge").join(places, ["_row", "_cell"]).filter(within).select("id", "target_id", distance)
    often = lambda df, key: df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    points_often, shapes_often = often(points, "id"), often(shape, "target_id")
    once = standing.join(points_often, "id", "left_anti")
    several = met(standing.join(points_often, "id", "left_semi"), placed).union(met(once, placed.join(shapes_often, "target_id", "left_semi")))
    return met(once, placed.join(shapes_often, "target_id", "left_anti")).union(several.groupBy("id", "target_id").agg(F.min("metres").alias("metres")))


def _of(relations: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    return relations.filter(F.col("relation_type") == kind).select(F.col("source_id").alias(source), F.col("target_id").alias(target)).distinct()


def _active(objects: DataFrame) -> DataFrame:
    """Places of disruptions: active concerns, and what reports a disrupted status."""
    active = objects.filter((F.col("object_type") == "OPERATIONAL_CONCERN") & (F.col("lifecycle") == "ACTIVE") | F.col("reported_status").isin(*DISRUPTED))
    return active.filter("line IS NULL AND lon IS NOT NULL").select(F.col("object_id").alias("id"), "lon", "lat")


def _listed(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """route_id, disruption_id, _rank of what relations say that routes are exposed to."""
    said = objects.select(F.col("object_id").alias("_id"), "epistemic_state", "status", "reported_status")
    found = lambda df, disruption, condition: df.select("route_id", disruption.alias("disruption_id"), F.lit(CONDITIONS.index(condition)).alias("_rank"))
    affects = _of(relations, "AFFECTS", "disruption", "route_id")
    depends = _of(relations, "DEPENDS_ON", "route_id", "infra").join(said, F.col("infra") == F.col("_id"))
    reports = _of(relations, "REPORTS_ON", "report", "infra").join(said, F.col("report") == F.col("_id")).filter(F.col("reported_status").isin(*DISRUPTED)).select("report", "infra")
    parts = [
        found(affects, F.col("disruption"), "AFFECTS_RELATIONSHIP"),
        found(depends.filter("epistemic_state = 'DISPUTED'"), F.col("infra"), "DEPENDENCY_DISPUTED"),
        found(depends.filter(F.col("status").isin(*DISRUPTED)), F.col("infra"), "DEPENDENCY_DISRUPTED"),
        found(depends.select("route_id", "infra").join(reports, "infra"), F.col("report"), "DEPENDENCY_REPORTED_DISRUPTED"),
    ]
    return reduce(DataFrame.union, parts).join(objects.filter("object_type = 'ROUTE'").select(F.col("object_id").alias("route_id")), "route_id", "left_semi")


def exposure(objects: DataFrame, relations: DataFrame, metres: float = PROXIMITY_METRES) -> DataFrame:
    """route_id, disruption_id, condition: what each route is exposed to, each disruption once; see ``proposals`` for the tables."""
    routes = objects.filter("object_type = 'ROUTE' AND line IS NOT NULL")
    close = near.pairs(_active(objects), routes, metres).select(F.col("target_id").alias("route_id"), F.col("id").alias("disruption_id"), F.lit(CONDITIONS.index("PROXIMATE_DISRUPTION")).alias("_rank"))
    each = _listed(objects, relations).union(close).groupBy("route_id", "disruption_id").agg(F.max("_rank").alias("_rank"))
    return each.select("route_id", "disruption_id", F.get(F.array(*map(F.lit, CONDITIONS)), F.col("_rank")).alias("condition"))


def exposure_counts(objects: DataFrame, relations: DataFrame, metres: float = PROXIMITY_METRES) -> DataFrame:
    """route_id, n: how many disruptions ``exposure`` has for a route; none is no row. What is near is counted, not written pair by pair."""
    routes, active = objects.filter("object_type = 'ROUTE' AND line IS NOT NULL"), _active(objects)
    close = near.counts(active, routes, metres, by="target_id").select(F.col("target_id").alias("route_id"), "n")
    # of what relations list, what is near as well counts once
    listed = saved(_listed(objects, relations).select("route_id", "disruption_id").distinct(), "listed")
    shape = routes.select(F.col("object_id").alias("route_id"), "line")
    both = listed.join(active, listed.disruption_id == active.id).join(shape, "route_id").filter(scalar.point_to_line_m(F.col("lon"), F.col("lat"), F.col("line")) <= metres).select("route_id", "disruption_id").distinct()
    other = listed.join(both, ["route_id", "disruption_id"], "left_anti").groupBy("route_id").agg(F.count("*").alias("n"))
    return close.union(other).groupBy("route_id").agg(F.sum("n").alias("n"))


def proposals(objects: DataFrame, relations: DataFrame, groups: DataFrame, hazard_metres: float = HAZARD_METRES, route_metres: float = PROXIMITY_METRES, exposed: DataFrame | None = None, pairs: bool = True) -> DataFrame:
    """rule, kind, subject, other, n of everything that six rules propose over what is visible.

    ``objects``: object_id, object_type, lifecycle, epistemic_state, status, reported_status, stale, and a geometry: lon and lat,
    or line (array of places), or neither. ``relations``: relation_type, source_id, target_id of ACTIVE ones between visible
    objects. ``groups``: group_id, object_id of reports on one basis. Conflicts are told by target with the number of reports in
    place of all pairs; ``other`` names the status, hazard or route that a proposal is about, ``n`` how many findings it rests on.
    ``exposed``: the ``exposure_counts`` at ``route_metres`` where they are known already; ``pairs``: whether each hazard is told with each
    thing that it threatens (RELATIONSHIP), or these are counted alone and never written.
    """
    told = objects.select(F.col("object_id").alias("_o"), "object_type", "reported_status")
    reports = _of(relations, "REPORTS_ON", "report", "target").join(told, F.col("report") == F.col("_o")).select("report", "target", F.col("reported_status").alias("said"))
    row = lambda df, rule, kind, subject, other, n: df.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), other.cast("string").alias("other"), n.cast("long").alias("n"))
    clear = reports.filter("said IS NOT NULL AND said <> 'UNKNOWN'")
    conflicts = evidence.conflicting_reports(clear.select("target", F.col("said").alias("status"), F.col("report").alias("report_id")))
    stated = reports.filter(F.col("said").isin(*DISRUPTED)).join(told.filter(F.col("object_type").isin("INFRASTRUCTURE", "ROUTE")).select("_o"), F.col("target") == F.col("_o"))
    disruptions = stated.groupBy("target", "said").agg(F.count("*").alias("n"))
    hazards = objects.filter("object_type = 'OPERATIONAL_CONCERN' AND lifecycle = 'ACTIVE'")
    spots = hazards.filter("line IS NULL AND lon IS NOT NULL").select(F.col("object_id").alias("id"), "lon", "lat").union(
        hazards.filter("line IS NOT NULL").select("object_id", F.explode("line").alias("p")).select("object_id", F.col("p")[0], F.col("p")[1])
    )
    threatened = objects.filter(F.col("object_type").isin("ROUTE", "INFRASTRUCTURE"))
    exposed = saved(exposure_counts(objects, relations, route_metres), "exposure") if exposed is None else exposed
    counts = objects.filter("object_type = 'ROUTE'").select(F.col("object_id").alias("route_id")).join(exposed, "route_id", "left").fillna(0, ["n"])
    planned = _of(relations, "PLANNED_FOR", "movement", "route_id").join(counts.filter("n > 0"), "route_id")
    ways = _of(relations, "ALTERNATE_OF", "route_id", "way")
    ways = ways.union(ways.select("way", "route_id")).join(counts.filter("n = 0").select(F.col("route_id").alias("way")), "way").groupBy("route_id").agg(F.min("way").alias("way"))
    dependent = groups.join(objects.select("object_id"), "object_id", "left_semi").distinct().groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1")
    return reduce(
        DataFrame.union,
        [
            row(conflicts, "infrastructure-conflict", "ALERT", F.col("target"), F.col("statuses"), F.col("n_reports")),
            row(conflicts, "infrastructure-conflict", "STATE", F.col("target"), F.lit("DISPUTED"), F.col("n_reports")),
            row(disruptions, "reported-disruption", "ALERT", F.col("target"), F.col("said"), F.col("n")),
            row(near.counts(spots, threatened, hazard_metres), "hazard-impact", "ALERT", F.col("id"), F.lit(None), F.col("n")),
            *([row(near.pairs(spots, threatened, hazard_metres), "hazard-impact", "RELATIONSHIP", F.col("id"), F.col("target_id"), F.lit(1))] if pairs else []),
            row(counts.filter("n > 0"), "route-exposure", "ASSESSMENT", F.col("route_id"), F.lit(None), F.col("n")),
            row(planned, "movement-route-risk", "ALERT", F.col("movement"), F.col("route_id"), F.col("n")),
            row(planned.join(ways, "route_id"), "movement-route-risk", "RECOMMENDATION", F.col("movement"), F.col("way"), F.col("n")),
            row(objects.filter("object_type = 'RESOURCE_STOCK' AND stale"), "stale-stock", "ALERT", F.col("object_id"), F.lit(None), F.lit(1)),
            row(dependent, "source-dependence", "ALERT", F.col("group_id"), F.lit(None), F.col("n")),
        ],
    )


def quoted_probabilities(text: Column) -> Column:
    """Numbers that a sentence quotes as probabilities: ``.42``, ``0.42``, ``42 %``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), lambda m: F.trim(m))
    return F.transform(found, lambda m: F.when(m.endswith("%"), F.regexp_replace(m, r"\s*%$", "").cast("double") / 100).otherwise(m.cast("double")))


def report_findings(sentences: DataFrame, records: DataFrame, states: DataFrame, reviews: DataFrame, forecasts: DataFrame, snapshot: Column) -> DataFrame:
    """sentence_id, code, ref, blocking: what is wrong with the sentences of reports, in eleven codes, for one reader.

    ``sentences``: sentence_id, text, status, temporal_scope, asserts_independent, basis_refs. ``records``, those that the reader
    sees: kind, ref, epistemic_state, valid_to, independent_basis_count (of claims). ``states``: claim_id, state (the latest);
    ``reviews``: subject_id of open ones; ``forecasts``: forecast_id, probability of every authored version. Findings on a
    reference name it; a reference that is given twice is found once. A factual sentence without a basis has that finding alone.
    """
    factual = F.col("status") == "SUPPORTED"
    bare = sentences.filter(factual & (F.coalesce(F.size("basis_refs"), F.lit(0)) == 0)).select("sentence_id", F.lit("NO_EVIDENCE_BASIS").alias("code"), F.lit(None).cast("string").alias("ref"))
    cited = sentences.select("sentence_id", "status", "temporal_scope", "asserts_independent", F.explode(F.array_distinct("basis_refs")).alias("ref"))
    last = states.select(F.col("claim_id").alias("ref"), F.col("state").alias("_state"))
    under = reviews.select(F.col("subject_id").alias("ref"), F.lit(True).alias("_open")).distinct()
    met = saved(cited.join(records.withColumn("_known", F.lit(True)), "ref", "left").join(last, "ref", "left").join(under, "ref", "left"), "cited")
    claim = F.col("kind") == "semantic_claim"
    ended = claim & (F.col("valid_to") <= snapshot)
    yes = lambda c: F.coalesce(c, F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), "UNRESOLVABLE_BASIS"),
            F.when(factual & F.col("_known") & (~F.col("kind").isin(*OBSERVATIONAL) | yes(claim & F.col("epistemic_state").isin(*INFERENTIAL))), "INFERENCE_AS_OBSERVATION"),
            F.when(factual & yes(claim & F.col("_state").isin("RETRACTED", "SUPERSEDED", "CORRECTED")), "STALE_BASIS"),
            F.when(factual & yes(claim) & (yes(F.col("epistemic_state") == "DISPUTED") | yes(F.col("_open"))), "CONTESTED_AS_SETTLED"),
        )
    )
    by_ref = met.select("sentence_id", F.explode(codes).alias("code"), "ref")
    whole = met.filter(factual & claim).groupBy("sentence_id", "temporal_scope").agg(F.count("*").alias("n"), F.count_if(yes(ended)).alias("ended"))
    scope = F.coalesce("temporal_scope", F.lit(""))
    dated = F.when(F.col("ended") == F.col("n"), "HISTORICAL_AS_CURRENT").when((F.col("ended") > 0) & (scope == ""), "TEMPORAL_SCOPE_REQUIRED").when(F.col("ended") > 0, "PARTIALLY_HISTORICAL_BASIS")
    dated = whole.filter(scope != "HISTORICAL").select("sentence_id", dated.alias("code")).filter("code IS NOT NULL")
    best = met.groupBy("sentence_id").agg(F.max(F.when(claim, F.col("independent_basis_count"))).alias("best"), F.bool_or("asserts_independent").alias("says"), F.first("status").alias("status"))
    alone = best.filter(factual & F.col("says") & (F.coalesce("best", F.lit(0)) < 2)).select("sentence_id", F.lit("INDEPENDENCE_MISREPRESENTED").alias("code"))
    of_forecasts = met.filter("kind = 'analytic_forecast'").select("sentence_id", F.col("ref").alias("forecast_id"))
    several = of_forecasts.groupBy("sentence_id").agg(F.count("*").alias("n")).filter("n > 1").select("sentence_id", F.lit("MULTI_FORECAST_NUMERIC_AMBIGUITY").alias("code"))
    quotes = sentences.select("sentence_id", F.explode(F.array_distinct(quoted_probabilities(F.col("text")))).alias("q")).join(of_forecasts.select("sentence_id").distinct(), "sentence_id", "left_semi")
    authored = of_forecasts.join(forecasts, "forecast_id").select("sentence_id", "probability").distinct()
    fits = quotes.join(authored, "sentence_id").filter(F.abs(F.col("q") - F.col("probability")) < 0.005).select("sentence_id", "q")
    odd = quotes.join(fits, ["sentence_id", "q"], "left_anti").select("sentence_id", F.lit("FORECAST_PROBABILITY_MISMATCH").alias("code")).distinct()
    by_sentence = reduce(DataFrame.union, [dated, alone, several, odd]).withColumn("ref", F.lit(None).cast("string"))
    found = bare.union(by_ref).union(by_sentence)
    return found.withColumn("blocking", ~F.col("code").isin(*NOT_BLOCKING))
