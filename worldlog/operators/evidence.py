"""Evidence: what claims rest on, how independent it is, coverage of needs, calibration of forecasts, association."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldlog.functions import scalar


def standing(claims: DataFrame, states: DataFrame, default: str = "CURRENT") -> DataFrame:
    """Claims with their latest state; ``default`` without one."""
    last = states.groupBy("claim_id").agg(F.max_by("state", "seq").alias("state"))
    return claims.join(last, "claim_id", "left").withColumn("state", F.coalesce("state", F.lit(default)))


def basis(links: DataFrame, key: str) -> DataFrame:
    """What each object rests on: counts of observations, sources and languages, degraded ones, and the time span.

    Distinct counts of several columns expand rows before the shuffle; partial sums keep it to a row a group and value.
    """
    return links.groupBy(key).agg(
        F.count_distinct("observation_id").alias("n_observations"),
        F.count_distinct("source_id").alias("n_sources"),
        F.count_distinct("lang").alias("n_languages"),
        F.count_if("degraded").alias("n_degraded"),
        F.min("state_time").alias("first_time"),
        F.max("state_time").alias("last_time"),
    )


def coverage(sources: DataFrame, executions: DataFrame) -> DataFrame:
    """source_id, state: how well each source was searched, by the set of outcomes of its executions."""
    said = lambda *names: F.coalesce(F.bool_or(F.col("outcome").isin(*names)), F.lit(False))
    flags = executions.groupBy("source_id").agg(
        said("EXECUTED_WITH_RESULTS", "EXECUTED_EMPTY").alias("executed"),
        said("ACCESS_RESTRICTED", "POLICY_REFUSED").alias("refused"),
        said("SOURCE_FAILED").alias("failed"),
    )
    state = (
        F.when(F.col("executed").isNull(), F.when(F.col("has_profile"), "NOT_SEARCHED").otherwise("UNKNOWN"))
        .when(F.expr("executed AND NOT failed AND NOT refused"), "COVERED")
        .when(F.col("executed"), "PARTIALLY_COVERED")
        .when(F.expr("refused AND NOT failed"), "ACCESS_RESTRICTED")
        .when(F.col("failed"), "SOURCE_FAILED")
        .otherwise("UNKNOWN")
    )
    return sources.join(flags, "source_id", "left").withColumn("state", state).drop("executed", "refused", "failed")


def scored(forecasts: DataFrame) -> DataFrame:
    """Forecasts with their Brier and log scores and the band of their horizon."""
    return forecasts.withColumns(
        {
            "brier": scalar.brier(F.col("probability"), F.col("outcome")),
            "log_score": scalar.log_score(F.col("probability"), F.col("outcome")),
            "band": scalar.horizon_band(F.col("days")),
        }
    )


def scoreboard(forecasts: DataFrame, *groups: str) -> DataFrame:
    """Means and base rate over all, and by each of ``groups``, in one pass over grouping sets."""
    sets = [[], *[[g] for g in groups]]
    rows = scored(forecasts).groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, groups))
    name = reduce(lambda col, g: col.when(F.grouping(g) == 0, g), groups[1:], F.when(F.grouping(groups[0]) == 0, groups[0])).otherwise("all")
    return rows.agg(
        name.alias("grouping"),
        F.coalesce(*[F.col(g).cast("string") for g in groups], F.lit("")).alias("value"),
        F.count("*").alias("n"),
        F.avg("brier").alias("brier_mean"),
        F.avg("log_score").alias("log_score_mean"),
        F.avg(F.col("outcome").cast("double")).alias("base_rate"),
    ).drop(*groups)


def reliability(forecasts: DataFrame, buckets: int = 10) -> DataFrame:
    """bucket, n, mean_probability, observed_rate of every bucket; empty ones stay."""
    bucket = F.least((F.col("probability") * buckets).cast("int"), F.lit(buckets - 1))
    met = forecasts.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"),
        F.avg("probability").alias("mean_probability"),
        F.avg(F.col("outcome").cast("double")).alias("observed_rate"),
    )
    every = forecasts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(met, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def calibration_error(forecasts: DataFrame, buckets: int = 10) -> DataFrame:
    """One row: n and the expected calibration error; null without forecasts."""
    gap = F.abs(F.col("mean_probability") - F.col("observed_rate")) * F.col("n")
    return reliability(forecasts, buckets).agg(F.sum("n").alias("n"), (F.sum(gap) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def standing_probability(versions: DataFrame, horizons: DataFrame) -> DataFrame:
    """object_id, probability: the last number at or before the horizon, else the first one."""
    met = versions.join(horizons, "object_id")
    early = F.when(F.col("valid_from") <= F.col("horizon"), F.col("version"))
    return met.groupBy("object_id").agg(
        F.coalesce(F.max_by(F.when(early.isNotNull(), F.col("probability")), early), F.min_by("probability", "version")).alias("probability")
    )


def within_distance(points: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """id, place_id, metres of all pairs within ``metres``: an equi-join on cells of the globe, then the exact distance.

    Cells are as high as the distance; as meridians close in, a point looks at all cells that the distance can reach at
    its latitude. Only pairs of neighbouring cells meet, never all.
    """
    height = metres / 111_000.0
    rows = lambda lat: F.floor((lat + 90) / height)
    width = F.greatest(F.lit(height), F.least(F.lit(360.0), height / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + height, F.lit(89.99)))), F.lit(1e-9))))
    columns = F.lit(max(1, int(360 / height)))
    cell = F.floor((F.col("lon") + 180) / 360 * columns)
    held = places.select(F.col("id").alias("place_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), rows(F.col("lat")).alias("_row"), (cell % columns).alias("_cell"))
    reach = F.least(F.ceil(width / 360 * columns), F.ceil(columns / 2)).cast("long")
    looked = points.select(
        "id", "lon", "lat", F.explode(F.sequence(rows(F.col("lat")) - 1, rows(F.col("lat")) + 1)).alias("_row"), cell.alias("_at"), reach.alias("_reach")
    ).select("id", "lon", "lat", "_row", F.explode(F.array_distinct(F.transform(F.sequence(F.col("_at") - F.col("_reach"), F.col("_at") + F.col("_reach")), lambda c: F.pmod(c, columns)))).alias("_cell"))
    distance = scalar.haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    return looked.join(held, ["_row", "_cell"]).select("id", "place_id", distance.alias("metres")).filter(F.col("metres") <= metres)


def own_cell(lon: Column, lat: Column, metres: float) -> list[Column]:
    """_row, _cell: the one cell of the globe, as high as ``metres``, in which a place stands."""
    height = metres / 111_000.0
    columns = F.lit(max(1, int(360 / height)))
    return [F.floor((lat + 90) / height).alias("_row"), (F.floor((lon + 180) / 360 * columns) % columns).alias("_cell")]


def reached_cells(places: DataFrame, metres: float) -> DataFrame:
    """id, _row, _cell of all cells of ``own_cell`` with anything within ``reach`` metres of places (id, lon, lat, reach)."""
    height = metres / 111_000.0
    columns = F.lit(max(1, int(360 / height)))
    far = F.col("reach") / 111_000.0
    width = F.greatest(far, F.least(F.lit(360.0), far / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + far, F.lit(89.99)))), F.lit(1e-9))))
    up = F.ceil(far / height)
    row, cell = F.floor((F.col("lat") + 90) / height), F.floor((F.col("lon") + 180) / 360 * columns)
    side = F.least(F.ceil(width / 360 * columns), F.ceil(columns / 2)).cast("long")
    rows = places.select("id", cell.alias("_at"), side.alias("_side"), F.explode(F.sequence(row - up, row + up)).alias("_row"))
    return rows.select("id", "_row", F.explode(F.array_distinct(F.transform(F.sequence(F.col("_at") - F.col("_side"), F.col("_at") + F.col("_side")), lambda c: F.pmod(c, columns)))).alias("_cell"))


def conflicting_reports(reports: DataFrame) -> DataFrame:
    """target, statuses, n_reports of targets that reports tell differently: groups, not all pairs within them."""
    told = reports.groupBy("target", "status").agg(F.count("*").alias("n"), F.min("report_id").alias("first"))
    return told.groupBy("target").agg(
        F.array_join(F.array_sort(F.collect_list("status")), ",").alias("statuses"), F.sum("n").alias("n_reports"), F.min("first").alias("first_report")
    ).filter(F.contains("statuses", F.lit(",")))


def shared_identifiers(refs: DataFrame) -> DataFrame:
    """object_id, head, system: each object that shares an identifier with another, linked to the least one that has it.

    A star for each identifier in place of all pairs: as many rows as members, and the same components.
    """
    heads = refs.groupBy("system", "external_id").agg(F.min("object_id").alias("head"), F.max("object_id").alias("_most")).filter("head < _most")
    return refs.join(heads, ["system", "external_id"]).filter("object_id > head").select("object_id", "head", "system").distinct()


def association_features(pairs: DataFrame) -> DataFrame:
    """Features of pairs (columns ``l_`` and ``r_``: type, ref, time, lon, lat, source, status) and the outcome."""
    gap = F.abs(scalar.hours_between(F.col("l_time"), F.col("r_time")))
    distance = scalar.haversine_m(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat"))
    features = pairs.withColumns(
        {
            "identifier": F.when(F.col("l_ref") == F.col("r_ref"), "SYSTEM_MATCH").when(F.col("l_ref").isNotNull() & F.col("r_ref").isNotNull(), "CONFLICT").otherwise("ABSENT"),
            "type": F.when(F.col("l_type").eqNullSafe(F.col("r_type")), "MATCH").otherwise("MISMATCH"),
            "temporal": F.when(gap.isNull(), "UNKNOWN").when(gap <= 12, "COMPATIBLE").otherwise("INCOMPATIBLE"),
            "geospatial": F.when(gap.isNull() | distance.isNull(), "UNKNOWN").when(distance <= 80_000 * F.greatest(gap, F.lit(0.25)), "COMPATIBLE").otherwise("IMPLAUSIBLE_SPEED"),
            "contradiction": scalar.contradicts(F.col("l_status"), F.col("r_status")),
        }
    )
    return features.withColumn("outcome", decide())


def decide() -> Column:
    """The first rule that holds, by the features."""
    return (
        F.when(F.col("type") == "MISMATCH", "REJECT_ASSOCIATION")
        .when(F.col("identifier") == "CONFLICT", "REJECT_ASSOCIATION")
        .when(F.expr("geospatial = 'IMPLAUSIBLE_SPEED' AND identifier <> 'SYSTEM_MATCH'"), "REJECT_ASSOCIATION")
        .when(F.col("contradiction"), "UNKNOWN")
        .when(F.expr("identifier = 'SYSTEM_MATCH' AND temporal <> 'INCOMPATIBLE'"), "AUTO_ASSOCIATE")
        .when(F.expr("identifier = 'ATTRIBUTE_MATCH' OR (temporal = 'COMPATIBLE' AND geospatial = 'COMPATIBLE')"), "PROPOSE_ASSOCIATION")
        .otherwise("UNKNOWN")
    )


# Attributes that change by themselves, and the endings of those that name a thing.
VOLATILE = ("position_note", "observed_at", "reported_speed_kmh")
IDENTIFIER_ENDINGS = r"(_id|_ref|_callsign)$"


def pair_features(pairs: DataFrame) -> DataFrame:
    """All ten features of pairs and the outcome; pairs that negative evidence parts are rejected.

    Columns ``l_`` and ``r_``: type, refs (array of system, external_id), attributes (map of texts), time, lon, lat,
    sources (array), confidence (null if it was not assessed); and ``negative`` (array). Nulls are unknown, never unlike.
    """
    gap = F.abs(scalar.hours_between(F.col("l_time"), F.col("r_time")))
    distance = F.round(scalar.haversine_m(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat")), 1)
    systems = lambda c: F.transform(c, lambda r: r["system"])
    names = lambda c: F.map_filter(c, lambda k, v: k.rlike(IDENTIFIER_ENDINGS) & v.isNotNull() & ~v.isin("", "UNKNOWN"))
    left, right = names("l_attributes"), names("r_attributes")
    shared = F.array_intersect(F.map_keys(left), F.map_keys(right))
    identifier = (
        F.when(F.arrays_overlap("l_refs", "r_refs"), "SYSTEM_MATCH")
        .when(F.arrays_overlap(systems("l_refs"), systems("r_refs")), "CONFLICT")
        .when(F.size(shared) == 0, "ABSENT")
        .when(F.forall(shared, lambda k: F.try_element_at(left, k) == F.try_element_at(right, k)), "ATTRIBUTE_MATCH")
        .otherwise("CONFLICT")
    )
    plain = F.filter(F.array_intersect(F.map_keys("l_attributes"), F.map_keys("r_attributes")), lambda k: ~k.isin(*VOLATILE) & ~k.rlike(IDENTIFIER_ENDINGS))
    unlike = F.array_sort(F.filter(plain, lambda k: scalar.contradicts(F.try_element_at(F.col("l_attributes"), k), F.try_element_at(F.col("r_attributes"), k))))
    features = pairs.withColumns(
        {
            "identifier": identifier,
            "type": F.when(F.col("l_type").eqNullSafe(F.col("r_type")), "MATCH").otherwise("MISMATCH"),
            "gap_hours": gap,
            "temporal": F.when(gap.isNull(), "UNKNOWN").when(gap <= 12, "COMPATIBLE").otherwise("INCOMPATIBLE"),
            "distance_m": distance,
            "geospatial": F.when(gap.isNull() | distance.isNull(), "UNKNOWN").when(distance <= 80_000 * F.greatest(gap, F.lit(0.25)), "COMPATIBLE").otherwise("IMPLAUSIBLE_SPEED"),
            "sources": F.when((F.size("l_sources") == 0) | (F.size("r_sources") == 0), "UNKNOWN").when(F.arrays_overlap("l_sources", "r_sources"), "SAME_SOURCE").otherwise("DIFFERENT_SOURCES"),
            "contradictions": unlike,
            "contradiction": F.size(unlike) > 0,
            "confidence": F.when(F.col("l_confidence").isNotNull() & F.col("r_confidence").isNotNull(), F.least("l_confidence", "r_confidence")),
        }
    )
    parted = (F.size("negative") > 0) & (F.col("type") == "MATCH")
    return features.withColumn("outcome", F.when(parted, "REJECT_ASSOCIATION").otherwise(decide()))


def observation_changes(prior: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change_class of what differs between two sets of observations (kind, value); corrections by ``corrects``."""
    was, now = prior.select(*keys, F.col("kind").alias("_k0"), F.col("value").alias("_v0")), current.select(*keys, F.col("kind").alias("_k1"), F.col("value").alias("_v1"), "corrects")
    both = was.join(now, keys, "full_outer")
    added = F.when(F.col("_k1") == "RELATION", "RELATION_ADDED").when(F.col("_k1").isin("EVENT", "PUBLICATION"), "EVENT_ADDED").when(F.col("corrects"), "SOURCE_CORRECTION").otherwise("NEW_PROPOSITION")
    gone = F.when(F.col("_k0") == "RELATION", "RELATION_REMOVED").otherwise("REMOVED_PROPOSITION")
    changed = (
        F.when(F.col("corrects"), "SOURCE_CORRECTION")
        .when(F.col("_k1").isin("ENTITY_ATTRIBUTE", "ENTITY_NAME", "ENTITY_IDENTIFIER"), "ENTITY_ATTRIBUTE_CHANGED")
        .when(F.col("_k1") == "ROLE_SIGNAL", "ROLE_CHANGED")
        .when(F.col("_k1").isin("EVENT", "PUBLICATION"), "EVENT_UPDATED")
        .otherwise("VALUE_CHANGED")
    )
    kind = F.when(F.col("_k0").isNull(), added).when(F.col("_k1").isNull(), gone).when(F.col("_v0") != F.col("_v1"), changed)
    return both.select(*keys, kind.alias("change_class")).filter("change_class IS NOT NULL")


def propagation(rows: DataFrame) -> DataFrame:
    """Narrative spread: each manifestation of a statement with the earliest one, its relation and its place in time.

    statement, doc_id, origin, relation: SAME_FAMILY where the sources are one, else DERIVATIVE. A star around the
    earliest in place of all ordered pairs.
    """
    first = rows.groupBy("statement").agg(F.min_by(F.struct("doc_id", "source"), F.struct("at", "doc_id")).alias("_o"), F.count("*").alias("_n")).filter("_n > 1")
    met = rows.join(first, "statement").filter("doc_id <> _o.doc_id")
    relation = F.when(F.col("source") == F.col("_o.source"), "SAME_FAMILY").otherwise("DERIVATIVE")
    return met.select("statement", "doc_id", F.col("_o.doc_id").alias("origin"), relation.alias("relation"))


def ranked(rows: DataFrame, group: str, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
