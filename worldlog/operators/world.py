"""The world model: claims that advance with evidence, changes carried onto claims and analyses, identity, alerts, themes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldlog.operators.blocks import previous
from worldlog.operators.graph import saved
from worldlog.functions import scalar
from worldlog.operators.views import first_code

# The state and the review kind that a class of change asks for, states that people alone may leave and
# those that count as degraded, classes that question an assumption, and how a resolution closes a link.
STATE_OF_CHANGE = {"SOURCE_CORRECTION": "CORRECTED", "SOURCE_RETRACTION": "RETRACTED", "ENTITY_ATTRIBUTE_CHANGED": "SUPERSEDED", "VALUE_CHANGED": "STALE", "ROLE_CHANGED": "STALE", "REMOVED_PROPOSITION": "", "RELATION_REMOVED": ""}
REVIEW_OF_CHANGE = {"SOURCE_CORRECTION": "SOURCE_CORRECTED", "SOURCE_RETRACTION": "SOURCE_RETRACTED"}
MACHINE_STATES = ("CURRENT", "STALE", "SUPERSEDED")
INERT = ("SEMANTICALLY_UNCHANGED",)
QUESTIONING = ("SOURCE_RETRACTION", "SOURCE_CORRECTION", "VALUE_CHANGED", "ENTITY_ATTRIBUTE_CHANGED")
CLOSES_AS = {"REJECTED": "REJECTED", "SPLIT": "REJECTED", "REVERSED": "RETIRED"}
CLOSED_THEMES = ("MERGED", "SPLIT", "RESOLVED")
OPEN_FORECASTS = ("OPEN", "UPDATE_REQUIRED", "HORIZON_PASSED")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def advanced_claims(observations: DataFrame) -> DataFrame:
    """claim_id, at, outcome, version, value, families of every observation on a claim, in the order of ``at``.

    observations: claim_id, at (long), value, family (null if not known), state_time (timestamp, null if not known). The
    first records the claim. The same value adds its basis, unless its family is there already. Another value replaces it
    if its state is newer and its family is the claim's own; if newer but of another family it is a CONFLICT; if not
    newer, or of unknown time, it is kept as evidence alone (NOT_NEWER). Rows without a claim have no result; of equal
    ``at`` within a claim, the lesser value goes first.

    Each step needs the one before, so a claim is folded in one task; rows stream through it sorted, and all it holds is
    the families of the present value.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim, held, families, newest, version = None, None, [], None, 0
        for batch in batches:
            rows = []
            for c, at, value, family, time in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                later = time is not None and newest is not None and time > newest
                if c != claim:
                    claim, held, families, newest, version, outcome = c, value, [family] if family else [], time, 1, "RECORDED"
                elif value == held and family and family in families:
                    outcome = "NO_NEW_BASIS"
                elif value == held:
                    families = families + [family] if family else families
                    newest = max((t for t in (newest, time) if t is not None), default=None)
                    version, outcome = version + 1, "BASIS_ADDED"
                elif not later:
                    outcome = "NOT_NEWER"
                elif family and family not in families:
                    outcome = "CONFLICT"
                else:
                    held, families, newest, version, outcome = value, [family] if family else [], time, version + 1, "REPLACED"
                rows.append((c, at, outcome, version, held, sorted(families)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)],
                names=["claim_id", "at", "outcome", "version", "value", "families"],
            )

    kind = observations.schema["claim_id"].dataType.simpleString()
    types = [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
    key = F.col("claim_id") if kind == "bigint" else F.col("claim_id").cast("string").alias("claim_id")
    rows = observations.filter("claim_id IS NOT NULL").select(key, F.col("at").cast("long"), "value", "family", F.unix_micros(F.col("state_time").cast("timestamp")).alias("time"))
    ordered = rows.repartition("claim_id").sortWithinPartitions("claim_id", "at", "value", "family")
    return ordered.mapInArrow(fold, f"claim_id {'bigint' if kind == 'bigint' else 'string'}, at bigint, outcome string, version bigint, value string, families array<string>")


def settled_standing(advances: DataFrame, states: DataFrame) -> DataFrame:
    """claim_id, version, prior, action of claims whose latest version replaced a value: the machine resets STALE and
    SUPERSEDED, opens a review for other states but CURRENT, and leaves states as new as the version.

    advances: claim_id, at, outcome, version; states: claim_id, state, at.
    """
    moved = advances.filter(F.col("outcome").isin("RECORDED", "BASIS_ADDED", "REPLACED"))
    newest = moved.groupBy("claim_id").agg(F.max_by(F.struct("version", "at", "outcome"), "version").alias("v")).select("claim_id", "v.*").filter("outcome = 'REPLACED'")
    last = states.groupBy("claim_id").agg(F.max_by(F.struct(F.col("state").alias("prior"), F.col("at").alias("_at")), "at").alias("s")).select("claim_id", "s.*")
    prior = F.coalesce("prior", F.lit("CURRENT"))
    action = (
        F.when(F.col("_at") >= F.col("at"), "STANDS").when(prior.isin("STALE", "SUPERSEDED"), "RESET").when(prior == "CURRENT", "NONE").otherwise("REVIEW")
    )
    return newest.join(last, "claim_id", "left").select("claim_id", "version", prior.alias("prior"), action.alias("action"))


def propagated_changes(changes: DataFrame, claims: DataFrame, states: DataFrame) -> DataFrame:
    """change_id, claim_id, state (null if none is set), review of classified changes on the claims that they touch.

    changes: change_id, position, change_class, claim_id, current_value, state_time; claims: claim_id, value, position,
    evidence_time; states: claim_id, state. A later change or claim version, or newer evidence, wins; a claim that holds
    the new value already stands; what people decided is never stamped over. The review opens either way.
    """
    asked = changes.withColumn("_to", F.try_element_at(_map(STATE_OF_CHANGE), F.col("change_class"))).filter("_to IS NOT NULL")
    last = asked.groupBy("claim_id").agg(F.max("position").alias("_last"))
    held = claims.select("claim_id", F.col("value").alias("_value"), F.col("position").alias("_at"), F.col("evidence_time").alias("_newest"))
    prior = F.coalesce("_state", F.lit("CURRENT"))
    met = asked.join(held, "claim_id").join(last, "claim_id").join(states.select("claim_id", F.col("state").alias("_state")), "claim_id", "left")
    applies = (F.col("position") == F.col("_last")) & (F.col("_at") <= F.col("position")) & ~F.coalesce(F.col("_newest") > F.col("state_time"), F.lit(False))
    sets = applies & (F.col("_to") != "") & ~F.col("_value").eqNullSafe(F.col("current_value")) & prior.isin(*MACHINE_STATES) & (prior != F.col("_to"))
    review = F.coalesce(F.try_element_at(_map(REVIEW_OF_CHANGE), F.col("change_class")), F.lit("MANIFESTATION_CHANGED"))
    return met.select("change_id", "claim_id", F.when(sets, F.col("_to")).alias("state"), review.alias("review"))


def carried_changes(changes: DataFrame, dependents: DataFrame) -> DataFrame:
    """kind, dependent, n_changes, classes, changeset, latest: each analysis once, with all the changes that reach it.

    changes: change_id, position, change_class, ref; dependents: ref, kind, dependent. Unchanged states carry nothing.
    The changeset is a digest of the set of changes whatever their order; a hot analysis is aggregated in every task.
    """
    live = changes.filter(~F.col("change_class").isin(*INERT))
    met = live.join(dependents, "ref").groupBy("kind", "dependent", "change_id").agg(F.max("position").alias("position"), F.first("change_class").alias("change_class"))
    piece = F.conv(F.substring(F.md5(F.col("change_id").cast("string")), 1, 15), 16, 10).cast("long") % 1_000_003
    return met.groupBy("kind", "dependent").agg(
        F.count("*").alias("n_changes"), F.array_join(F.array_sort(F.collect_set("change_class")), ",").alias("classes"),
        F.sum(piece).alias("changeset"), F.max_by("change_id", "position").alias("latest"),
    )


def questioned_assumptions(assumptions: DataFrame, changes: DataFrame, degraded: DataFrame) -> DataFrame:
    """assumption_id, caused_by of held assumptions, by the first change on a supporting claim that is degraded or that
    changes in a way that questions it.

    assumptions: assumption_id, status, claim_id (a row for each support); changes: change_id, position, change_class,
    claim_id; degraded: claim_id.
    """
    held = assumptions.filter("status = 'HELD'").select("assumption_id", "claim_id").distinct()
    weak = degraded.select("claim_id", F.lit(True).alias("_weak")).distinct()
    asks = changes.filter(~F.col("change_class").isin(*INERT)).join(weak, "claim_id", "left").filter(F.col("_weak") | F.col("change_class").isin(*QUESTIONING))
    first = asks.groupBy("claim_id").agg(F.min(F.struct("position", "change_id")).alias("first"))  # a row a claim before they meet
    return held.join(first, "claim_id").groupBy("assumption_id").agg(F.min("first").alias("first")).select("assumption_id", F.col("first.change_id").alias("caused_by"))


def association_links(proposals: DataFrame, resolutions: DataFrame) -> DataFrame:
    """left, right, relation_type, status, version: links of identity after all resolutions.

    proposals: left, right, at, outcome; resolutions: left, right, at, resolution. AUTO_ASSOCIATE accepts itself,
    PROPOSE_ASSOCIATION opens a POSSIBLY_SAME_AS. ACCEPTED makes a SAME_AS; REJECTED, SPLIT and REVERSED close what is open,
    and nothing else. A link has a version for each step that changed it.
    """
    pair = ["left", "right"]
    opened = proposals.filter("outcome = 'AUTO_ASSOCIATE'").select(*pair, "at", F.lit("SAME_AS").alias("relation_type"), F.lit("ACTIVE").alias("status"))
    opened = opened.union(proposals.filter("outcome = 'PROPOSE_ASSOCIATION'").select(*pair, "at", F.lit("POSSIBLY_SAME_AS"), F.lit("PROPOSED")))
    opened = opened.union(resolutions.filter("resolution = 'ACCEPTED'").select(*pair, "at", F.lit("SAME_AS"), F.lit("ACTIVE")))
    closes = resolutions.withColumn("status", F.try_element_at(_map(CLOSES_AS), F.col("resolution"))).filter("status IS NOT NULL")
    closes = closes.select(*pair, "at", F.explode(F.array(F.lit("SAME_AS"), F.lit("POSSIBLY_SAME_AS"))).alias("relation_type"), "status")
    open_ = F.col("status").isin("ACTIVE", "PROPOSED")
    line = Window.partitionBy(*pair, "relation_type").orderBy("at", "status")
    steps = opened.union(closes).withColumn("_before", F.lag(open_).over(line)).filter(open_ | F.col("_before"))
    return steps.groupBy(*pair, "relation_type").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.count("*").alias("version"))


def alerts(raised: DataFrame, transitions: DataFrame) -> DataFrame:
    """alert_id, dedup_key, first_at, retriggered, status: one alert a key; later raises are notes that keep its status.

    raised: dedup_key, at; transitions: dedup_key, at, to_status, actor_kind. Only a person acknowledges, and only an alert
    that was raised before.
    """
    once = raised.groupBy("dedup_key").agg(F.min("at").alias("first_at"), (F.count("*") - 1).alias("retriggered"))
    allowed = transitions.filter("to_status <> 'ACKNOWLEDGED' OR actor_kind = 'HUMAN'")
    moved = once.select("dedup_key", "first_at").join(allowed, "dedup_key").filter("at > first_at").groupBy("dedup_key").agg(F.max_by("to_status", "at").alias("_status"))
    return once.join(moved, "dedup_key", "left").select(
        scalar.digest_id("alert", F.col("dedup_key")).alias("alert_id"), "dedup_key", "first_at", "retriggered", F.coalesce("_status", F.lit("OPEN")).alias("status")
    )


def frozen_evidence(refs: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """decision_id, n_refs, n_pinned, n_unresolved, snapshot: what a decision rests on, frozen against later change.

    refs: decision_id, ref (an object, or ``object@vN``); current: object_id, version; versions: object_id, version,
    content. Plain objects are pinned to their present version; the snapshot is a digest of the pinned contents.
    """
    asked = refs.select("decision_id", "ref").distinct()
    now = current.select(F.col("object_id").cast("string").alias("ref"), F.col("version").alias("_version"))
    pinned = asked.join(now, "ref", "left").withColumn("pinned", F.when(F.col("_version").isNotNull(), F.concat("ref", F.lit("@v"), "_version")).otherwise(F.col("ref")))
    held = versions.select(F.concat(F.col("object_id").cast("string"), F.lit("@v"), "version").alias("pinned"), F.col("content").alias("_content"))
    met = pinned.join(held, "pinned", "left")
    said = F.concat_ws("|", "pinned", F.coalesce("_content", F.lit("unresolved_reference")))
    piece = F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long") % 1_000_003
    return met.groupBy("decision_id").agg(
        F.count("*").alias("n_refs"), F.count_if(F.col("_version").isNotNull()).alias("n_pinned"), F.count_if(F.col("_content").isNull()).alias("n_unresolved"), F.sum(piece).alias("snapshot")
    )


def theme_status() -> Column:
    """Status by n_support, n_degraded, n_contradicting and n_families: independence promotes a theme, not its count."""
    return F.when(F.col("n_support") <= F.col("n_degraded"), "STALE").when(F.col("n_contradicting") > 0, "CONTESTED").when(F.col("n_families") >= 2, "ACTIVE").otherwise("EMERGING")


def refreshed_themes(themes: DataFrame, basis: DataFrame) -> DataFrame:
    """theme_id, was, status, transitions of themes whose basis or status moved; closed themes are not opened again.

    Both hold n_support, n_degraded, n_contradicting, n_families, n_observations; themes: theme_id, status as recorded.
    """
    numbers = ("n_support", "n_degraded", "n_contradicting", "n_families", "n_observations")
    now = basis.select("theme_id", *numbers).withColumn("now", theme_status()).withColumnsRenamed({n: f"{n}_1" for n in numbers})
    met = themes.filter(~F.col("status").isin(*CLOSED_THEMES)).withColumnsRenamed({n: f"{n}_0" for n in numbers}).join(now, "theme_id")
    differs = lambda n: F.col(f"{n}_0") != F.col(f"{n}_1")
    turned = F.col("status") != F.col("now")
    kind = F.when(F.col("now") == "CONTESTED", "CONTRADICTION_ADDED").when(F.col("now") == "STALE", "STALE").when(F.col("now") == "ACTIVE", "STRENGTHENED").otherwise("WEAKENED")
    told = F.array_compact(
        F.array(
            F.when(differs("n_families"), "SOURCE_DIVERSITY_CHANGED"), F.when(turned, kind),
            F.when(differs("n_observations") & ~turned, "EVIDENCE_UPDATED"), F.when(F.col("n_degraded_1") > F.col("n_degraded_0"), "WEAKENED"),
        )
    )
    moved = turned
    for n in numbers:
        moved = moved | differs(n)
    return met.filter(moved).select("theme_id", F.col("status").alias("was"), F.col("now").alias("status"), F.array_join(told, ",").alias("transitions"))


def update_verdict(acts: DataFrame, forecasts: DataFrame, indicators: DataFrame) -> DataFrame:
    """act_id, verdict, status of acts that would move a forecast's probability; the first rule that is broken tells.

    acts: act_id, forecast_id, at, probability, reason, actor_kind, indicator_id (empty if none); forecasts: forecast_id,
    status; indicators: indicator_id, status, forecast_ids, mode, target. A person moves it; a service only by an indicator
    that has fired, names the forecast and was armed for just this number, once. Equal times go by act_id. What indicators
    name meets the acts as rows, and only of indicators that some act gives; an indicator without a list names nothing.
    """
    by_rule = F.col("indicator_id") != ""
    asked = acts.filter(by_rule).select("indicator_id", "forecast_id").distinct()
    lists = indicators.select("indicator_id", "forecast_ids").join(asked.select("indicator_id").distinct(), "indicator_id", "left_semi")
    # merged, as Spark takes a list for small and would broadcast what it holds
    holds = asked.join(lists.select("indicator_id", F.explode("forecast_ids").alias("forecast_id")).hint("merge"), ["indicator_id", "forecast_id"], "left_semi").withColumn("_named", F.lit(True))
    named = acts.join(forecasts.select("forecast_id", F.col("status").alias("_status")), "forecast_id", "left")
    met = named.join(indicators.select("indicator_id", F.col("status").alias("_fired"), "mode", "target"), "indicator_id", "left").join(holds, ["indicator_id", "forecast_id"], "left")
    armed = (F.col("mode") == "APPLY_PROBABILITY") & (F.abs(F.col("target") - F.col("probability")) <= 1e-9)
    verdict = first_code(
        (F.col("_status").isNull(), "UNKNOWN_FORECAST"), (~F.col("_status").isin(*OPEN_FORECASTS), "CLOSED"), (F.col("reason") == "", "NO_REASON"),
        (by_rule & (F.col("actor_kind") == "HUMAN"), "INDICATOR_ON_HUMAN_ACT"), (~by_rule & (F.col("actor_kind") != "HUMAN"), "NO_AUTHORITY"),
        (by_rule & ~F.col("_fired").eqNullSafe("FIRED"), "NOT_FIRED"), (by_rule & F.col("_named").isNull(), "NOT_NAMED"),
        (by_rule & ~F.coalesce(armed, F.lit(False)), "NOT_AUTHORIZED"), (~F.col("probability").between(1e-12, 1 - 1e-12), "OUT_OF_RANGE"),
    )
    judged = met.withColumn("verdict", verdict)
    spends = judged.filter(F.col("verdict").isNull() & by_rule).groupBy("indicator_id", "forecast_id").agg(F.min(F.struct("at", "act_id")).alias("_first"))
    done = judged.join(spends, ["indicator_id", "forecast_id"], "left")
    final = F.coalesce("verdict", F.when(by_rule & (F.col("_first.act_id") != F.col("act_id")), "SPENT"), F.lit("UPDATED"))
    status = F.when((final == "UPDATED") & ~by_rule & (F.col("_status") == "UPDATE_REQUIRED"), "OPEN").otherwise(F.col("_status"))
    return done.select("act_id", final.alias("verdict"), status.alias("status"))


def theme_lineage(before: DataFrame, after: DataFrame) -> DataFrame:
    """old, new, shared, kind: what became of themes (theme_id, member) between two snapshots, by the members they share.

    Each old theme is succeeded by the new one that holds most of its members (of equals the least id); a new theme
    continues the old one that it succeeds with most shared members (then the least id): CONTINUED. Others that it
    succeeds are MERGED_INTO it; further new themes that hold members of an old one are SPLIT_INTO; an old theme without a
    member left has ENDED (no new), a new one without any old member is BORN (no old).
    """
    old, new = (df.select(F.col("theme_id").alias(n), "member").distinct() for df, n in ((before, "old"), (after, "new")))
    shared = saved(old.join(new, "member").groupBy("old", "new").agg(F.count("*").alias("shared")), "shared")
    rank = lambda other: F.struct((-F.col("shared")).alias("n"), F.col(other).alias("id"))
    heir = shared.groupBy("old").agg(F.min(rank("new"))["id"].alias("_heir"))
    met = shared.join(heir, "old").withColumn("_succeeds", F.col("new") == F.col("_heir"))
    chosen = met.filter("_succeeds").groupBy("new").agg(F.min(rank("old"))["id"].alias("_parent"))
    kind = F.when(~F.col("_succeeds"), "SPLIT_INTO").when(F.col("old") == F.col("_parent"), "CONTINUED").otherwise("MERGED_INTO")
    told = met.join(chosen, "new", "left").select("old", "new", "shared", kind.alias("kind"))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType)
    zero = F.lit(0).cast("long")
    ended = old.select("old").distinct().join(shared, "old", "left_anti").select("old", none("new", new).alias("new"), zero.alias("shared"), F.lit("ENDED").alias("kind"))
    born = new.select("new").distinct().join(shared, "new", "left_anti").select(none("old", old).alias("old"), "new", zero.alias("shared"), F.lit("BORN").alias("kind"))
    return told.union(ended).union(born)


def propagation_forest(rows: DataFrame, least_words: int = 6) -> DataFrame:
    """doc_id, parent, relation: each manifestation of a statement and the nearest earlier one that it can come from.

    ``rows``: statement (in its normal form), doc_id, family, at. The parent is the last manifestation of the same statement
    before it, by time and id: SAME_ORIGIN_FAMILY where the families are one; across families LIKELY_DERIVATIVE if the
    statement has ``least_words`` words and the times differ, else UNRESOLVED. The first of a statement has no parent and is
    the ORIGIN. Statements of any number of rows are looked through in blocks.
    """
    long_ = F.size(F.split("statement", " ", least_words)) >= least_words
    thin = rows.select(F.sha2("statement", 256).alias("_same"), long_.alias("_long"), "doc_id", "family", "at")  # texts are not sorted
    met = previous(thin, ["_same"], ["at", "doc_id"], ["doc_id", "family", "at"])
    relation = (
        F.when(F.col("before").isNull(), "ORIGIN").when(F.col("family") == F.col("before.family"), "SAME_ORIGIN_FAMILY")
        .when(F.col("_long") & (F.col("before.at") < F.col("at")), "LIKELY_DERIVATIVE").otherwise("UNRESOLVED")
    )
    return met.select("doc_id", F.col("before.doc_id").alias("parent"), relation.alias("relation"))


def ordered_analogues(situations: DataFrame, episodes: DataFrame, least: int = 2) -> DataFrame:
    """situation, episode, matched, n_matched of episodes that match a situation in at least ``least`` (two or more) of three ways.

    Both: id, actors, events (arrays; types of events in their order). ACTOR_CONFIGURATION: an actor of both; EVENT_TYPE: a
    type of both; TEMPORAL_SEQUENCE: two types of both or more, which come in the same order. Situations are a stated set and
    are broadcast; a match of two ways holds a type of both, so pairs meet by type, once each.
    """
    side = lambda df, n: df.select(F.col("id").alias(n), F.col("actors").alias(f"{n}_actors"), F.col("events").alias(f"{n}_events"))
    a, b = side(situations, "situation"), side(episodes, "episode")
    types = a.withColumn("type", F.explode(F.array_distinct("situation_events")))
    kinds = F.array_intersect("situation_events", "episode_events")
    # of the types of both, a pair is taken at the first
    pairs = b.withColumn("type", F.explode(F.array_distinct("episode_events"))).join(F.broadcast(types), "type").filter(F.col("type") == F.array_min(kinds))
    only = lambda c: F.filter(c, lambda t: F.array_contains(kinds, t))
    same = (F.size(kinds) >= 2) & (only("situation_events") == only("episode_events"))
    matched = F.array_compact(F.array(F.when(F.arrays_overlap("situation_actors", "episode_actors"), "ACTOR_CONFIGURATION"), F.lit("EVENT_TYPE"), F.when(same, "TEMPORAL_SEQUENCE")))
    return pairs.select("situation", "episode", F.array_join(matched, ",").alias("matched"), F.size(matched).cast("long").alias("n_matched")).filter(F.col("n_matched") >= max(2, least))
