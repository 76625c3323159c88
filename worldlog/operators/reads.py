"""Read predicates and walks: eligibility, egress, attribution, closures of references, review queues, rules and needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldlog.operators.graph import kept_by, saved
from worldlog.operators.views import AUTHORITY

# The keys under which a payload names records, and which end of a relation controls what the other says.
ID_KEY = r"(^|_)(id|ids)$|^claims$"
CONTROLLING_END = {"PUBLISHES": "source", "OPERATES": "source", "OWNED_BY": "target", "OPERATED_BY": "target"}
PIVOT_PRIORITY = {"RELATIONSHIP_PIVOT": 0, "DOMAIN": 1, "ALIAS": 2}
TERMINAL = ("RESOLVED_TRUE", "RESOLVED_FALSE", "WITHDRAWN")


def passes(rules: list[tuple[str, str, list]]) -> Column:
    """Configured filters (field, ``eq`` or ``in``, values), all of which must hold; a missing value passes none."""
    tests = [F.coalesce(F.col(f) == values[0] if op == "eq" else F.col(f).isin(*values), F.lit(False)) for f, op, values in rules]
    return reduce(Column.__and__, tests, F.lit(True))


_OPEN_QUERY = "source_id = '' AND operation <> 'LOOKUP' AND (operation <> 'FETCH' OR value RLIKE '^https?://')"


def _able(profiles: DataFrame) -> DataFrame:
    return profiles.select("source_id", "languages", F.explode(F.array_distinct("operations")).alias("operation"))


def _speaks() -> Column:
    return (F.col("language") == "") | F.arrays_overlap("languages", F.array(F.col("language"), F.lit("mul")))


def eligible_sources(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """query_id, source_id of the sources that declare that they can run a query.

    queries: query_id, operation, source_id (empty if any), language (empty if any), value; profiles: source_id,
    operations, languages. A named source must support the operation. A LOOKUP needs a named source, a FETCH an address.
    """
    named = queries.filter("source_id <> ''").join(profiles, "source_id").filter(F.array_contains("operations", F.col("operation")))
    met = queries.filter(_OPEN_QUERY).drop("source_id").join(_able(profiles), "operation").filter(_speaks())
    return named.select("query_id", "source_id").union(met.select("query_id", "source_id"))


def eligible_counts(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """query_id, n, first: how many ``eligible_sources`` a query has, and the least of them; queries without any have no row.

    Open queries of one operation and language have the same sources: these are counted once for each such pair, and no
    pair of a query and a source is made.
    """
    named = queries.filter("source_id <> ''").join(profiles, "source_id").filter(F.array_contains("operations", F.col("operation")))
    open_ = queries.filter(_OPEN_QUERY).select("query_id", "operation", "language")
    asked = open_.select("operation", "language").distinct()
    able = asked.join(_able(profiles), "operation").filter(_speaks()).groupBy(F.col("operation").alias("_operation"), F.col("language").alias("_language"))
    found = able.agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
    met = open_.join(found, (F.col("operation") == F.col("_operation")) & F.col("language").eqNullSafe(F.col("_language")))
    each = named.select("query_id", F.lit(1).cast("long").alias("n"), F.col("source_id").alias("first")).union(met.select("query_id", "n", "first"))
    return each.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def egress_refused() -> Column:
    """Without a declared ceiling only public rows may leave: no compartment, the least role, released to PUBLIC."""
    open_ = (F.size("compartments") == 0) & (F.col("min_role") == "OBSERVER") & F.array_contains("releasability", "PUBLIC")
    return ~F.coalesce(open_, F.lit(False))


def over_ceiling(ceiling_compartments: list[str], ceiling_releasability: list[str], ceiling_rank: int, rank: Column) -> Column:
    """With a ceiling: whether the join of a row's marking with it is stricter than the ceiling itself."""
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    more = F.size(F.array_except("compartments", texts(ceiling_compartments))) > 0
    fewer = F.size(F.array_except(texts(ceiling_releasability), "releasability")) > 0
    return F.coalesce(more | fewer | (rank > ceiling_rank), F.lit(True))


def touches(executions: DataFrame, subjects: DataFrame, least: int = 6) -> DataFrame:
    """execution_id, subject of executions about a subject: their query's value names it, or their address holds it whole.

    executions: execution_id, value, url; subjects: subject (``SCHEME:value`` or value). A subject counts with and without
    its scheme, letters of either case, in addresses only from ``least`` characters on and not within a longer word.
    Subjects meet words of the address by equality on their first word; the whole is tested then.
    """
    names = subjects.select("subject", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower(F.regexp_replace("subject", "^[^:]*:", ""))))).alias("name")).filter("name <> ''")
    by_value = executions.select("execution_id", F.lower("value").alias("name")).join(names, "name").select("execution_id", "subject")
    word = r"(?U)\w+"
    long_ = names.filter(F.length("name") >= least).withColumn("word", F.regexp_extract("name", word, 0))
    url = executions.select("execution_id", F.lower("url").alias("url"))
    words = url.select("execution_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit(word), F.lit(0)))).alias("word"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), "name", F.lit(r"\E(?!\w)"))
    by_url = words.join(long_, "word").filter(F.regexp_like("url", quoted)).select("execution_id", "subject")
    return by_value.union(by_url).distinct()


def attribution(relations: DataFrame, references: DataFrame, entity: str) -> DataFrame:
    """kind, linked: objects that an entity has publication control over by ACTIVE relations in the controlling direction,
    and their hosts, by domains and by addresses of a site's root alone."""
    ends = F.create_map(*[F.lit(x) for pair in CONTROLLING_END.items() for x in pair])
    active = relations.filter("status = 'ACTIVE'").withColumn("end", F.try_element_at(ends, F.col("relation_type")))
    out = active.filter((F.col("end") == "source") & (F.col("source_id") == entity)).select(F.col("target_id").alias("linked"))
    back = active.filter((F.col("end") == "target") & (F.col("target_id") == entity)).select(F.col("source_id").alias("linked"))
    linked = out.union(back).filter(F.col("linked") != entity).distinct()
    held = references.join(linked, references.object_id == linked.linked, "left_semi")
    host, path = F.regexp_extract("url_key", "^[^/]*", 0), F.regexp_extract("url_key", "/.*$", 0)
    hosts = held.filter((F.col("system") == "DOMAIN") | ((F.col("system") == "URL") & path.isin("", "/"))).select(host.alias("linked")).distinct()
    return linked.select(F.lit("object").alias("kind"), "linked").union(hosts.select(F.lit("host"), "linked"))


def closure(direct: DataFrame, references: DataFrame, records: DataFrame, resolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ref, depth) of all that ``direct`` (ref) rests on by ``references`` (src, dst), and direct refs that no record has.

    A reference that names no record ends its way; ``resolved``: there is none such, and records are not asked. Rounds end
    with the first that finds nothing new; cycles do no harm. References are written once, in buckets of src.
    """
    known = records.select("ref")
    found = saved(direct.select("ref").distinct().join(known, "ref", "left_semi").withColumn("depth", F.lit(0)), "closure")
    front = found
    ways = references.select("src", "dst")
    ways = kept_by(ways if resolved else ways.join(known, ways.dst == known.ref, "left_semi"), "ways", "src")
    while True:
        step = front.join(ways, front.ref == ways.src).select(F.col("dst").alias("ref"), (F.col("depth") + 1).alias("depth")).distinct()
        front = saved(step.join(found, "ref", "left_anti"), "closure")
        if not front.limit(1).count():
            return found, direct.select("ref").distinct().join(known, "ref", "left_anti")
        found = found.union(front)


def path_problem(edges: str, stated: str, note: str) -> Column:
    """What is wrong with an impact path (array of from_id, to_id, authority): edges that do not meet, an authority that is
    not that of the weakest edge, uncertain edges without a note; null if nothing is."""
    at = lambda a: F.array_position(F.array(*map(F.lit, AUTHORITY)), a)
    e = F.col(edges)
    broken = F.exists(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.get(e, i - 1)["to_id"] != F.get(e, i)["from_id"])
    weakest = F.array_max(F.transform(e, lambda x: at(x["authority"])))
    return (
        F.when(F.size(e) == 0, "EMPTY")
        .when((F.size(e) > 1) & broken, "DISCONNECTED")
        .when(at(F.col(stated)) != weakest, "AUTHORITY")
        .when(F.exists(e, lambda x: ~x["authority"].isin("OBSERVED", "DERIVED")) & (F.col(note) == ""), "UNCERTAINTY_UNSTATED")
    )


def shown_ids(leaves: DataFrame, key: str) -> DataFrame:
    """key, id: values that a payload's leaves (path, value) hold under a key that names records; free text names nothing."""
    name = F.regexp_extract(F.regexp_replace("path", r"(\[\d+\])+$", ""), r"([^.]*)$", 1)
    return leaves.filter(name.rlike(ID_KEY) & (F.col("value") != "")).select(key, F.col("value").alias("id")).distinct()


def unresolvable(cited: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """key, field, id of ids that a candidate cites and its request did not show."""
    return cited.join(shown, [key, "id"], "left_anti").select(key, "field", "id")


def provider_report(proposals: DataFrame, visible: DataFrame, restricted: DataFrame) -> DataFrame:
    """run, n, n_unsupported, n_leaks, uncited, digest: what an evaluation of a provider's runs counts.

    proposals: run, proposal_id, kind, content, refs (ids), evidence. A proposal that names what is not visible is
    unsupported, one that names what is restricted leaks; alerts and recommendations must cite evidence. Runs of equal
    content have equal digests, whatever their order.
    """
    each = proposals.select("run", "proposal_id", F.explode_outer("refs").alias("ref"))
    unseen = each.filter("ref IS NOT NULL").join(visible, "ref", "left_anti").groupBy("run").agg(F.count_distinct("proposal_id").alias("n_unsupported"))
    leaks = each.join(restricted, "ref", "left_semi").groupBy("run").agg(F.count_distinct("proposal_id").alias("n_leaks"))
    piece = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "content")), 1, 15), 16, 10).cast("long")
    must = F.col("kind").isin("ALERT_CANDIDATE", "RECOMMENDATION_CANDIDATE")
    counts = proposals.groupBy("run").agg(F.count("*").alias("n"), F.count_if(must & (F.size("evidence") == 0)).alias("uncited"), F.sum(piece % 1_000_003).alias("digest"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return counts.join(unseen, "run", "left").join(leaks, "run", "left").select("run", "n", zero("n_unsupported"), zero("n_leaks"), "uncited", "digest")


def annotation_verdict(acts: DataFrame, current: DataFrame, visible: DataFrame) -> DataFrame:
    """act_id, verdict of acts on annotations: the target must be visible, the version the one that was seen; only authors
    withdraw what they wrote or close their dissent.

    acts: act_id, annotation_id, actor, status, expected; current: annotation_id, target_id, author, kind, version.
    """
    met = acts.join(current, "annotation_id", "left").join(visible.select("target_id", F.lit(True).alias("_seen")), "target_id", "left")
    verdict = (
        F.when(F.col("author").isNull() | F.col("_seen").isNull(), "NOT_FOUND")
        .when(F.col("version") != F.col("expected"), "CONFLICT")
        .when((F.col("status") == "WITHDRAWN") & (F.col("actor") != F.col("author")), "FORBIDDEN_WITHDRAWAL")
        .when((F.col("kind") == "DISSENT") & (F.col("actor") != F.col("author")), "FORBIDDEN_DISSENT")
        .otherwise("RECORDED")
    )
    return met.select("act_id", verdict.alias("verdict"))


def accepted_candidates(claims: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """claim_id, verdict of records that say which candidate they come from: it must be accepted, not spent by an earlier
    record, and equal in the fields that it binds.

    claims: claim_id, candidate_id, ``keys``; candidates: candidate_id, status, ``keys``.
    """
    bound = candidates.select("candidate_id", F.col("status").alias("_status"), *[F.col(k).alias(f"_{k}") for k in keys])
    first = claims.groupBy("candidate_id").agg(F.min("claim_id").alias("_first"))
    met = claims.join(bound, "candidate_id", "left").join(first, "candidate_id")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    verdict = F.when(F.col("_status").isNull(), "UNKNOWN").when(F.col("_status") != "ACCEPTED", "NOT_ACCEPTED").when(F.col("claim_id") != F.col("_first"), "SPENT").when(~same, "BINDING").otherwise("ADMITTED")
    return met.select("claim_id", verdict.alias("verdict"))


def refreshed_forecasts(forecasts: DataFrame, now: Column) -> DataFrame:
    """forecast_id, status after a pass: terminal ones stay; a passed horizon resolves by the rule's observation, by its
    absence if the declared coverage was achieved, and waits else; a degraded basis asks for an update.

    forecasts: forecast_id, status, horizon, degraded, satisfied (the rule's event was seen), covered.
    """
    open_ = F.col("status").isin("OPEN", "UPDATE_REQUIRED", "HORIZON_PASSED")
    passed = now > F.col("horizon")
    status = (
        F.when(~open_, F.col("status"))
        .when(passed & F.col("satisfied"), "RESOLVED_TRUE")
        .when(passed & F.col("covered"), "RESOLVED_FALSE")
        .when(passed, "HORIZON_PASSED")
        .when(F.col("degraded") & (F.col("status") == "OPEN"), "UPDATE_REQUIRED")
        .otherwise(F.col("status"))
    )
    return forecasts.select("forecast_id", F.col("status").alias("was"), status.alias("status"))


def first_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by ``order``; a window group limit keeps one row of each task before the shuffle."""
    line = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(line)).filter("_rank = 1").drop("_rank")
