"""Situation reports: twelve sections over what a reader sees, as lines of JSON, Markdown, fixed-width text or HTML, in many files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.operators.blocks import placed
from worldlog.operators.graph import saved

# Fixed values.
SECTIONS = (
    "Resources", "Infrastructure", "Routes", "Movements", "Unresolved conflicts", "Stale information", "Dependent reporting", "Alerts", "Recommendations", "Decisions", "Unresolved", "Provenance",
)
FORMATS = ("json", "markdown", "text", "html")
NONE, WIDTH = "none in this view", 72
_ITEM = ("section", "key", "state", "label", "detail")


def items(objects: DataFrame, exposed: DataFrame, proposals: DataFrame, groups: DataFrame, decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """section, key, state, label, detail of a report over what a reader sees.

    ``objects``, ``proposals`` and ``groups`` as the rules have them; ``exposed``: route_id, n of their exposure; ``decisions``: decision_id, state, actor, rationale;
    ``sources``: source, n of what the view rests on.
    """
    kind = F.col("object_type")
    text = lambda c: c.cast("string")
    said = F.coalesce("status", F.lit("UNKNOWN"))
    row = lambda df, section, key, state, label, detail: df.select(F.lit(section).alias("section"), text(key).alias("key"), state.alias("state"), label.alias("label"), detail.alias("detail"))
    own, named = F.col("object_id"), F.concat(F.lit("object "), text(F.col("object_id")))
    fresh = F.when(F.col("stale"), "STALE").otherwise("FRESH")
    routes = objects.filter(kind == "ROUTE").join(exposed.select(F.col("route_id").alias("object_id"), F.col("n").alias("_n")), "object_id", "left")
    known = F.when(F.col("_n") > 0, F.concat(text(F.col("_n")), F.lit(" known disruption(s)"))).otherwise("no known disruption")
    of = lambda k: proposals.filter(F.col("kind") == k)
    about, why = F.concat("subject", F.lit(" "), F.coalesce("other", F.lit(""))), F.concat("rule", F.lit(": "), text(F.col("n")))
    return reduce(
        DataFrame.union,
        [
            row(objects.filter(kind == "RESOURCE_STOCK"), "Resources", own, F.col("epistemic_state"), named, F.concat(F.lit("status: "), said, F.lit(" ("), fresh, F.lit(")"))),
            row(objects.filter(kind == "INFRASTRUCTURE"), "Infrastructure", own, F.col("epistemic_state"), named, F.concat(F.lit("status: "), said, F.when(F.col("epistemic_state") == "DISPUTED", " - DISPUTED").otherwise(""))),
            row(routes, "Routes", own, F.lit("INFERRED"), named, known),
            row(objects.filter(kind == "MOVEMENT"), "Movements", own, F.col("epistemic_state"), named, F.concat(F.lit("status: "), said)),
            row(of("ALERT").filter("rule = 'infrastructure-conflict'"), "Unresolved conflicts", F.col("subject"), F.lit("DISPUTED"), F.concat(F.lit("object "), "subject"), F.col("other")),
            row(objects.filter("stale"), "Stale information", own, F.lit("STALE"), named, F.lower(kind)),
            row(groups.groupBy("group_id").agg(F.count("*").alias("_n")).filter("_n > 1"), "Dependent reporting", F.col("group_id"), F.lit("REPORTED"), F.concat(F.lit("group "), text(F.col("group_id"))), F.concat(text(F.col("_n")), F.lit(" reports share one underlying basis; they are not independent corroboration"))),
            row(of("ALERT"), "Alerts", F.concat_ws("/", "rule", "subject", "other"), F.lit("OPEN"), about, why),
            row(of("RECOMMENDATION"), "Recommendations", F.concat_ws("/", "subject", "other"), F.lit("PROPOSED"), about, why),
            row(decisions, "Decisions", F.col("decision_id"), F.col("state"), F.concat(F.lit("by "), "actor"), F.col("rationale")),
            row(objects.filter("epistemic_state = 'DISPUTED'"), "Unresolved", own, F.lit("DISPUTED"), named, F.lower(kind)),
            row(sources, "Provenance", F.col("source"), F.lit("SOURCE"), text(F.col("source")), F.concat(text(F.col("n")), F.lit(" record(s)"))),
        ],
    )


def _escaped(c: Column) -> Column:
    return reduce(lambda col, x: F.replace(col, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), c)


def _line(form: str) -> tuple[Column, Column, Column, Column | None]:
    """How a format writes a title, an item, an empty section, and what ends a section."""
    title, state, label, detail = (F.col(c) for c in ("section", "state", "label", "detail"))
    if form == "markdown":
        return F.concat(F.lit("## "), title), F.concat(F.lit("- **"), state, F.lit("** "), label, F.lit(": "), detail), F.lit(f"- {NONE}"), F.lit("")
    if form == "text":
        return F.upper(title), F.substring(F.concat(F.lit("  "), state, F.lit(" "), label, F.lit(": "), detail), 1, WIDTH), F.lit(f"  {NONE}"), F.lit("-" * WIDTH)
    if form == "html":
        return F.concat(F.lit("<h2>"), _escaped(title), F.lit("</h2><ul>")), F.concat(F.lit("<li><b>"), _escaped(state), F.lit("</b> "), _escaped(label), F.lit(": "), _escaped(detail), F.lit("</li>")), F.lit(f"<li>{NONE}</li>"), F.lit("</ul>")
    if form == "json":
        return F.to_json(F.struct("section")), F.to_json(F.struct("section", "state", "label", "detail")), F.to_json(F.struct("section", F.lit(NONE).alias("note"))), None
    raise ValueError(f"unknown format: {form}")


def lines(found: DataFrame, form: str) -> DataFrame:
    """place, line of a report in a format: the twelve sections in their order, items by key; a section without items says so."""
    number = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    spark = found.sparkSession
    every = spark.createDataFrame([(s,) for s in SECTIONS], "section string")
    title, item, empty, end = _line(form)
    shape = lambda df, rank, key, line: df.select(number.alias("_section"), F.lit(rank).alias("_rank"), key.alias("_key"), line.alias("line"))
    none = F.lit("")
    parts = [shape(every, 0, none, title), shape(found, 1, F.col("key"), item), shape(every.join(found.select("section").distinct(), "section", "left_anti"), 1, none, empty)]
    if end is not None:
        parts.append(shape(every, 2, none, end))
    return placed(reduce(DataFrame.union, parts), ["_section", "_rank", "_key", "line"]).select("place", "line")


def written(found: DataFrame, form: str, path: str) -> None:
    """The report as text files in ``path``, whose names are in the order of their lines."""
    told = saved(lines(found, form), "report")
    told.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)
