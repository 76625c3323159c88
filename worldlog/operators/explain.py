"""Explanations: what a record rests on, hop by hop, as far as a reader may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worldlog.operators.graph import kept_by, saved
from worldlog.operators.references import ANY

HIDDEN = "REDACTED"


def _numbered(records: DataFrame) -> DataFrame:
    """kind, ref, visible, node of records (kind, ref, visible), each once, in buckets of their ref: nodes are numbers in the order of refs."""
    each = records.filter("ref IS NOT NULL").select("kind", "ref", "visible").repartitionByRange("ref").distinct()
    return kept_by(each.sortWithinPartitions("ref", "kind", "visible").withColumn("node", F.monotonically_increasing_id()), "nodes", "ref")


def _links(first: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """src, field, node, kind, visible of the edges of all that is met within ``hops`` from ``first`` (node, ref), in buckets of src; node, ref of
    what is visible of it. An edge is looked up once, however many seeds come by it, and one that nobody comes by never."""
    ways = kept_by(edges.select(F.col("src").alias("_src"), F.col("field").alias("_field"), F.col("kind").alias("_kind"), F.col("ref").alias("_ref")), "edges", "_src", once=False)
    front = reached = first.select("node", "ref")
    levels = []
    for _ in range(hops):
        out = front.hint("shuffle_hash").join(ways, front.ref == ways["_src"]).select(F.col("node").alias("src"), "_field", "_kind", "_ref")
        met = out.join(nodes, out["_ref"] == nodes.ref).filter((F.col("_kind") == ANY) | (F.col("_kind") == F.col("kind")))
        level = saved(met.select("src", F.col("_field").alias("field"), "node", "kind", "visible", "ref"), "links")
        levels.append(level)
        front = saved(level.filter("visible").select("node", "ref").distinct().join(reached.select("node"), "node", "left_anti"), "reached")
        if front.isEmpty():
            break
        reached = reached.union(front)
    return kept_by(reduce(DataFrame.union, levels).select("src", "field", "node", "kind", "visible"), "links", "src"), reached


def _descended(seeds: DataFrame, edges: DataFrame, records: DataFrame, hops: int, hidden: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``descent`` with numbers for seed, parent and node, and the refs of all visible ones (node, ref)."""
    nodes = _numbered(records)
    if hidden is not None:
        mixed = nodes.groupBy(F.col("ref").alias("src")).agg(F.count_distinct("visible").alias("n")).filter("n > 1").select("src")
        edges = edges if mixed.isEmpty() else edges.unionByName(hidden.join(mixed, "src", "left_semi").select(edges.columns))
    asked = nodes.join(seeds.select("ref").distinct(), "ref", "left_semi").filter("visible")
    asked = saved(asked.select(F.min("node").over(Window.partitionBy("ref")).alias("seed"), "node", "kind", "visible", "ref"), "seeds")
    found = front = asked.select("seed", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("field"), "kind", "node", "visible")
    links, names = _links(asked, edges, nodes, hops)
    for hop in range(1, hops + 1):
        step = front.filter("visible").select("seed", F.col("node").alias("src")).join(links, "src")
        met = step.groupBy("seed", "node").agg(F.min(F.struct("src", "field")).alias("_by"), F.first("kind").alias("kind"), F.first("visible").alias("visible"))
        new = met.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        front = saved(new.select("seed", F.lit(hop).alias("hop"), F.col("_by.src").alias("parent"), F.col("_by.field").alias("field"), "kind", "node", "visible"), "descent")
        if front.isEmpty():
            break
        found = found.union(front)
    return found, names


def _called(df: DataFrame, names: DataFrame, **columns: str) -> DataFrame:
    """``df`` with a column of refs for each of its columns of numbers; what has no name is null."""
    for number, ref in columns.items():
        df = df.join(names.select(F.col("node").alias(number), F.col("ref").alias(ref)), number, "left")
    return df


def descent(seeds: DataFrame, edges: DataFrame, records: DataFrame, hops: int, hidden: DataFrame | None = None) -> DataFrame:
    """seed, hop, parent, field, kind, ref of all that each seed (ref) rests on by ``edges`` (src, field, kind, ref).

    ``records``: kind, ref, visible. A node is met once for each seed, at its least hop, from the least (parent, field) there.
    One that the reader may not see is a stand-in: its kind with REDACTED for its id, and nothing below it is met by that
    way; what lies below may still be met by another. Seeds that are hidden or no record have no rows. Cycles do no harm.
    Edges that name no record have no rows; those of the kind ``ANY`` mean all records of that id. What ``edges`` leave out
    of rows that are hidden may be given as ``hidden``: it is read if an id has both visible rows and hidden ones.
    Walks are of numbers in the order of ids, which are looked up before and after them.
    """
    found, names = _descended(seeds, edges, records, hops, hidden)
    called = _called(found, names, node="_node", parent="_parent", seed="_seed")
    return called.select(F.col("_seed").alias("seed"), "hop", F.col("_parent").alias("parent"), "field", "kind", F.when(F.col("visible"), F.col("_node")).otherwise(HIDDEN).alias("ref"), "visible")


def _counted(walk: DataFrame, places: dict[str, tuple[str, ...]], ref: str) -> DataFrame:
    at = F.array(*(F.when(F.array_contains(F.array(*map(F.lit, kinds)), F.col("kind")) | F.array_contains(F.array(*map(F.lit, kinds)), F.concat_ws("/", "kind", "field")), s) for s, kinds in places.items()))
    each = walk.withColumn("section", F.explode(F.array_compact(at)))
    return each.groupBy("seed", "section").agg(F.count("*").alias("n"), F.count_if(~F.col("visible")).alias("n_hidden"), F.min(F.when(F.col("visible"), F.col(ref))).alias("first"))


def sections(walk: DataFrame, places: dict[str, tuple[str, ...]]) -> DataFrame:
    """seed, section, n, n_hidden, first: a walk's nodes by section; ``places``: section to the kinds, or kind/field, it holds.

    ``first`` is the least visible id; a section of which the reader sees nothing has none, but says how many are hidden.
    """
    return _counted(walk, places, "ref")


def explained(seeds: DataFrame, edges: DataFrame, records: DataFrame, hops: int, places: dict[str, tuple[str, ...]], hidden: DataFrame | None = None) -> DataFrame:
    """``sections`` of a ``descent``; only their rows get ids, not those of the walks."""
    found, names = _descended(seeds, edges, records, hops, hidden)
    told = _called(_counted(found, places, "node"), names, first="_first", seed="_seed")
    return told.select(F.col("_seed").alias("seed"), "section", "n", "n_hidden", F.col("_first").alias("first"))
