"""Graphs as tables of edges: components, neighbourhoods, shortest paths, transitive dependents."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one of our own if there is one machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="worldlog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again: a round's lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, name: str, *keys: str, once: bool = True) -> DataFrame:
    """``df``'s rows, each once (or as they are), written like ``saved`` in buckets of ``keys``: joins on just these do not shuffle it again, however often it is read."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df = df.repartition(n, *keys)
    # ids in hexadecimal are half as long under zstd
    (df.distinct() if once else df).write.bucketBy(n, *keys).option("path", f"{shared_folder(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


#: Rows of a table that one task may hold.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int | None = None) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by keys, or evenly, to tasks of ``each`` rows (``TASK_ROWS``): what one task holds does not grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or TASK_ROWS))), *keys)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) of every node of ``edges`` (src, dst).

    Each round a node takes the least label around it and then its label's own label, so that labels halve the way to
    their root; rounds grow with the logarithm of a long chain. Labels are as many as nodes and not broadcast: nothing passes
    through the driver but whether to go on.
    """
    links = saved(both_ways(edges.filter("src IS NOT NULL AND dst IS NOT NULL")), "edges")
    label = links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component"))
    label = saved(label, "labels")
    while True:
        around = links.join(label.hint("merge"), links.dst == label.node).groupBy("src").agg(F.min("component").alias("_around"))
        nearer = label.join(around.hint("merge"), label.node == around.src, "left").select("node", F.least("component", "_around").alias("component"))
        root = nearer.select(F.col("node").alias("_node"), F.col("component").alias("_root"))
        jumped = nearer.join(root.hint("merge"), nearer.component == root["_node"], "left").select("node", F.coalesce("_root", "component").alias("component"))
        after = saved(jumped, "labels")
        changed = after.join(label.withColumnRenamed("component", "_old").hint("merge"), "node").filter("component <> _old").limit(1).count()
        label = after
        if not changed:
            return label


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """node, hop: the nodes within ``hops`` (0 to 6) edges of the seeds, and how many it takes; ``types``: relation types to go by
    (column ``relation_type``), all where none are named. A seed without an edge is its own neighbourhood."""
    links = (edges if types is None else edges.filter(F.col("relation_type").isin(types))).select("src", "dst")
    links = saved(links, "links") if hops > 1 else links
    found = seeds.select(F.col("node"), F.lit(0).cast("long").alias("hop")).distinct()
    front = found
    for hop in range(1, min(hops, 6) + 1):
        way = lambda a, b: front.join(links, front.node == links[a]).select(F.col(b).alias("node"))
        reached = way("src", "dst").union(way("dst", "src")).distinct()  # edges are neither turned nor shuffled for a small front
        front = saved(reached.join(found, "node", "left_anti").withColumn("hop", F.lit(hop).cast("long")), "front")
        found = found.union(front)
    return found


def shortest_hops(edges: DataFrame, start: object, limit: int = 3) -> DataFrame:
    """node, hop from one start, at most ``limit`` hops, both directions."""
    seeds = edges.sparkSession.createDataFrame([(start,)], f"node {edges.schema['src'].dataType.simpleString()}")
    return neighbourhood(edges, seeds, limit)


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node: all that rests on the changed nodes, directly or not (src is what dst rests on); cycles do no harm."""
    found = saved(changed.select("node").distinct(), "found")
    front = found
    while True:
        reached = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = saved(reached.join(found, "node", "left_anti"), "front")
        if not front.limit(1).count():
            return found.join(changed, "node", "left_anti")
        found = found.union(front)


def typed_paths(edges: DataFrame, wanted: DataFrame, types: list[str], hops: int = 3) -> DataFrame:
    """seed, target, step, src, relation_id, relation_type, dst: the edges of a shortest path for each wanted (seed, target).

    ``edges``: relation_id, src, dst, relation_type, status; only ACTIVE ones of the given types count, in both directions. Of
    several shortest paths that one is given whose last edge has the least (relation_id, node before), and so on towards
    the seed. Pairs farther apart than ``hops`` edges, or the same node twice, have no rows. Each round keeps one
    predecessor for each (seed, node); paths are put together from those, no path is carried along.
    """
    good = edges.filter((F.col("status") == "ACTIVE") & F.col("relation_type").isin(types) & (F.col("src") != F.col("dst")))
    columns = ["relation_id", "relation_type"]
    links = saved(good.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), *columns).union(good.select("dst", "src", *columns)), "links")
    none = F.lit(None)
    front = wanted.select("seed", F.col("seed").alias("node")).distinct()
    front = front.withColumns({"hop": F.lit(0), "prev": none.cast(good.schema["src"].dataType), "relation_id": none.cast(good.schema["relation_id"].dataType), "relation_type": none.cast("string")})
    found = front = saved(front, "paths")
    for hop in range(1, hops + 1):
        step = front.select("seed", F.col("node").alias("_a")).join(links, "_a")
        least = step.groupBy("seed", F.col("_b").alias("node")).agg(F.min(F.struct("relation_id", F.col("_a").alias("prev"), "relation_type")).alias("_by"))
        new = least.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        front = saved(new.select("seed", "node", F.lit(hop).alias("hop"), "_by.prev", "_by.relation_id", "_by.relation_type"), "paths")
        found = found.union(front)
    at = wanted.distinct().join(found.withColumnRenamed("node", "target"), ["seed", "target"]).filter("hop > 0").withColumn("node", F.col("target"))
    rows = []
    for _ in range(hops):
        rows.append(at.select("seed", "target", F.col("hop").alias("step"), F.col("prev").alias("src"), "relation_id", "relation_type", F.col("node").alias("dst")))
        at = at.select("seed", "target", F.col("prev").alias("node")).join(found, ["seed", "node"]).filter("hop > 0")
    return reduce(DataFrame.union, rows)


def joined_components(label: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What new links make of components: (node, component) of all nodes, and (was, component) of those that were merged into another.

    ``label``: node, component (the least node). Only the components that new links (src, dst) touch are worked on, each as
    one node; the rest is not read but for its labels. Records that carry a component are re-keyed by joining the second
    table, which holds one row for each component that is no more.
    """
    ends = saved(links.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"), "ends")
    nodes = ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct()
    touched = saved(nodes.join(label.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("new")), "touched")
    of = lambda side: touched.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    between = ends.join(of("src").hint("merge"), "src").join(of("dst").hint("merge"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    merged = components(between).filter("node <> component").select(F.col("node").alias("was"), "component")
    merged = saved(merged, "merged")
    everyone = label.select("node", "component").union(touched.filter("new").select("node", "component"))
    now = everyone.join(merged.withColumnRenamed("component", "_now").hint("merge"), everyone.component == merged.was, "left").select("node", F.coalesce("_now", "component").alias("component"))
    return now, merged
