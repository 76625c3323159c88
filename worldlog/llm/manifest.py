"""Operator 12, Merkle dataset manifest: blocks reduced by executors, a small upper tree by the driver, its paths broadcast.

Rows of a part, in the order of their key, are the leaves of a tree; the parts' roots, in the order of the parts, are the
leaves of the tree above. Executors reduce aligned blocks of ``BLOCK`` leaves to one node each, and blocks of such
nodes again, until at most ``TOP`` nodes are left, however many rows there are. The driver builds the tree over these and
broadcasts each one's path to the root; executors put the paths of their blocks before them and fold every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from .store import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that one parent takes, levels that one block spans, and nodes that the driver holds at most.
FAN, LEVELS, TOP = 2, 10, 4096


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str], fan: int, levels: int | None) -> tuple[str, list[list[str]]]:
    """The node that is left, and each node's path: what stands left and right of it in its run, level by level.

    ``levels`` is how many to climb; None climbs until one node is left. The last run may be short: a node alone is
    hashed by itself.
    """
    paths: list[list[str]] = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    done = 0
    while len(nodes) > 1 if levels is None else done < levels:
        above, over = [], []
        for at in range(0, len(nodes), fan):
            run = nodes[at : at + fan]
            for k in range(len(run)):
                left, right = "".join(run[:k]), "".join(run[k + 1 :])
                for leaf in under[at + k]:
                    paths[leaf] += (left, right)
            above.append(H(*run))
            over.append([leaf for members in under[at : at + fan] for leaf in members])
        nodes, under, done = above, over, done + 1
    return nodes[0], paths


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = H(left, leaf, right)
    return leaf


def leaf(fields: dict[str, F.Column]) -> F.Column:
    """The digest of a row: each field as its count of UTF-8 bytes, a colon and its text; a null one as a hyphen."""
    said = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (part, ..) with ``pos``, their place in their part by ``order``, from 0, and ``total``, their part's size.

    One sort by ranges, in which a part may span many tasks; then only counts of each part in each task are added up.
    """
    by = ["part", *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    # equal rows may stand in any order, but a place is given once: the sorted rows are written with it
    ranked = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn("_task", F.shiftright("_at", 33))
    counts = ranked.groupBy("part", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("part")
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    return ranked.join(counts, ["part", "_task"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_task", "_first", "_before", "_at")


def _blocks(nodes: DataFrame, fan: int, levels: int, keep: list[str]) -> DataFrame:
    """Aligned blocks of nodes (part, pos, total, hash, ..): part, block, total of blocks, members in order, head."""
    size = fan**levels
    grouped = nodes.groupBy("part", F.floor(F.col("pos") / size).cast("long").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "hash", *keep))).alias("members"),  # at most `size`
        F.first("total").alias("under"),
    )
    grouped = grouped.select("part", "pos", F.ceil(F.col("under") / size).cast("long").alias("total"), "members")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("members")
            heads = []
            for i in range(len(batch)):
                own = hashes.slice(i, 1).flatten().field("hash").to_pylist()
                heads.append(climb(own, fan, None if batch.column("total")[i].as_py() == 1 else levels)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.string())], names=[*batch.schema.names, "hash"])

    return written(grouped.mapInArrow(head, StructType([*grouped.schema.fields, StructField("hash", StringType())])), "blocks")


def _lifted(nodes: DataFrame, fan: int, levels: int, top: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rounds of blocks until at most ``top`` nodes are left, or one of each part."""
    rounds: list[DataFrame] = []
    while nodes.filter("total > 1").limit(1).count() and nodes.limit(top + 1).count() > top:
        rounds.append(_blocks(nodes, fan, levels, []))
        nodes = rounds[-1].select("part", "pos", "total", "hash")
    return nodes, rounds


def _lowered(rounds: list[DataFrame], paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """Paths (part, pos, subroot, root, path) of the nodes below, round by round."""
    for blocks in reversed(rounds):
        paths = _under(blocks, paths, fan, levels, "part string, pos long, subroot string, root string, path array<string>", lambda part, member, subroot, root, path: (part, member["at"], subroot, root, path))
    return paths


def _under(blocks: DataFrame, paths: DataFrame, fan: int, levels: int, schema: str, row) -> DataFrame:
    """A row for each member of each block, from its own path with its block's path after it."""
    both = blocks.drop("hash").join(paths, ["part", "pos"]).select("part", "total", "members", "subroot", "root", "path")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part, total, members, subroot, root, suffix = (c[i].as_py() for c in batch.columns)
                head, own = climb([m["hash"] for m in members], fan, None if total == 1 else levels)
                out = [row(part, m, subroot or head, root, [*path, *suffix]) for m, path in zip(members, own, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return both.mapInArrow(finish, schema)


def _upper(nodes: list, fan: int) -> list[tuple]:
    """The driver's tree over a few nodes (part, pos, hash): (part, pos, subroot, root, path) of each."""
    parts: dict[str, list] = {}
    for n in sorted(nodes, key=lambda n: (n["part"].encode(), n["pos"])):
        parts.setdefault(n["part"], []).append(n["hash"])
    if not parts:
        return []
    trees = {part: climb(hashes, fan, None) for part, hashes in parts.items()}
    root, above = climb([subroot for subroot, _ in trees.values()], fan, None)
    return [
        (part, pos, subroot, root, [*path, *over])
        for (part, (subroot, paths)), over in zip(trees.items(), above, strict=True)
        for pos, path in enumerate(paths)
    ]


def _paths(nodes: DataFrame, fan: int, levels: int, top: int) -> DataFrame:
    """The path of every node (part, pos, total, hash) to the root of all parts."""
    spark = nodes.sparkSession
    schema = "part string, pos long, subroot string, root string, path array<string>"
    left, rounds = _lifted(nodes, fan, levels, top)
    if left.limit(top + 1).count() <= top:
        # at most `top` rows, each of two digests for each level of their tree
        paths = F.broadcast(spark.createDataFrame(_upper(left.collect(), fan), schema))
    else:  # more parts than the driver may hold: their roots are the leaves of one more tree, reduced likewise
        parts = _placed(left.select(F.lit("").alias("part"), F.col("part").alias("_name"), "hash"), ["_name"])
        above = _paths(parts.select("part", "pos", "total", "hash"), fan, levels, top)
        named = parts.select("pos", "_name", "hash").join(above.drop("part", "subroot"), "pos")
        paths = named.select(F.col("_name").alias("part"), F.lit(0).cast("long").alias("pos"), F.col("hash").alias("subroot"), "root", "path")
    return _lowered(rounds, paths, fan, levels)


def audited(
    rows: DataFrame,
    observed: dict[str, F.Column] | None = None,
    fields: tuple[str, ...] = FIELDS,
    part: str = "lang",
    key: str = "doc_id",
    fan: int = FAN,
    levels: int = LEVELS,
    top: int = TOP,
) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row: the manifest, and rows held against it.

    ``observed`` names fields whose values are now others than those that the manifest was made of (columns over
    ``rows``); ``folded_root`` is folded from the leaf of the observed row along the recorded siblings, and ``verified``
    says whether it is the root. Parts are ordered null first, then bytewise; rows by key, null first; rows of equal
    keys by their leaves. Equal rows have equal leaves, and it is open which takes which place. Null fields count as a
    hyphen, a single row is its own subroot and root with the proof of no siblings, no rows give no rows. Columns that are
    not among ``fields`` take no part.
    """
    current = {f: (observed or {}).get(f, F.col(f)) for f in fields}
    # a part's name with a digit before it, so that null is a value and comes first
    name = F.when(F.col(part).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(part).cast("string")))
    recorded = leaf({f: F.col(f) for f in fields})
    leaves = written(rows.select(name.alias("part"), F.col(key).alias("_key"), recorded.alias("hash"), (leaf(current) if observed else recorded).alias("seen")), "leaves")
    kind = leaves.schema["_key"].dataType.simpleString()
    # the sort reads keys and digests alone; texts were read once
    blocks = _blocks(_placed(leaves, ["_key", "hash"]), fan, levels, ["_key", "seen"])
    paths = _paths(blocks.select("part", "pos", "total", "hash"), fan, levels, top)

    def proven(part: str, member: dict, subroot: str, root: str, path: list[str]) -> tuple:
        folded = fold(member["seen"], path)
        return member["_key"], member["hash"], subroot, root, H(*path), folded, folded == root

    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _under(blocks, paths, fan, levels, schema, proven)
