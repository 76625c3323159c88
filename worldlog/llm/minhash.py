"""Operator 1, MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import written
from .words import Words, mix, runs, slices

BANDS, ROWS = 40, 6
#: Members of a group whose majority makes its core. The core changes how much is compared, never what is found.
CORE_ROWS = 9
#: Pairs whose texts a task holds as copies of its own at a time.
PAIRS = 500


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each row: the sorted distinct hashes of its ``n``-word shingles, and its words joined by one space."""
    for _, part in slices(column):
        words = Words(part, lower=True)
        each = words.hashes()
        shingles = runs(each, n)
        data = words.data.tobytes()
        for a, b in zip(words.rows[:-1], words.rows[1:], strict=True):
            if b - a >= n:
                found = np.unique(shingles[a : b - n + 1])
            elif b > a:  # too few words: the whole sequence is the one shingle
                found = mix(runs(each[a:b], b - a) + np.uint64(b - a))
            else:
                found = each[:0]
            said = data[words.first[a] : words.end[b - 1]] if b > a else b""
            yield found, b" ".join(said.split())


class Signer:
    """One-permutation MinHash of a sorted set of hashes.

    An empty bin takes the value of the first full bin in an order of bins of its own, drawn once for all sets
    (optimal densification: each empty bin draws independently, alike for every set).
    """

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draw = np.random.Generator(np.random.PCG64(seed))
        self.order = np.argsort(draw.random((self.bins, self.bins)), axis=1).astype(np.int32)
        self.weight = draw.integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = draw.integers(0, 2**63, bands, dtype=np.uint64)
        self.edges = np.array([-(-(i << 64) // self.bins) for i in range(self.bins)], dtype=np.uint64)

    def bins_of(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(found, self.edges)
        full = np.diff(np.append(at, len(found))) > 0
        out = found[np.minimum(at, len(found) - 1)]
        if not full.all():
            there = np.flatnonzero(full)
            empty = np.flatnonzero(~full)
            out[empty] = out[there[self.order[empty][:, there].argmin(axis=1)]]
        return out

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """A hash for each band; none of an empty set."""
        if not len(found):
            return np.zeros(0, np.int64)
        bins = mix(self.bins_of(found))
        bands = (bins.reshape(self.bands, self.rows) * self.weight).sum(axis=1, dtype=np.uint64)
        return mix(bands ^ self.salt).view(np.int64)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([*rows, np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(values, pa.int64()))


def signatures(docs: DataFrame, shingle: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (hash of the word sequence; null without words) and buckets of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n_bands, rows)
        for batch in batches:
            sizes, keys, buckets = [], [], []
            for found, said in shingle_sets(batch.column(1), shingle):
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(said) if said else None)
                buckets.append(signer(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    lists(buckets),
                ],
                names=["doc_id", "n_shingles", "key", "buckets"],
            )

    schema = "doc_id long, n_shingles long, key binary, buckets array<long>"
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    ``pairs`` and ``texts`` are written tables, so that both joins are plain shuffles: those of a hub with very many
    partners are dealt to several tasks by the adaptive skew join, each with the hub's text.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PAIRS):
                batch, keep = whole.slice(at, PAIRS), []
                for (x, _), (y, _) in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    with_a = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    with_both = with_a.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; more columns are left alone).

    Texts of one normalised word sequence form a class, which its least doc_id stands for. Of each bucket of class
    representatives, every member is paired with the least; the pairs are confirmed on full shingle sets. Members of a
    bucket that are still apart are then compared by what sets them off from their group's core, exactly: every pair
    that could be a link is confirmed or ruled out by a bound.

    Null or empty texts, and those without words, have no shingle and no link. A null doc_id links with nothing, its
    component_id is null and it is kept. Rows that share a doc_id are one node. No rows give no rows.
    """
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(rows_of, shingle, bands, rows), "signed")
    named = signed.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = named.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    heads = written(classes.filter("n > 1").select("key", "head"), "heads")  # a table: a hot class is dealt to many tasks
    copies = written(named.select("doc_id", "key").join(heads, "key").filter("doc_id <> head").distinct(), "copies")
    alone = named.join(copies.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    buckets = written(alone.select("doc_id", F.explode("buckets").alias("bucket")).distinct(), "buckets")
    links = _links(buckets, rows_of, shingle, percent)
    # copies hang on the head of their class
    found = written(components(links.union(copies.select(F.col("doc_id").alias("a"), F.col("head").alias("b")))), "found")
    return (
        signed.join(found, signed.doc_id == found.node, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _links(buckets: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join all members of a bucket that any chain of links within it joins.

    Stars first: each member of a bucket with its least one. Then buckets whose members are still in several parts: they
    are grouped by that least one, each group has a core of shingles, and members near the core meet the nearest one
    (again a star). What is still apart is paired by shared differences from the core.
    """
    hubs = written(buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    shared = written(buckets.join(hubs.select("bucket", "hub"), "bucket").select("bucket", "doc_id", "hub"), "shared")
    pairs = shared.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    texts = written(docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    links = written(confirmed(written(pairs, "pairs"), texts, shingle, percent), "links")
    label = written(components(links), "label")
    groups = written(_torn(shared, label), "groups")
    apart = written(_differences(groups, texts, shingle, percent), "apart")
    stars = written(_core_stars(apart), "pairs")
    links = links.union(written(confirmed(stars, texts, shingle, percent), "links"))
    label = written(components(links), "label")
    pairs = written(_apart_pairs(_named(apart.drop("part"), label), percent), "pairs")
    return links.union(written(confirmed(pairs, texts, shingle, percent), "links"))


def _named(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, rows.doc_id == label.node, "left").withColumn("part", F.coalesce("component", "doc_id")).drop("node", "component")


def _torn(shared: DataFrame, label: DataFrame) -> DataFrame:
    """hub, doc_id, part of the members of buckets that have members of several components."""
    named = _named(shared, label)
    torn = named.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most")
    return named.join(torn.select("bucket"), "bucket", "left_semi").select("hub", "doc_id", "part").distinct()


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """row (a number of its own), doc_id and grams (hashes of its distinct shingles) of each of ``texts``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(2)):
                grams = [found.view(np.int64) for found, _ in shingle_sets(part, shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, len(grams)) for i in (0, 1)] + [lists(grams)], names=["row", "doc_id", "grams"]
                )

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(cut, "row long, doc_id long, grams array<long>")


def _differences(groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """hub, row, doc_id, part, differs (grams in the set or in the group's core, not in both) and score.

    Sets of n_a and n_b grams that lack d_a and d_b of a core of h grams, and share c of their differences, have
    h - d_a - d_b + c grams in common. They are linked if c reaches (score_a + score_b) / (2 (100 + percent)). This
    holds of any core: it is the grams that most of a few members have, drawn by a hash.
    """
    members = written(sets_of(texts.join(groups.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "sets")
    order = Window.partitionBy("hub").orderBy(F.xxhash64("hub", "doc_id"), "doc_id")
    drawn = groups.select("hub", "doc_id").distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= CORE_ROWS)
    few = drawn.groupBy("hub").agg(F.count("*").alias("few"))
    often = drawn.join(members, "doc_id").select("hub", F.explode("grams").alias("gram")).groupBy("hub", "gram").agg(F.count("*").alias("times"))
    cores = written(often.join(few, "hub").filter("2 * times > few").groupBy("hub").agg(F.collect_set("gram").alias("core")), "cores")
    each = groups.join(members, "doc_id").join(cores, "hub", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    lacks, has = F.array_except("core", "grams"), F.array_except("grams", "core")
    score = 2 * (percent * F.size("grams") + (100 + percent) * F.size("lacks")) - (100 + percent) * F.size("core")
    return (
        each.withColumns({"lacks": lacks, "has": has})
        .select("hub", "row", "doc_id", "part", F.concat("lacks", "has").alias("differs"), score.cast("long").alias("score"))
    )


def _core_stars(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nearest member of each group with those that no shared difference is needed to link to it."""
    nearest = written(apart.groupBy("hub").agg(F.min(F.struct("score", "doc_id", "part")).alias("first")), "nearest")
    met = apart.select("hub", "doc_id", "part", "score").join(nearest, "hub")
    met = met.filter("score + first.score <= 0 AND part <> first.part AND doc_id <> first.doc_id")
    return met.select(F.greatest("doc_id", "first.doc_id").alias("a"), F.least("doc_id", "first.doc_id").alias("b")).distinct()


def _with_other(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of keys that several parts have, with the least score that another part has there as ``other``."""
    by_part = rows.groupBy(*keys, "part").agg(F.min("score").alias("score"))
    two = by_part.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "part"))), 1, 2).alias("two"), F.count("*").alias("parts"))
    two = written(two.filter("parts > 1").drop("parts"), "two")  # a table: a hot key is dealt to many tasks
    return rows.join(two, keys).withColumn("other", F.expr("if(two[0].part = part, two[1].score, two[0].score)")).drop("two")


def _apart_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """All pairs of the members of a group in different parts that can be links, by prefix filtering of differences.

    The differences of a group are ordered alike for all: first those of one part alone, then by how many members have
    them. A link with any other part shares ``need`` of them at least, so one of the first ``room`` of either side: what
    no other part has takes its place there and meets nothing. The first that a link's sides share leaves both with as
    many (``left``) as the link needs: rows that no other part's score can meet with so many left go before they meet,
    and pairs that have fewer left than they need do not become rows. Of the rest shared differences are counted.
    """
    twice = 2 * (100 + percent)
    apart = written(_with_other(apart, ["hub"]), "parted")
    each = apart.select("hub", "row", "part", F.explode("differs").alias("gram"))
    live = each.groupBy("hub", "gram").agg(F.count("*").alias("sets"), F.min("part").alias("least"), F.max("part").alias("most"))
    live = written(live.filter("least <> most").select("hub", "gram", "sets"), "live")
    by_row = each.join(live, ["hub", "gram"]).groupBy("hub", "row").agg(F.array_sort(F.collect_list(F.struct("sets", "gram"))).alias("met"))
    need = F.greatest(F.lit(1), F.ceil((F.col("score") + F.col("other")) / twice))
    heads = (
        apart.select("hub", "row", "doc_id", "part", "score", need.alias("need"), F.size("differs").alias("n"))
        .join(by_row, ["hub", "row"])
        .withColumns({"size": F.size("met"), "room": F.expr("cast(size(met) - need + 1 AS int)")})
        .filter("room > 0")
        .select("hub", "row", "doc_id", "part", "score", "size", F.expr("posexplode(slice(met, 1, room)) AS (at, x)"))
        .select("hub", "row", "doc_id", "part", "score", (F.col("size") - F.col("at")).alias("left"), "x.gram")
    )
    heads = written(heads, "heads")
    able = written(_with_other(heads, ["hub", "gram"]).filter(F.expr(f"score + other <= {twice} * left")).drop("other"), "able")
    side = lambda s: able.select("hub", "gram", *[F.col(c).alias(f"{c}_{s}") for c in ("row", "doc_id", "part", "score", "left")])
    fits = f"part_a <> part_b AND doc_id_a <> doc_id_b AND score_a + score_b <= {twice} * least(left_a, left_b)"
    pairs = side("a").join(side("b"), ["hub", "gram"]).filter(f"row_a < row_b AND {fits}").select("hub", "row_a", "row_b").distinct()
    own = apart.select("hub", "row", "doc_id", "score", "differs")
    mine, theirs = (own.select("hub", *[F.col(c).alias(f"{c}_{s}") for c in own.columns[1:]]) for s in "ab")
    both = written(pairs, "pairs").join(mine, ["hub", "row_a"]).join(theirs, ["hub", "row_b"])
    found = both.filter(F.size(F.array_intersect("differs_a", "differs_b")) * twice >= F.col("score_a") + F.col("score_b"))
    return found.select(F.greatest("doc_id_a", "doc_id_b").alias("a"), F.least("doc_id_a", "doc_id_b").alias("b")).distinct()


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies in ``docs``: the one of the least doc_id, with all its columns.

    Rows without a doc_id link with nothing and stay; rows that share a doc_id are one node and stay together.
    """
    gone = near_duplicates(docs, shingle, percent).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
