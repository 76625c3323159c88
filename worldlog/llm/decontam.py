"""Operator 8, benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

SQL functions alone. A window can be like an item only if the two share a shingle. So windows are taken where a document
has a shingle of an item: as long as the item, placed so that the shared shingles coincide, and everywhere between two such
places. If all shingles that a window shares coincide to its right, its first word is in none of them: one step to the right
loses nothing, and so to the left. The likest window therefore lies at such a place or between two of them, and these are
no farther apart than the threshold lets windows of the item's length be (``gap``). Words are lower-case runs of letters and digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

SHINGLE, LEAST = 5, 0.8
#: Bits in which fingerprints of a window and an item may differ; in one of RADIUS + 1 blocks they are then alike.
#: A similarity of 0.8 turns at most 10 of 64 bits on average, give or take 3: the radius lies over 3 standard errors above.
BITS, RADIUS = 64, 20
#: Item shingles are broadcast up to so many (16 bytes each); beyond, documents' shingles are shuffled to them.
BROADCAST_SHINGLES = 2_000_000
#: The root of a weight as a whole number: sums do not hang on their order.
ROOT = "cast(round(sqrt(v) * 1000) AS long)"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(k: int) -> Column:
    """Hashes of the ``k``-word shingles of the column ``w`` by their place; none of texts with fewer words."""
    parts = ", ".join(f"get(w, i + {j})" for j in range(k))
    return F.expr(f"transform(if(size(w) < {k}, array(), sequence(0, size(w) - {k})), i -> xxhash64({parts}))")


def simhash(shingle: str, weight: str) -> list[Column]:
    """One aggregate for each of 64 bits: the weights of shingles with the bit less those of shingles without it."""
    return [F.expr(f"sum(if(shiftright({shingle}, {b}) & 1 = 1, {weight}, -{weight}))").alias(f"side{b}") for b in range(BITS)]


def signs(names: tuple[str, ...] = tuple(f"side{b}" for b in range(BITS))) -> Column:
    """The fingerprint: the bits whose side weighs more."""
    return F.expr(" | ".join(f"if({c} > 0, shiftleft(1L, {b}), 0L)" for b, c in enumerate(names)))


def blocks(bits: Column) -> Column:
    """The fingerprint's ``RADIUS + 1`` blocks, each with its number."""
    edges = [round(i * BITS / (RADIUS + 1)) for i in range(RADIUS + 2)]
    parts = [
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(bits, a).bitwiseAND((1 << (b - a)) - 1).alias("bits"))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.array(*parts)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its key), w (words), n, k (words of its shingles: fewer than five only where it has fewer)."""
    named = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).distinct()
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "w"))
    return named.filter("n > 0").withColumns({"k": F.least("n", F.lit(SHINGLE)), "item": key})


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the likest window of each document to each item it contains.

    Similarity is the weight of shared distinct shingles over that of all: a shingle weighs one plus the logarithm of
    the number of items over that of items with it. Of windows alike the first counts. Rows that share a doc_id are
    one document, a null doc_id is an id like others. Null and empty texts and items have no window; an item of fewer
    than five words is one shingle. Items of one id and text are one; more columns are left alone; no rows give no rows.
    """
    items = items_of(benchmark)
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # five at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("key"), words(text).alias("w"))
    found = None
    for k in sorted(sizes):
        part = _of_size(texts, items.filter(F.col("k") == k), k, least)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in RESULT])
    return found


RESULT = (("item_id", "long"), ("start", "int"), ("n_words", "int"), ("similarity", "double"))


def _of_size(texts: DataFrame, items: DataFrame, k: int, least: float) -> DataFrame:
    total = items.agg(F.count("*").cast("double")).first()[0]
    each = items.select("item", "item_id", "n", F.explode(F.array_distinct(shingles(k))).alias("s"))
    unseen = float(1 + math.log(total))
    rare = each.groupBy("s").agg((1 + F.log(F.lit(total) / F.count("*"))).alias("v"))
    # where an item of n words has a shingle
    spots = items.select("n", F.posexplode(shingles(k)).alias("at", "s")).distinct()
    hint = F.broadcast if spots.count() <= BROADCAST_SHINGLES else (lambda x: x)
    windows = written(_windows(texts, hint(spots), k, least, unseen), "windows")
    # windows of one text need one fingerprint, however many documents have it
    said = windows.groupBy("n", "wid").agg(F.min("said").alias("said")).withColumn("w", F.split("said", " "))
    hashed = written(said.select("n", "wid", F.array_distinct(shingles(k)).alias("h")), "hashed")
    weighed = hashed.select("n", "wid", F.explode("h").alias("s")).join(hint(rare), "s", "left")
    weighed = weighed.select("n", "wid", "s", F.coalesce("v", F.lit(unseen)).alias("v"))
    # with roots of the weights, the angle between two fingerprints follows from their weighted similarity alone
    mine = weighed.withColumn("r", F.expr(ROOT)).groupBy("n", "wid").agg(*simhash("s", "r"), F.sum("v").alias("own"))
    theirs = each.join(hint(rare), "s").withColumn("r", F.expr(ROOT)).groupBy("item", "item_id", "n").agg(*simhash("s", "r"), F.sum("v").alias("own"))
    left = mine.select("n", "wid", "own", signs().alias("bits")).select("*", F.explode(blocks(F.col("bits"))).alias("block"))
    right = theirs.select(
        F.col("n").alias("item_n"), "item", "item_id", F.col("own").alias("item_own"), signs().alias("item_bits")
    ).select("*", F.explode(blocks(F.col("item_bits"))).alias("item_block"))
    near = left.join(
        hint(right), F.expr(f"n = item_n AND block = item_block AND bit_count(bits ^ item_bits) <= {RADIUS}")
    ).groupBy("n", "wid", "item", "item_id").agg(F.min("own").alias("own"), F.min("item_own").alias("item_own"))
    shared = (
        near.join(hashed, ["n", "wid"])
        .select("n", "wid", "item", "item_id", "own", "item_own", F.explode("h").alias("s"))
        .join(hint(each.select("item", "s")), ["item", "s"])
        .join(hint(rare), "s")
        .groupBy("n", "wid", "item", "item_id", "own", "item_own")
        .agg(F.sum("v").alias("both"))
    )
    alike = F.round(F.col("both") / (F.col("own") + F.col("item_own") - F.col("both")), 9)
    like = shared.select("n", "wid", "item_id", alike.alias("similarity")).filter(F.col("similarity") >= least)
    best = windows.join(like, ["n", "wid"]).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("b")
    )
    return best.select(
        "doc_id",
        F.col("item_id").cast("long"),
        (-F.col("b.back")).cast("int").alias("start"),
        F.col("b.n").cast("int").alias("n_words"),
        F.col("b.similarity").alias("similarity"),
    )


def _windows(texts: DataFrame, spots: DataFrame, k: int, least: float, most_weight: float) -> DataFrame:
    """doc_id, n, start, said, wid (its hash): the windows of ``texts`` (doc_id, key, w) at shingles of ``spots``.

    The shingles meet the items' without the words; of documents that have none of them, the words do not move at all.
    Places g words apart leave g of the window's n - k + 1 shingles that the item has not. They weigh 1 at least, what is
    shared ``most_weight`` at most, and may be (1 - least) / least of what is shared.
    """
    x = (1 - least) / least * most_weight
    gap = F.expr(f"cast(floor((n - {k - 1}) * {x / (1 + x)}) as int)")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("size") - F.col("n")))
    hits = (
        texts.select("doc_id", "key", F.size("w").alias("size"), F.posexplode(shingles(k)).alias("pos", "s"))
        .join(spots, "s")
        .select("doc_id", "key", "n", start.alias("start"))
        .distinct()
    )
    hits = written(hits, "hits")
    some = hits.groupBy("doc_id", "key", "n").agg(F.array_sort(F.collect_list("start")).alias("at")).withColumn("gap", gap)
    filled = "transform(at, (x, i) -> if(get(at, i + 1) - x <= gap, sequence(x, at[i + 1] - 1), array(x)))"
    every = some.select("doc_id", "key", "n", F.explode(F.flatten(F.expr(filled))).alias("start"))
    places = every.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(
        F.collect_list(F.struct("n", "start")).alias("places")
    )
    found = texts.join(places, texts.doc_id.eqNullSafe(F.col("of")) & (texts.key == F.col("of_key")))
    said = F.expr("transform(places, p -> struct(p.n, p.start, array_join(slice(w, p.start + 1, p.n), ' ') AS said))")
    each = found.select("doc_id", F.inline(said))
    return each.withColumn("wid", F.md5("said"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without those that contain an item; rows without an id stay only if no such row contains one."""
    bad = contaminated(docs, benchmark, least).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["_bad"]), "left_anti")
