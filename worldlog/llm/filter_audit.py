"""Operator 13, filter interaction audit: every order of a set of filters, walked as a trie of persisted survivors.

A node of the trie is a sequence of filters already applied; what survives depends on the set of them alone. The walk goes
depth first, holds one persisted table of survivors for each filter on the way down, and counts at every edge what the
next filter removes there. Where another order reaches a set that was met before, its counts stand already. So five
filters take 32 tables of survivors instead of 326, five of them at a time.
"""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, written

SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
SIGNS = r"[#$%&*|]"


def text_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the failures A to E, good and toxic of every row of ``docs`` (doc_id, text, source).

    A: under 200 words; B: under half of the words distinct; C: over 2 % capitals A-Z; D: any of ``#$%&*|``; E: the text
    is that of a row with a smaller doc_id, in the whole table. Null texts are empty: they fail A, and E behind another
    empty one. A null doc_id is neither smaller than any nor has any before it, and no label. Null sources are the empty
    one. A document is good (toxic) if any of its rows in ``labels`` (doc_id, quality, toxic) says 1.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    n_words, n_distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("_text"),
        words.alias("_words"),
    ).select(
        "doc_id",
        "part",
        F.sha2("_text", 256).alias("_same"),
        (n_words < LEAST_WORDS).alias("A"),
        (100 * n_distinct < LEAST_DISTINCT_PERCENT * n_words).alias("B"),
        (100 * F.regexp_count("_text", F.lit("[A-Z]")) > MOST_CAPITALS_PERCENT * F.length("_text")).alias("C"),
        F.col("_text").rlike(SIGNS).alias("D"),
    )
    read = written(read, "verdicts")  # texts are read once; the digest stands for them
    # a text with a third of all rows: its least id is found by partial minima, and the join between written tables is dealt anew where skewed
    least = written(read.groupBy("_same").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most").drop("_most"), "least")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    both = read.join(least, "_same", "left").join(said, "doc_id", "left")
    return both.select(
        "part", "A", "B", "C", "D",
        F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False)).alias("E"),
        (F.coalesce("_good", F.lit(0)) == 1).alias("good"),
        (F.coalesce("_toxic", F.lit(0)) == 1).alias("toxic"),
    )


def _key(prefix: tuple[str, ...]) -> str:
    return "".join(sorted(prefix))


_COUNTS = ("removed", "good_lost", "toxic_lost")


def _walk(verdicts: DataFrame, filters: tuple[str, ...], path: str) -> None:
    """Writes, for every set of filters applied and every part, what each further filter removes from the survivors."""
    met: set[str] = set()
    # the same counts at every edge, so that Spark compiles them once; an applied filter finds nothing more
    counts = [F.count("*").alias("here")]
    for f in filters:
        for name, which in zip(_COUNTS, (F.col(f), F.col(f) & F.col("good"), F.col(f) & F.col("toxic")), strict=True):
            counts.append(F.count_if(which).alias(f"{name}_{f}"))

    def visit(prefix: tuple[str, ...], survivors: DataFrame) -> None:
        state, rest = _key(prefix), [f for f in filters if f not in prefix]
        if not rest or state in met:  # another order came here before: its counts hold for this one
            return
        met.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy("part").agg(*counts).withColumn("state", F.lit(state)).write.mode("append").parquet(path)
        for f in rest:
            visit((*prefix, f), survivors.filter(~F.col(f)))
        survivors.unpersist()

    visit((), verdicts)


def _edges(spark: SparkSession, filters: tuple[str, ...], path: str) -> DataFrame:
    """part, state, next, here and the counts of each edge of the trie."""
    schema = ", ".join(f"{n}_{f} long" for f in filters for n in _COUNTS)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("next"), *(F.col(f"{n}_{f}").alias(n) for n in _COUNTS)) for f in filters)))
    rows = spark.read.schema(f"part string, state string, here long, {schema}").parquet(path)
    return rows.select("part", "state", "here", each.alias("edge")).select("part", "state", "here", "edge.*").filter(~F.contains("state", "next"))


def interactions(verdicts: DataFrame, filters: tuple[str, ...] = ("A", "B", "C", "D", "E")) -> DataFrame:
    """A row for every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``verdicts``: part, a boolean for each filter (true: the row fails), good and toxic. ``redundant`` counts rows that
    fail the step's filter and were removed before it, ``unique_fails`` those that fail it and no other, ``shapley`` what
    the filter removes, summed over all orders. Null verdicts count as passed, null parts as the empty one. Parts
    without a row that fails have zeros; no rows give no rows. The driver sees no counts: they are written, one small
    table for each set of filters, and joined to the orders. Filters are at most six, named by one letter each.
    """
    if len(filters) > 6 or any(len(f) != 1 for f in filters):
        raise ValueError("at most six filters of one letter each")
    spark = verdicts.sparkSession
    plain = verdicts.select(F.coalesce("part", F.lit("")).alias("part"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, "good", "toxic")))
    path = fresh_path(spark, "edges")
    _walk(written(plain, "audit"), filters, path)
    edges = _edges(spark, filters, path)
    # every edge lies on as many orders as there are orders of what is before it and of what is after
    before = F.length("state")
    crossed = F.factorial(before) * F.factorial(len(filters) - 1 - before)
    totals = edges.groupBy("part", "next").agg(
        F.sum(F.col("removed") * crossed).alias("shapley"),
        F.sum(F.when(before == 0, F.col("removed"))).alias("fails"),
        # what fails one filter alone outlives all the others: it is what that filter removes last
        F.sum(F.when(before == len(filters) - 1, F.col("removed"))).alias("unique_fails"),
    )
    orders = " ".join(map("".join, itertools.permutations(filters)))
    every = edges.filter("state = ''").select("part").distinct()
    every = every.select("part", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))  # 120 for five filters
    every = every.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    every = every.withColumns(
        {
            "state": F.array_join(F.array_sort(F.split(F.expr("left(filter_order, step - 1)"), "")), ""),
            "next": F.expr("substring(filter_order, step, 1)"),
        }
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (
        every.join(edges, ["part", "state", "next"], "left")
        .join(totals, ["part", "next"], "left")
        .select(
            "part", "filter_order", "step",
            (zero("here") - zero("removed")).alias("kept"),
            zero("removed").alias("removed"),
            (zero("fails") - zero("removed")).alias("redundant"),
            zero("unique_fails").alias("unique_fails"),
            zero("good_lost").alias("good_lost"),
            zero("toxic_lost").alias("toxic_lost"),
            zero("shapley").alias("shapley"),
        )
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over ``docs`` by source; see ``text_verdicts`` and ``interactions``."""
    return interactions(text_verdicts(docs, labels))
