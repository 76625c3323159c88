"""Operator 4, document fingerprints: a Merkle tree over phrases, paragraphs and sections, in SQL functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A leaf: up to four words of a line with the white space around them. Leaves make up the whole text.
LEAF = r"(?:[^\S\n]*+\S++[^\S\n]*+){1,4}\n?|[^\S\n]*+\n|[^\S\n]++"
#: Rows of a run of neighbouring ids, about, and runs that are few enough to broadcast.
RUN_ROWS, BROADCAST_RUNS = 250, 200_000


def fingerprint(text: Column) -> Column:
    """Root, a colon, and the leaves' hashes: commas within a paragraph, ``;`` after it, ``|`` after a section.

    A paragraph is a line. A section ends with a paragraph whose last hash begins a new one by chance (one in eight),
    so that edits move no boundary but their own. Paragraphs hash their leaves, sections their paragraphs, the root
    its sections: equal texts have equal roots, and unlike branches show where others differ.
    """
    leaves = F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))
    marked = F.array_join(
        F.transform(leaves, lambda x: F.concat(F.substring(F.md5(x), 1, 12), F.when(F.endswith(x, F.lit("\n")), ";").otherwise(","))),
        "",
    )
    return F.regexp_replace(marked, "(?<=[01]);", "|")


def rooted(leaves: Column) -> Column:
    sections = F.transform(
        F.split(leaves, r"\|"),
        lambda s: F.md5(F.array_join(F.transform(F.split(s, ";"), lambda p: F.md5(p)), "")),
    )
    return F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), leaves)


def leaves_of(print_: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.substring_index(print_, ":", -1), "[,;|]"), ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the nodes in both over the nodes of each, where the distinct leaves and the root count: 0 to 1.

    Unlike roots are never wholly alike, whatever leaves they share in whatever order; equal texts, empty ones too, are.
    """
    x, y = leaves_of(a), leaves_of(b)
    both = F.size(F.array_intersect(x, y)) + (a == b).cast("int")
    return 2.0 * both / (F.size(x) + F.size(y) + 2)


def differing(a: Column, b: Column) -> Column:
    """Numbers from 0 of the paragraphs of ``a`` that ``b`` does not have: where the first was edited."""
    mine, theirs = (F.array_remove(F.split(F.substring_index(x, ":", -1), "[;|]"), "") for x in (a, b))
    at = F.transform(mine, lambda p, i: F.when(F.array_contains(theirs, p), -1).otherwise(i))
    return F.array_remove(at, -1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` of the whole ``text``; null text counts as empty. All rows and columns stay."""
    leaves = docs.withColumn("fingerprint", fingerprint(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return leaves.withColumn("fingerprint", rooted(F.col("fingerprint")))


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (key: long, tie, ...) with the next row by descending key as ``next``; the first comes after the last.

    Ids that share their high bits form a run; each run is ordered by itself. The head of a run also visits the run
    above it, where it stands last: rows move once, and nothing is ordered in one task.
    """
    n, least, most = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if not n:
        return rows.withColumn("next", F.struct(*rows.columns))
    shift = max(0, int(math.log2(max(1, (most - least + 1) / n * RUN_ROWS))))
    while True:
        run = F.expr(f"shiftright(key, {min(shift, 63)})")
        heads = rows.groupBy(run.alias("run")).agg(F.max("key").alias("head"), F.count("*").alias("n"))
        largest, count = heads.agg(F.max("n"), F.count("*")).first()
        if largest <= 4 * RUN_ROWS or not shift:
            break
        shift = max(0, shift - 4)
    if count > BROADCAST_RUNS:  # ids in many small runs: their heads are put in order alike
        down = with_next(heads.select(F.col("run").alias("key"), F.lit(0).alias("tie"), "head"))
        above = down.select(F.col("next.head").alias("head"), F.col("key").alias("to"))
    else:
        lowest = heads.agg(F.min("run")).first()[0]
        order = Window.orderBy("run")  # at most BROADCAST_RUNS rows
        above = heads.select("head", F.coalesce(F.lead("run").over(order), F.lit(lowest)).alias("to"))
    hint = F.broadcast(above) if count <= BROADCAST_RUNS else above
    seen = rows.join(hint.withColumnRenamed("head", "_head"), F.col("key") == F.col("_head"), "left").withColumn("run", run)
    both = F.when(F.col("to").isNull(), F.array(F.struct(F.col("run"), F.lit(False).alias("visits")))).otherwise(
        F.array(F.struct(F.col("run"), F.lit(False).alias("visits")), F.struct(F.col("to").alias("run"), F.lit(True).alias("visits")))
    )
    placed = seen.select(*rows.columns, F.explode(both).alias("place")).select(*rows.columns, "place.*")
    line = Window.partitionBy("run").orderBy("visits", F.desc("key"), "tie")
    following = placed.withColumn("next", F.lead(F.struct(*rows.columns)).over(line))
    return following.filter("NOT visits").drop("run", "visits")


def compared(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document by descending doc_id.

    The edited text has its last half replaced by as many code points (or all) of the next document's beginning.
    Null text is empty, a null doc_id comes last, rows of one doc_id stand in the order of a hash of their text, more
    columns are left alone, no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # rows without an id stand below all others, spread over many runs
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)) + F.pmod(F.xxhash64(text), F.lit(2**40))).alias("key"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )
    chained = with_next(rows)  # texts move; fingerprints, which do not compress, are made where they have arrived
    n, half = F.length("text"), F.expr("cast(floor(length(text) / 2) as int)")
    edited = chained.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("text"),
        fingerprint(F.col("text")).alias("own"),
        fingerprint(F.col("next.text")).alias("next"),
    ).withColumns({"own": rooted(F.col("own")), "next": rooted(F.col("next"))})
    done = fingerprints(edited).withColumnsRenamed({"fingerprint": "edited_fingerprint", "own": "fingerprint"})
    own, changed = F.col("fingerprint"), F.col("edited_fingerprint")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(own, changed).alias("near_edited"),
        likeness(own, F.col("next")).alias("near_next"),
        F.array_join(differing(own, changed), ",").alias("edited_paragraphs"),
    )
