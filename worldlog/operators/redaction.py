"""Redaction: hidden ids wherever they stand in a text, as a join of candidates with as many ids as there are.

Ids are found by their beginnings: an automaton over these, which are few, goes through each text once and yields the places
where an id may begin; what stands there meets the hidden ids in a join. Neither texts nor ids are held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.operators.graph import saved

HIDDEN = "REDACTED"
#: Ids are also known by their first so many characters.
SHORT_FORMS = (24, 18, 16)
#: Beginnings that a task's automaton holds at most, and their length where that many are not exceeded.
BEGINNINGS, BEGINNING = 100_000, 6


def needles(hidden: DataFrame, visible: DataFrame) -> DataFrame:
    """id: hidden ids, and those of their short forms that no visible id begins with. Both tables: id. All forms meet in one grouping."""
    ids = hidden.select("id").filter("id <> ''")
    longest = ids.agg(F.max(F.length("id"))).first()[0] or 0
    cuts = [n for n in SHORT_FORMS if n < longest]
    form = lambda n, role: F.struct(F.substring("id", 1, n).alias("id"), F.lit(role).alias("role"))
    short = [F.when(F.length("id") > n, form(n, "short")) for n in cuts]
    told = ids.select(F.inline(F.array_compact(F.array(F.struct("id", F.lit("whole").alias("role")), *short))))
    if cuts:
        told = told.union(visible.select(F.inline(F.array(*[form(n, "shared") for n in cuts]))))
    any_ = lambda role: F.bool_or(F.col("role") == role)
    return told.groupBy("id").agg((any_("whole") | any_("short") & ~any_("shared")).alias("_in")).filter("_in").select("id")


def _beginnings(ids: DataFrame) -> list[str]:
    """Beginnings of all ids: as long as their number stays within bounds; of one character at least, and not longer than any id."""
    longest = ids.agg(F.least(F.min(F.length("id")), F.lit(BEGINNING)).alias("n")).first()["n"] or 0
    for n in range(longest, 0, -1):
        found = ids.select(F.substring("id", 1, n).alias("b")).distinct()
        some = (found if n == 1 else found.limit(BEGINNINGS + 1)).collect()  # as many as the bound and one, or as there are characters
        if n == 1 or len(some) <= BEGINNINGS:
            return [r["b"] for r in some]
    return []


def places(rows: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """key, at (code points from 0), length of each of ``ids`` (id) at every place of a text where it stands."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, at int, said string"
    beginnings = _beginnings(ids)
    if not beginnings:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, at int, length int")
    n, most = len(beginnings[0]), ids.agg(F.max(F.length("id"))).first()[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for b in beginnings:
            automaton.add_word(b, len(b))
        automaton.make_automaton()
        for batch in batches:
            of, at, said = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for end, size in automaton.iter(value or ""):
                    start = end - size + 1
                    of.append(i)
                    at.append(start)
                    said.append(value[start : start + most])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), pa.array(said, pa.string())], names=[key, "at", "said"])

    candidates = rows.select(key, F.col(text).cast("string")).mapInArrow(search, schema)
    # which lengths an id of some beginning has: a few for each, and no more rows than the automaton holds
    lengths = F.broadcast(ids.groupBy(F.substring("id", 1, n).alias("_b")).agg(F.collect_set(F.length("id")).alias("_lengths")))
    tried = candidates.withColumn("_b", F.substring("said", 1, n)).join(lengths, "_b").select(key, "at", "said", F.explode("_lengths").alias("length"))
    tried = tried.filter(F.length("said") >= F.col("length")).select(key, "at", "length", F.expr("left(said, length)").alias("id"))
    return tried.join(ids, "id", "left_semi").select(key, "at", "length")


def scrubbed(rows: DataFrame, key: str, text: str, hidden: DataFrame, visible: DataFrame) -> DataFrame:
    """``rows`` with ``text`` in which every hidden id, with its ``@vN``, and every short form of one that no visible id
    shares, reads REDACTED, wherever it stands, within words too; from left to right, the longest first.

    What is searched for is worked out once and written. ``key`` is unique. Null texts stay null; without hidden ids nothing changes. A key that only begins like a hidden id stays.
    """
    found = places(rows, key, text, saved(needles(hidden, visible), "needles"))
    # a place and a length as one number, in order of places and the longest first; no more than a text has places
    by_row = found.groupBy(key).agg(F.sort_array(F.collect_list(F.col("at") * F.lit(_SPAN) + (_SPAN - 1 - F.col("length")))).alias("_found"))
    return rows.join(by_row, key, "left").select(*rows.columns, "_found").mapInArrow(_cut_out(text), rows.schema)


_SPAN = 1 << 32


def _cut_out(text: str):
    """Batches without ``_found``, what it names cut out of ``text``."""
    version = re.compile(r"(?:@v[0-9]+)?")

    def cut(value: str, found: list[int]) -> str:
        parts, done = [], 0
        for place in found:
            at, length = place // _SPAN, _SPAN - 1 - place % _SPAN
            if at >= done:  # places within one already taken are passed over
                parts += value[done:at], HIDDEN
                done = version.match(value, at + length).end()
        return "".join(parts) + value[done:]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(text).to_pylist(), batch.column("_found").to_pylist(), strict=True)
            new = pa.array([cut(value, found) if found else value for value, found in texts], batch.schema.field(text).type)
            names = [n for n in batch.schema.names if n != "_found"]
            yield pa.RecordBatch.from_arrays([new if n == text else batch.column(n) for n in names], names=names)

    return told


def projection(latest: dict[str, tuple[DataFrame, str]], appended: dict[str, tuple[DataFrame, str]], admits: Column, marking: list[str]) -> DataFrame:
    """family, ref, n_versions, record (JSON) of everything that a reader may see of a mission, redacted.

    ``latest``: family to its versions (with ``version``) and its id column, of which the highest counts; ``appended``: families
    whose records stand each for itself. ``admits`` is tested on the marking columns of the version that counts; ids of
    records that it refuses are hidden in every other record, in all fields.
    """
    parts = []
    for family, (df, key) in {**latest, **appended}.items():
        rows = df.withColumn("_ref", F.col(key))
        if family in latest:  # only the version that counts is written out
            rows = rows.groupBy("_ref").agg(F.max_by(F.struct(*df.columns), "version").alias("_now"), F.count("*").alias("n_versions")).select("_ref", "n_versions", "_now.*")
        else:
            rows = rows.withColumn("n_versions", F.lit(1).cast("long"))
        body = F.to_json(F.struct(*[c for c in df.columns if c not in marking]), {"ignoreNullFields": "false"})
        parts.append(rows.select(F.lit(family).alias("family"), F.col("_ref").alias("ref"), "n_versions", body.alias("record"), admits.alias("seen")))
    # numbered as it is written: candidates carry a number instead of a family and an id
    every = saved(reduce(DataFrame.union, parts).withColumn("_no", F.monotonically_increasing_id()), "projection")
    shown = every.filter("seen").drop("seen")
    told = scrubbed(shown, "_no", "record", every.filter("NOT seen").select(F.col("ref").alias("id")), shown.select(F.col("ref").alias("id")))
    return told.drop("_no")
