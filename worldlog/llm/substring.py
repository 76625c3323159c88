"""Operator 6, substring dedup: windows travel as super-k-mers to the bucket of their minimiser, where sorting counts them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import Words, runs, slices

WINDOW = 50
#: Words of the m-mers of which a window's least hash is its minimiser.
MER = 10
#: Minimisers of more windows are not sorted in one bucket: their windows are grouped by a 128-bit hash, in many tasks.
HOT = 40_000


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(hashes: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word and number of windows of each run of windows that share a minimiser."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    least = least_of(runs(hashes, mer), window - mer + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first].view(np.int64), first.astype(np.int32), np.diff(np.append(first, len(least))).astype(np.int32)


def scanned(docs: DataFrame, window: int, mer: int) -> DataFrame:
    """Of each row of doc_id, text_key, text: n_words, whole_sha256 and its super-k-mers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, found = [], [], []
            for _, part in slices(batch.column(2)):
                words = Words(part)
                hashes, data = words.hashes(), words.data.tobytes()
                for a, b in zip(words.rows[:-1], words.rows[1:], strict=True):
                    said = data[words.first[a] : words.end[b - 1]].split() if b > a else []
                    sizes.append(len(said))
                    shas.append(hashlib.sha256(b" ".join(said)).hexdigest())
                    found.append(super_kmers(hashes[a:b], window, mer))
            ends = pa.array(np.cumsum([0, *[len(x[0]) for x in found]]), pa.int32())
            flat = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*[x[i] for x in found], np.zeros(0, t)]), kind))
                for i, t, kind in ((0, np.int64, pa.int64()), (1, np.int32, pa.int32()), (2, np.int32, pa.int32()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), *flat],
                names=["doc_id", "text_key", "n_words", "whole_sha256", "minimiser", "first", "n"],
            )

    return docs.mapInArrow(
        scan,
        "doc_id long, text_key long, n_words long, whole_sha256 string,"
        " minimiser array<long>, first array<int>, n array<int>",
    )


def packed(texts: DataFrame, window: int) -> DataFrame:
    """The super-k-mers ``wanted`` of each text as packed strings: one row for each string of a batch.

    sid (128-bit hash), minimiser, hot, said, owner (least doc_id), places (doc_id, text_key, first).
    """
    place = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                rows: dict[bytes, list] = {}
                for doc_id, key, text, wanted in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                    words = text.encode().split()
                    for s in wanted:
                        said = b" ".join(words[s["first"] : s["first"] + s["n"] + window - 1])
                        row = rows.setdefault(said, [s["minimiser"], s["hot"], doc_id, []])
                        row[2] = min(row[2], doc_id)
                        row[3].append({"doc_id": doc_id, "text_key": key, "first": s["first"]})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(x) for x in rows], pa.binary()),
                        pa.array([r[0] for r in rows.values()], pa.int64()),
                        pa.array([r[1] for r in rows.values()], pa.bool_()),
                        pa.array(list(rows), pa.binary()),
                        pa.array([r[2] for r in rows.values()], pa.int64()),
                        pa.array([r[3] for r in rows.values()], pa.list_(place)),
                    ],
                    names=["sid", "minimiser", "hot", "said", "owner", "places"],
                )

    return texts.select("doc_id", "text_key", "text", "wanted").mapInArrow(
        pack,
        "sid binary, minimiser long, hot boolean, said binary, owner long,"
        " places array<struct<doc_id:bigint,text_key:bigint,first:int>>",
    )


def windows_of(said: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, each as the bytes of its words."""
    gaps = np.flatnonzero(np.frombuffer(said, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(said)]])
    return [said[a:b] for a, b in zip(starts[: len(starts) - window + 1], ends[window - 1 :], strict=True)]


def owner_runs(owners: list[int]) -> list[dict]:
    return [{"n": len(list(g)), "owner": k} for k, g in groupby(owners)]


_RUNS = "array<struct<n:int,owner:bigint>>"


def sorted_buckets(strings: DataFrame, window: int) -> DataFrame:
    """(sid, runs): for each packed string, the least doc_id that has each of its windows, as runs of equal ones.

    ``strings`` come sorted by minimiser: a bucket is held at a time, its windows are sorted, equal ones counted off.
    """
    run = pa.list_(pa.struct([("n", pa.int32()), ("owner", pa.int64())]))

    def solve(bucket: dict[bytes, list]) -> list[tuple[bytes, list[dict]]]:
        split = [windows_of(said, window) for said in bucket]
        owners = [owner for _, owner in bucket.values()]
        every = sorted((w, owners[i], i, j) for i, some in enumerate(split) for j, w in enumerate(some))
        least = [[0] * len(some) for some in split]
        for _, same in groupby(every, key=lambda x: x[0]):
            owner = None
            for _, own, i, j in same:  # the first has the least owner
                owner = own if owner is None else owner
                least[i][j] = owner
        return [(sid, owner_runs(own)) for (sid, _), own in zip(bucket.values(), least, strict=True)]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, {}
        for batch in batches:
            out = []
            for sid, minimiser, said, owner in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if minimiser != now:
                    out += solve(bucket)
                    now, bucket = minimiser, {}
                row = bucket.setdefault(said, [sid, owner])
                row[1] = min(row[1], owner)
            yield _rows(out, run)
        yield _rows(solve(bucket), run)

    return strings.mapInArrow(buckets, f"sid binary, runs {_RUNS}")


def _rows(out: list[tuple[bytes, list[dict]]], run: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], run)], names=["sid", "runs"]
    )


def hot_windows(strings: DataFrame, window: int) -> DataFrame:
    """(sid, runs) of strings whose minimiser is too frequent for one bucket: windows meet by hash, in many tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, said, owner in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                ids = [xxhash.xxh3_128_digest(w) for w in windows_of(said, window)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([sid] * len(ids), pa.binary()),
                        pa.array(range(len(ids)), pa.int32()),
                        pa.array(ids, pa.binary()),
                        pa.array([owner] * len(ids), pa.int64()),
                    ],
                    names=["sid", "i", "wid", "owner"],
                )

    distinct = strings.groupBy("sid").agg(F.min("owner").alias("owner"), F.min("said").alias("said"))
    each = written(
        distinct.select("sid", "said", "owner").mapInArrow(split, "sid binary, i int, wid binary, owner long"), "hot"
    )
    least = each.groupBy("wid").agg(F.min("owner").alias("least"))
    by_string = each.join(least, "wid").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("w"))
    return by_string.select("sid", F.expr("transform(w, x -> struct(1 AS n, x.least AS owner))").alias("runs"))


def without_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row (doc_id, text): repeated windows are cut out.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. kept_text is null where nothing goes: the text as it is then stays. Null, empty and
    short texts have no window. Rows with a null doc_id keep all and take nothing from others; rows that share a doc_id
    take nothing from each other. Repeated rows stay; more columns are left alone; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    scan = written(scanned(rows, window, mer), "scan")
    each = scan.filter("doc_id IS NOT NULL").select(
        "doc_id", "text_key", F.explode(F.arrays_zip("minimiser", "first", "n")).alias("s")
    ).select("doc_id", "text_key", "s.*")
    shared = (
        each.groupBy("minimiser")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n").alias("times"))
        .filter("least < most")
        .select("minimiser", (F.col("times") > hot).alias("hot"))
    )
    wanted = (
        each.join(shared, "minimiser")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("first", "n", "minimiser", "hot")).alias("wanted"))
    )
    texts = written(rows.join(wanted, ["doc_id", "text_key"]), "texts")
    strings = written(packed(texts, window), "strings")
    cold = strings.filter("NOT hot").select("sid", "minimiser", "said", "owner")
    bucketed = cold.repartition("minimiser").sortWithinPartitions("minimiser")
    solved = sorted_buckets(bucketed, window).union(hot_windows(strings.filter("hot"), window))
    places = strings.select("sid", F.explode("places").alias("p")).select("sid", "p.*")
    cut = (
        places.join(solved, "sid")
        .filter("exists(runs, r -> r.owner < doc_id)")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("first", "runs")).alias("cuts"))
    )
    left = kept(texts.select("doc_id", "text_key", "text").join(cut, ["doc_id", "text_key"]), window)
    left = left.dropDuplicates(["doc_id", "text_key"])
    return scan.join(left, ["doc_id", "text_key"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        "kept_text",
    )


def kept(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, n_removed, kept_sha256, kept_text of texts with their ``cuts``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, left = [], [], []
            for doc_id, text, cuts in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words), bool)
                for c in cuts:
                    at = c["first"]
                    for r in c["runs"]:
                        if r["owner"] < doc_id:
                            gone[at : at + r["n"] + window - 1] = True
                        at += r["n"]
                said = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(said).hexdigest())
                left.append(said)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(removed, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "text_key", "n_removed", "kept_sha256", "kept_text"],
            )

    return texts.select("doc_id", "text_key", "text", "cuts").mapInArrow(
        cut, "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string"
    )
