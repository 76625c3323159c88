"""Operator 3, best-fit packing: best-fit decreasing with a segment tree over the remaining capacities.

Best fit depends on lengths alone, and there are at most ``size`` different ones. So the driver packs the histogram of
lengths, a run of equal lengths at a time, and the rows find their places from their rank among pieces of their length:
neither texts nor pieces pass through the driver or one task, and the packing is that of all documents at once.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

SIZE, END_ID = 1024, 2
#: Chunks of text whose ids a task keeps; more begin anew.
CACHE = 400_000
_JOINED = re.compile(r"\s ")
#: Chunks whose letters and marks every library classes alike.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\n]*")
#: A fixed value: the pattern that byte-level vocabularies split texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"



def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: visible ones as they are, the rest from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def quick(rules: dict) -> Callable[[str], list[int]] | None:
    """The same ids from the ``tiktoken`` library, several times as fast; none for vocabularies that it cannot stand for.

    It merges by the merged token's id, so the merges must be in the order of ids.
    """
    import tiktoken

    model, split = rules["model"], rules.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or rules.get("normalizer") or split.get("type") != "ByteLevel":
        return None
    if split["add_prefix_space"] or not split.get("use_regex", True):
        return None
    special = {t["content"] for t in rules.get("added_tokens", [])}
    letters = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Chunks(dict):
    """Ids of chunks met before, each with ``lead`` in front; others are encoded when asked for."""

    def __init__(self, lead: str, slow: Callable[[str], list[int]], fast: Callable[[str], list[int]] | None):
        self.lead, self.slow, self.fast = lead, slow, fast or slow

    def __missing__(self, chunk: str) -> bytes:
        encode = self.fast if _LATIN.fullmatch(chunk) else self.slow
        ids = encode(self.lead + chunk)
        return self.setdefault(chunk, struct.pack(f"<{len(ids)}I", *ids))


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, those of the ``tokenizers`` library.

    The vocabulary's pattern never joins a space to what stands before it, unless that is white space too. So texts
    without spaces after white space are cut before each space, and chunks met before are not encoded again. Texts that
    spell a token that the vocabulary adds, such as an end mark, are encoded whole, as the library reads them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        added = sorted((t["content"] for t in rules.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        slow, fast = self.ids, quick(rules)
        self.first, self.later = Chunks("", slow, fast), Chunks(" ", slow, fast)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _JOINED.search(text) or self.added.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        for known in (self.first, self.later):
            if len(known) > CACHE:
                known.clear()
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than ``size`` if there are more."""
    head = n % size or size
    return [(0, min(n, head)), *((i, size) for i in range(head, n, size))]


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the least capacity of at least some size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # (first bin, how many)

    def put(self, capacity: int, first: int, n: int) -> None:
        self.bins[capacity].append((first, n))
        at = self.leaves + capacity
        while at and not self.tree[at]:
            self.tree[at] = True
            at //= 2

    def take(self, capacity: int) -> tuple[int, int]:
        run = self.bins[capacity].pop()
        at = self.leaves + capacity
        if not self.bins[capacity]:
            self.tree[at] = False
            while at > 1 and not (self.tree[at] or self.tree[at ^ 1]):
                at //= 2
                self.tree[at] = False
        return run

    def tightest(self, length: int) -> int | None:
        """The least capacity >= ``length`` of an open bin."""
        at = self.leaves + length
        while not self.tree[at]:
            while at & 1:  # a right child: go up until there is a right neighbour
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at + (not self.tree[2 * at])
        return at - self.leaves


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts`` pieces of each length: rows (length, from rank, to rank, first bin, offset).

    Pieces of one length come one after another; each goes to the tightest bin that holds it. A bin that has
    taken one is tighter than its like, so it is filled before them: whole runs of bins move at once.
    """
    open_, plan, bins = OpenBins(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = open_.tightest(length)
            if capacity is None:
                capacity, first, n = size, bins, -(-left // (size // length))
                bins += n
            else:
                first, n = open_.take(capacity)
            each = capacity // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = min(left - full * each, each)
            for i in range(each):
                if full:
                    plan.append((length, rank, rank + full, first, size - capacity + i * length))
                    rank += full
            for i in range(rest):
                plan.append((length, rank, rank + 1, first + full, size - capacity + i * length))
                rank += 1
            left -= full * each + rest
            for remaining, at, k in (
                (capacity - each * length, first, full),
                (capacity - rest * length, first + full, int(rest > 0)),
                (capacity, first + full + (rest > 0), n - full - (rest > 0)),
            ):
                if k and remaining:
                    open_.put(remaining, at, k)
    return plan


def pieces(docs: DataFrame, size: int, tokenizer: str | None, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the task and the rank in it among those of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer or default_tokenizer())
        end, task, seen = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId(), np.zeros(size + 1, int)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for i, (start, n) in enumerate(cuts(len(ids) // 4, size)):
                    own = ids[4 * start : 4 * (start + n)]
                    row = (doc_id.as_py(), i, start, n, zlib.crc32(own), task, int(seen[n]), own if with_ids else None)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"],
            )

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long, ids binary"
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)
    return out if with_ids else out.drop("ids")


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and offset: as few sequences as best fit needs.

    A document's ids end with id 2; longer ones than ``size`` are cut. Null text is empty: one piece of the end id.
    Repeated rows are packed each for itself, a null doc_id stays null, more columns are left alone, no rows give no
    rows. ``with_ids`` adds each piece's ids as little-endian 32-bit bytes.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, size, tokenizer, with_ids), "pieces")
    per_task = cut.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # at most `size` rows: one for each length
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan_table(spark, best_fit(counts, size))
    ranked = cut.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("rank"))
    placed = ranked.join(
        F.broadcast(places),  # bounded by `size`, whatever the corpus
        (ranked.length == places.of) & (F.col("rank") >= places.from_rank) & (F.col("rank") < places.to_rank),
    )
    return placed.select(
        *[c for c in cut.columns if c not in ("task", "rank")],
        (F.col("first_bin") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
        "offset",
    )


def plan_table(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(plan, "of long, from_rank long, to_rank long, first_bin long, offset long")
