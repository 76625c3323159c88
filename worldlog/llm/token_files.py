"""Operator 9, token counts: a separator scan over flat token files that have no index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import fresh_path, written

#: End-of-document id and tokens in a block of the scan.
END_ID, BLOCK = 2, 1 << 20
#: Documents in a file that is written here, so that files stay small: a file is scanned in one task.
FILE_DOCS = 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Flat files of little-endian 16-bit ids, each document's followed by id 2, one file for each partition.

    The vocabulary has fewer than 65,536 ids and text never gives id 2. A null text is an empty document. Files are
    written by Spark, to any store it writes; their line separator is the end id. Repeated rows are written each for
    itself, more columns are left alone, no rows give files without ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer or default_tokenizer())
        for batch in batches:
            for at in range(0, len(batch), 500):
                texts = [x.as_py() or "" for x in batch.column(0).slice(at, 500)]
                ids = [np.array(x, "<u2").tobytes() for x in model.encode(texts, num_threads=1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["value"])

    ids = docs.select(F.col("text").cast("string")).mapInArrow(encode, "value binary")
    ids.select(F.col("value").cast("string")).write.option("lineSep", chr(END_ID) + "\0").option("maxRecordsPerFile", FILE_DOCS).text(path)


def blocks_of(spark: SparkSession, path: str, end_id: int, width: int, block: int) -> DataFrame:
    """file, block, n (tokens) and ends (places of end ids in the block) of all token files in ``path``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                buffer = content.as_buffer()
                ids = np.frombuffer(buffer, f"<u{width}", count=len(buffer) // width)
                for i, at in enumerate(range(0, len(ids), block)):
                    part = ids[at : at + block]
                    ends = np.flatnonzero(part == end_id).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.as_py()]),
                            pa.array([i], pa.int32()),
                            pa.array([len(part)], pa.int64()),
                            pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends)),
                        ],
                        names=["file", "block", "n", "ends"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, "file string, block int, n long, ends array<int>")


def count_tokens(
    spark: SparkSession, path: str, end_id: int = END_ID, width: int = 2, block: int = BLOCK
) -> DataFrame:
    """file, ordinal (from 0), start (token of the file), n_tokens (without the end id), closed for each document.

    Blocks are scanned each for itself; a prefix scan over the blocks of a file then tells how many documents and
    tokens stand before a block, and where the document that it begins in was opened. Tokens after the last end id are
    a document that is not ``closed``. Two end ids in a row enclose an empty document. An odd byte at the end of a file
    is no token. Empty files have no document. Files hold at most what an executor can (Spark reads one as one value):
    corpora are written as many files.
    """
    found = written(blocks_of(spark, path, end_id, width, block), "blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    stitched = (
        found.withColumn("base", base)
        .withColumn("seen", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("last_end", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
        .withColumn("open", F.coalesce(F.last("last_end", ignorenulls=True).over(before) + 1, F.lit(0)))
        .withColumn("final", F.lead("block").over(order).isNull())
    )
    closed = stitched.select("file", "seen", "base", "open", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file",
        (F.col("seen") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"),
        F.lit(True).alias("closed"),
    )
    last = F.coalesce(F.col("last_end") + 1, F.col("open"))
    rest = stitched.filter("final").select(
        "file",
        (F.col("seen") + F.size("ends")).alias("ordinal"),
        last.alias("start"),
        (F.col("base") + F.col("n")).alias("stop"),
        F.lit(False).alias("closed"),
    ).filter("stop > start")
    return closed.union(rest).select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        F.col("ordinal").cast("long"),
        F.col("start").cast("long"),
        (F.col("stop") - F.col("start")).cast("long").alias("n_tokens"),
        "closed",
    )


def corpus_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The counts of ``docs`` (text) by way of token files in the shared folder.

    Null and empty texts are documents of no tokens; repeated rows count each for itself; more columns are left alone; no
    rows give no rows. Documents are told by file and ordinal: flat files hold no ids.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return count_tokens(spark, path)
