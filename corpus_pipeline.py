"""The corpus pipeline: toxicity, near-dedup, decontamination and personal data over documents, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; the last returns packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog.llm import decontam, minhash, packing, pii, store, toxicity

#: The pipeline ends in a segment tree, and its first stage in a trained model: SQL expresses neither.
ORACLE_SQL = None


def _nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labelled ones among ``docs``, does not call toxic; all their columns.

    Null and empty texts have no telling word and stay, unless the limit takes a text without any; a null doc_id has no label and is judged by its text; repeated rows
    are judged each for itself and alike. Labels may repeat or be null; further columns are kept, whatever their names.
    Without documents, or without labels of both kinds, there is nothing to learn from and all stay.
    """
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least doc_id; five-word shingles, similarity of 0.8 or more.

    Texts without words are like nothing and stay; shorter ones than five words are one shingle. Rows without a doc_id link with
    nothing and stay; rows that share a doc_id stay or go together. No documents give none; all columns are kept.
    """
    return minhash.without_near_duplicates(docs, shingle=5, percent=80)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; all their columns.

    Null and empty texts contain nothing and stay, null and empty items are contained in nothing. A document goes as a whole,
    and so do all rows of its doc_id; rows without one go together if any of them contains an item. No documents, or no items:
    nothing changes.
    """
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data masked by its kind; ``n_chars`` follows the text where there is such a column.

    Null texts stay null, repeated rows are masked each for itself and alike, ids and further columns stay as they are.
    """
    found = pii.detect(docs).drop("pii_spans")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: each piece's place and ids, doc_id and what ``packing.pack`` adds, no other column.

    Null texts are one piece of the end id; a null doc_id stays null; repeated rows are packed each for itself; texts longer than a
    sequence are cut; no documents give no pieces.
    """
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", _nontoxic),
    ("near_duplicates", _distinct),
    ("decontamination", _clean),
    ("personal_data", _masked),
    ("packing", _packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of the table ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
