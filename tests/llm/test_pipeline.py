"""The pipeline: every stage's decisions take effect on what its predecessor kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

import corpus_pipeline
from worldlog.llm import packing, pii

from . import corpus


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{corpus.SF}/documents.parquet").drop("extra")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus.SF).persist()
        assert docs.columns == columns, name
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids
        ids = now
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any(pii.spans(t or "") for t in texts.values() if "<" not in (t or ""))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, corpus.SF).collect()
    assert {r.doc_id for r in out} == ids
    encode = packing.Encoder(packing.default_tokenizer())
    for i, t in list(texts.items())[:20]:
        whole = b"".join(bytes(r.ids) for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece))
        assert whole == encode(t or "") + b"\2\0\0\0"


def _awkward(spark):
    """The smallest tables with planted rows: nulls, repeats, ties, copies, benchmark passages, personal data; columns of stages' own names."""
    folder = tempfile.mkdtemp(prefix="spark-")
    own = spark.read.parquet(f"{corpus.SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{corpus.SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    say = lambda n, seed: " ".join(f"plain{(i * seed) % 997}" for i in range(n))
    planted = [
        (90_001, None), (90_002, ""), (90_003, " \n"), (None, say(60, 7)), (None, None), (90_010, say(80, 11)), (90_011, say(80, 11)), (90_012, say(80, 11) + " tail"), (90_013, say(80, 13)), (90_013, say(80, 13)),
        (90_020, f"{say(30, 17)} {item} {say(30, 19)}"), (90_030, f"{say(40, 23)} mail a.b@c.example or 4111 1111 1111 1111 now"), (90_040, say(9_000, 29)),
    ]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs = own.union(rows).selectExpr("*", "1 AS key", "'b' AS bucket", "2 AS gone_id", "'x' AS kept", "3 AS _bad")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{corpus.SF}/labels.parquet")
    labels.union(labels.limit(3)).union(spark.createDataFrame([(None, None, 1), (90_001, None, None)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    items = spark.read.parquet(f"{corpus.SF}/benchmark.parquet")
    items.union(spark.createDataFrame([(-1, None), (-2, "")], items.schema)).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_planted_and_awkward_rows(spark):
    folder = _awkward(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns, name
        kept[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is None or r.doc_id > 90_000]
    ids = lambda name: sorted(i for i, _ in kept[name] if i)
    everything = [90_001, 90_002, 90_003, 90_010, 90_011, 90_012, 90_013, 90_013, 90_020, 90_030, 90_040]
    assert ids("toxicity") == everything
    assert ids("near_duplicates") == [i for i in everything if i not in (90_011, 90_012)]
    assert ids("decontamination") == [i for i in everything if i not in (90_011, 90_012, 90_020)]
    assert ids("personal_data") == ids("decontamination")
    assert all(sum(i is None for i, _ in kept[name]) == 2 for name in kept)
    [masked] = [t for i, t in kept["personal_data"] if i == 90_030]
    assert "a.b@c.example" not in masked
    assert "4111" not in masked
    assert docs.filter("doc_id = 90030 AND n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in pieces) == docs.count()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(r.doc_id == 90_040 for r in pieces) > 1


def test_no_documents(spark):
    folder = _awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
        assert stage(spark, docs, folder).count() == 0, name
