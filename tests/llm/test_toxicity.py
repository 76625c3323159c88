"""Ordinal regression: held-out accuracy, ordered thresholds, and awkward rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from worldlog.llm import toxicity

from . import corpus

SF = "/root/testdata/sf0.1"


def test_thresholds_are_ordered_and_weights_shared():
    draw = np.random.Generator(np.random.PCG64(2))
    texts, grades = [], []
    for _ in range(600):
        g = int(draw.integers(0, 3))
        texts.append([1000 + int(x) for x in draw.integers(0, 50, 20)] + [7] * g)
        grades.append(g)
    model = toxicity.fit(texts, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    assert abs(model.grades(0.3).sum() - 1) < 1e-9
    assert model.weights[7] > max((w for f, w in model.weights.items() if f != 7), default=0.0)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.repartition(8)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.train(docs, labels.filter(half))
    said = toxicity.severity(docs, model).withColumnRenamed("toxic", "said").join(labels.filter(~half), "doc_id")
    rows = [(r[0], bool(r[1])) for r in said.select("said", "toxic").collect()]
    toxic = [s for s, t in rows if t]
    clean = [s for s, t in rows if not t]
    # some of this table's toxic texts hold none of the words that tell
    assert sum(toxic) >= 0.85 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def test_awkward_rows(spark):
    docs = corpus.table(spark, corpus.texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.severity(docs, model).count() == docs.count()
    assert toxicity.accepted(docs, model).columns == docs.columns
    nothing = toxicity.train(corpus.table(spark, []), labels)
    assert toxicity.severity(docs, nothing).filter("toxic OR severity > 0").count() == 0
    assert toxicity.accepted(corpus.table(spark, []), model).count() == 0
