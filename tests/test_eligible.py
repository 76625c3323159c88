"""Counts of eligible sources, against their pairs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from worldlog.operators import reads


def test_counts_are_those_of_the_pairs(spark):
    kinds = product(("SEARCH", "LOOKUP", "FETCH", None), ("", "a", "nobody", None), ("", "de", "fr", "xx", None), ("free", "https://x.org"))
    queries = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)] + [(1, "SEARCH", "", "de", "free")], "query_id long, operation string, source_id string, language string, value string")
    profiles = spark.createDataFrame([("a", ["SEARCH", "FETCH"], ["de"]), ("b", ["SEARCH"], ["mul"]), ("c", ["FETCH"], ["fr", "mul"]), ("d", ["LOOKUP"], ["fr", None]), ("e", [], ["de"]), ("f", None, None)], "source_id string, operations array<string>, languages array<string>")
    pairs = reads.eligible_sources(queries, profiles).groupBy("query_id").agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
    assert sorted(map(tuple, reads.eligible_counts(queries, profiles).collect())) == sorted(map(tuple, pairs.collect()))


def test_a_source_that_repeats_an_operation_is_one(spark):
    queries = spark.createDataFrame([(1, "SEARCH", "", "", "free")], "query_id long, operation string, source_id string, language string, value string")
    profiles = spark.createDataFrame([("a", ["SEARCH", "SEARCH"], ["de"])], "source_id string, operations array<string>, languages array<string>")
    assert [tuple(r) for r in reads.eligible_counts(queries, profiles).collect()] == [(1, 1, "a")]
    assert reads.eligible_sources(queries, profiles).count() == 1
