"""Decontamination against every window of every length of an item."""

from __future__ import annotations

import math
import random
import re

import pytest

from worldlog.llm import decontam

from . import corpus


def shingle_set(w: list[str], k: int) -> set:
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs: list, items: list) -> dict:
    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    known = [(i, words(t)) for i, t in items if words(t)]
    out = {}
    for k in {min(5, len(w)) for _, w in known}:
        own = [(i, w, shingle_set(w, k)) for i, w in known if min(5, len(w)) == k]
        weight = lambda s: 1 + math.log(len(own) / max(1, sum(s in x for _, _, x in own)))  # noqa: B023, E731
        for d, t in docs:
            w = words(t)
            for i, iw, ishingles in own:
                for at in range(max(1, len(w) - len(iw) + 1)):
                    mine = shingle_set(w[at : at + len(iw)], k)
                    if both := mine & ishingles:
                        like = round(sum(map(weight, both)) / sum(map(weight, mine | ishingles)), 9)
                        if like >= 0.8 and like > out.get((d, i), (0,))[0]:
                            out[(d, i)] = (like, at, len(iw))
    return out


@pytest.fixture(scope="module")
def case():
    draw = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(8, 45)))) for i in range(25)]
    items += [(30, "only three words"), (31, None), (32, ""), (33, items[0][1]), (0, items[0][1])]
    docs = []
    for i in range(90):
        own = draw.choices(vocabulary, k=draw.randint(0, 80))
        quoted = items[draw.randrange(25)][1].split()
        if i % 3 == 0:
            for _ in range(draw.randint(0, 2)):
                quoted[draw.randrange(len(quoted))] = draw.choice(vocabulary)
        at = draw.randint(0, len(own))
        docs.append((i, " ".join([*own[:at], *(quoted if i % 4 else quoted[:3]), *own[at:]])))
    return docs + [(70, "only three words"), (71, "Only, THREE   words! more"), (72, None), (73, "")], items


def test_found_are_those_of_all_windows(spark, case):
    docs, items = case
    got = decontam.contaminated(
        corpus.table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    want = brute(docs, list(dict.fromkeys(items)))
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got} == {k: round(v[0], 6) for k, v in want.items()}
    assert len(got) == len(want) > 40


def test_filter_and_empty_tables(spark, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = corpus.table(spark, [*docs, (None, "only three words"), (None, "else")])
    left = decontam.without_contaminated(table, bench)
    assert left.columns == table.columns
    bad = {d for d, _ in brute(docs, items)}
    assert {r[0] for r in left.select("doc_id").collect()} == {d for d, _ in docs} - bad
    assert decontam.contaminated(corpus.table(spark, []), bench).count() == 0
    assert decontam.contaminated(table, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(table, bench.limit(0)).count() == table.count()


def test_the_likest_window_may_lie_between_shared_shingles(spark):
    """Two words inserted in the middle of an item, whose first and last shingles other items have too."""
    item = [f"w{i}" for i in range(60)]
    items = [(0, " ".join(item))] + [(i, " ".join([*item[:5], *[f"o{i}x{j}" for j in range(20)], *item[-5:]])) for i in range(1, 9)]
    docs = [(1, " ".join([*[f"a{i}" for i in range(3)], *item[:30], "new", "words", *item[30:], *[f"z{i}" for i in range(9)]]))]
    got = decontam.contaminated(corpus.table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)[(1, 0)]
    assert [(r.item_id, r.similarity, r.start) for r in got] == [(0, want[0], want[1])]


def test_long_texts_and_more_columns_of_the_benchmark(spark):
    draw = random.Random(3)
    words = [f"v{draw.randrange(5000)}" for _ in range(40_000)]
    bench = spark.createDataFrame([(1, " ".join(words[20_000:20_030]), "x", 1)], "item_id long, text string, key string, n int")
    got = decontam.contaminated(corpus.table(spark, [(1, " ".join(words))]), bench).collect()
    assert [(r.item_id, r.start, r.similarity) for r in got] == [(1, 20_000, 1.0)]
