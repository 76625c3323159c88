"""Small awkward tables for the language-model operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Invented documents with copies, near copies, shared passages, nulls, empties and a very long one."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ß", "日本", "a b", "X"]
    say = lambda n: " ".join(draw.choices(words, k=n))
    passage, base = say(70), say(120)
    rows: list[tuple[int | None, str | None]] = [(i, say(draw.randint(1, 150))) for i in range(40)]
    rows += [(40, base), (41, base.upper()), (42, base.replace(" ", "\n ", 5)), (43, f"{base} tail"), (44, base), (44, base)]
    near = base.split()
    for i in range(45, 60):
        changed = list(near)
        for _ in range(draw.randint(1, 12)):
            changed[draw.randrange(len(changed))] = draw.choice(words)
        rows.append((i, " ".join(changed)))
    rows += [(60, f"{say(20)} {passage} {say(5)}"), (61, f"{passage}\t{say(30)}"), (62, f"{say(3)}\n{passage}")]
    rows += [(63, None), (64, ""), (65, " \t\n"), (66, "one"), (67, "one two"), (68, "ONE  two"), (69, say(6000))]
    rows += [(None, passage), (None, None), (70, f"{passage} {passage}"), (-5, say(60))]
    draw.shuffle(rows)
    return rows


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with further columns, some called like those that operators make for themselves."""
    more = "lang string, source string, n_chars long, head long, bucket string, key int, n int, next string, places string, said string, kept string, spans string"
    wide = [(a, b, "en", "s", len(b or ""), 7, "b", 1, 2, "x", None, None, "k", "s") for a, b in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {more}").repartition(3)
