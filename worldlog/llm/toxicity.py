"""Operator 2, toxicity: cumulative-link ordinal regression of severity grades on sparse text features."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: The classifier is fitted on so many labelled rows at most, the first ones in the order of a hash of doc_id.
FIT_ROWS = 8_000
PREFIXES = (4, 5, 6, 7)
#: Features that fewer labelled texts have are left out; of the rest, at most so many that tell grades apart best, and
#: none that differs from the mean by less than chance makes some of so many differ (with so many errors to spare).
LEAST_TEXTS, FEATURES, SPARE = 4, 4_000, 0.5
RIDGE, STEPS, RATE = 3e-4, 400, 0.05
#: The chance of a grade over 0 from which a text counts as toxic is chosen on labelled rows, each judged by a fit that has
#: not seen its fold; without labels of both kinds it is even. At most such a share of clean rows may count as toxic.
FOLDS, EVEN, LOST = 5, 0.5, 0.005
#: Words whose scores a task keeps, and rows whose features it holds at a time.
CACHE, ROWS = 150_000, 100

_WORD = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its first letters: inflected and compound forms share the latter."""
    return [xxhash.xxh3_64_intdigest(f"={word}") >> 1, *(xxhash.xxh3_64_intdigest(word[:n]) >> 1 for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Weights that all thresholds share, the ordered thresholds between the grades, and the chance that counts as toxic."""

    weights: dict[int, float]
    thresholds: np.ndarray
    limit: float = EVEN

    def grades(self, score: float) -> np.ndarray:
        """The probability of each grade."""
        upto = 1 / (1 + np.exp(np.clip(score - self.thresholds, -40, 40)))
        return np.diff(np.concatenate([[0.0], upto, [1.0]]))


def fit(texts: list[list[int]], grades: np.ndarray) -> Model:
    """``texts``: a list of feature hashes, one for each word that has it; ``grades``: 0, 1, ... of each text."""
    top = int(grades.max(initial=0))
    if not top:
        return Model({}, np.zeros(0))
    names, column = np.unique(np.concatenate([np.array(x, np.int64) for x in texts]), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    cells, value = np.unique(row * len(names) + column, return_counts=True)
    row, column, value = cells // len(names), cells % len(names), value.astype(float)
    # of the features, those whose texts lie above a grade most unlike all texts, in standard errors
    n = np.bincount(column, minlength=len(names))
    often, apart = n >= LEAST_TEXTS, np.zeros(len(names))
    for k in range(top):
        over, p = grades > k, (grades > k).mean()
        mean = np.bincount(column, weights=over[row], minlength=len(names)) / np.maximum(n, 1)
        apart = np.maximum(apart, np.where(often, np.abs(mean - p) * np.sqrt(n / (p * (1 - p))), 0))
    chosen = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
    chosen = chosen[apart[chosen] > np.sqrt(2 * np.log(max(2, often.sum()))) + SPARE]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    row, column, value = row[keep], place[column[keep]], value[keep]

    share = np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / len(grades)
    start = np.log(share / (1 - share))
    w, params = np.zeros(len(chosen)), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    state = [np.zeros(len(w) + top), np.zeros(len(w) + top)]
    at = np.arange(len(grades))
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([params[:1], np.exp(params[1:])]))
        score = np.bincount(row, weights=w[column] * value, minlength=len(grades))
        s = np.ones((len(grades), top + 2))
        s[:, 0] = 0
        s[:, 1:-1] = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -40, 40)))
        upper, lower = s[at, grades + 1], s[at, grades]
        p = np.maximum(upper - lower, 1e-9)
        of_score = 1 - upper - lower  # of minus the log likelihood
        of_theta = np.zeros(top)
        for k in range(top):
            slope = s[:, k + 1] * (1 - s[:, k + 1]) / p
            of_theta[k] = -slope[grades == k].sum() + slope[grades == k + 1].sum()
        of_params = np.cumsum(of_theta[::-1])[::-1].copy()
        of_params[1:] *= np.exp(params[1:])
        grad = np.concatenate([np.bincount(column, weights=of_score[row] * value, minlength=len(w)), of_params]) / len(grades)
        grad[: len(w)] += RIDGE * w  # one feature that many words share costs less than one for each word
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        rate = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, params = w - rate[: len(w)], params - rate[len(w) :]
    theta = np.cumsum(np.concatenate([params[:1], np.exp(params[1:])]))
    return Model({int(names[c]): float(x) for c, x in zip(chosen, w, strict=True) if x}, theta)


def by_dose(texts: list[list[int]], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 of texts that are only labelled toxic or not.

    The dose of a text is how many of its words' features are seen in toxic texts mostly; toxic texts over the
    median dose of all toxic texts are of grade 2.
    """
    n, hits = {}, {}
    for found, bad in zip(texts, toxic, strict=True):
        for f in set(found):
            n[f] = n.get(f, 0) + 1
            hits[f] = hits.get(f, 0) + int(bad)
    telling = {f for f, k in n.items() if k >= LEAST_TEXTS and hits[f] > 0.7 * k}
    dose = np.array([sum(f in telling for f in found) for found in texts], float)
    bad = toxic > 0
    return bad.astype(int) + (bad & (dose > (np.median(dose[bad]) if bad.any() else 0)))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[list[int]], np.ndarray]:
    """Telling features and labels of at most ``rows`` labelled texts: a bounded sample in the order of a hash.

    Features are counted and chosen in Spark; each text then keeps those of its own that are chosen, as often as it has
    them, and the driver gets those alone. Of rows of ``docs`` that share a doc_id the least text is taken; labels that
    disagree count as toxic. Rows with a null in doc_id, text or label are left out; empty texts have no feature.
    """
    some = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").dropna().join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = [[f for w in sorted(words(x.as_py())) for f in word_features(w)] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "toxic", "f"]
                )

    seen = written(texts.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id long, toxic int, f array<long>"), "features")
    total, share = seen.agg(F.count("*"), F.avg(F.col("toxic").cast("double"))).first()
    if not total or not 0 < share < 1:
        return [], np.zeros(0, int)
    each = seen.select("toxic", F.explode(F.array_distinct("f")).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.avg("toxic").alias("share"))
    often = written(each.filter(F.col("n") >= LEAST_TEXTS), "often")
    apart = F.abs(F.col("share") - share) * F.sqrt(F.col("n") / (share * (1 - share)))
    floor = math.sqrt(2 * math.log(max(2, often.count()))) + SPARE
    chosen = often.filter(apart > floor).orderBy(F.desc(apart), "f").limit(FEATURES).select("f").collect()
    wanted = np.sort(np.array([r["f"] for r in chosen], np.int64))  # ``FEATURES`` at most

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.sort(f[np.isin(f, wanted)]) for f in (np.asarray(x.values, np.int64) for x in batch.column(2))]
            ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            flat = pa.array(np.concatenate([*own, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "toxic", "f"]
            )

    kept = seen.select("doc_id", "toxic", "f").mapInArrow(telling, "doc_id long, toxic int, f array<long>")
    got = kept.toArrow().sort_by("doc_id")  # ``rows`` at most
    return got.column("f").to_pylist(), got.column("toxic").to_numpy().astype(int)


def best_limit(chances: np.ndarray, toxic: np.ndarray) -> float:
    """Of the limits that call at most ``LOST`` of the clean texts toxic, the one that misses the fewest toxic ones.

    Of limits alike, the one that loses the fewest clean texts, in the middle of the widest gap between chances.
    """
    edges = np.concatenate([[0.0], np.unique(chances), [1.0]])
    middles = (edges[1:] + edges[:-1]) / 2
    clean, bad = np.sort(chances[toxic == 0]), np.sort(chances[toxic > 0])
    missed, lost = np.searchsorted(bad, middles), len(clean) - np.searchsorted(clean, middles)
    order = np.lexsort((-np.diff(edges), lost, missed, lost > LOST * len(clean)))
    return float(middles[order[0]])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of at most ``rows`` labelled documents; without any, or with labels all alike, it calls nothing toxic.

    Nulls, repeats and labels that disagree are settled as ``labelled`` says. The limit is chosen on rows that
    fits of the other folds have not seen; the model is then fitted on all.
    """
    texts, toxic = labelled(docs, labels, rows)
    if not len(texts):
        return Model({}, np.zeros(0))
    fold, chances = np.arange(len(texts)) % FOLDS, np.zeros(len(texts))
    for k in range(FOLDS):
        rest = [x for x, f in zip(texts, fold, strict=True) if f != k]
        away = fit(rest, by_dose(rest, toxic[fold != k]))
        chances[fold == k] = [1 - away.grades(sum(away.weights.get(f, 0.0) for f in x))[0] for x, f in zip(texts, fold, strict=True) if f == k]
    model = fit(texts, by_dose(texts, toxic))
    if 0 < toxic.mean() < 1:
        model.limit = best_limit(chances, toxic)
    return model


class Judge:
    """Severity, grade and toxicity of one text after another; scores of words met before are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> tuple[float, int, bool]:
        found = words(text or "")
        if len(self.known) > CACHE:
            self.known.clear()
        known, weights = self.known, self.model.weights
        for w in found:
            if w not in known:  # a difference of sets would walk all of ``known``
                known[w] = sum(weights.get(f, 0.0) for f in word_features(w))
        p = self.model.grades(sum(sorted(s for w in found if (s := known[w]))))
        return float(p @ np.arange(len(p))), int(p.argmax()), bool(1 - p[0] >= self.model.limit)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), toxic (the chance of a grade over 0 reaches the model's limit) of whole texts.

    Null and empty texts have no feature and get the score 0. Rows are judged one by one: repeated rows and null ids
    stay, more columns are left alone, no rows give no rows. A model without grades calls nothing toxic.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            columns = list(zip(*[judge(x.as_py()) for x in batch.column(1)], strict=True)) or [(), (), ()]
            kinds = (pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    schema = "doc_id long, severity double, grade int, toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judged, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns.

    Texts are judged as in ``severity``: null and empty ones stay unless the limit takes a text without any feature.
    """

    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            yield batch.filter(pa.array([not judge(x.as_py())[2] for x in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
