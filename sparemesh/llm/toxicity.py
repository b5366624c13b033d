"""Toxicity: non-negative positive-unlabelled learning of linear classifiers over word beginnings, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BASE, BYTE, Words, _powers, byte_slices, mix64, stored
from .language_id import is_held_out

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
SHORTEST, LONGEST = 3, 8
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True
# How a feature found c times in n words enters each classifier, and the classifier's weight decay.
VIEWS = (("root", 1e-4), ("share", 3e-4), ("root", 1e-4), ("share", 3e-4))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, features, times, words) of a batch: row r has the hashed features ``bounds[r]`` to ``bounds[r + 1]``, ascending, and ``words[r]`` words.

    Words are runs of letters (any character outside ASCII is one), lower-cased. A word's features are itself and its beginnings
    of 3 to 8 bytes; ``times`` tells how often each occurs in the row.
    """
    words = Words(pc.utf8_lower(column.cast(pa.large_string())), blank=~LETTER)
    row = np.repeat(np.arange(len(column), dtype=np.uint64) << np.uint64(SLOT_BITS), np.diff(words.first))
    size = len(words.data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[words.data] * _powers(BASE, size))])
    inverse = _powers(pow(BASE, -1, 1 << 64), size + 1)
    keys = [row | mix64(words.hashes, 31) & np.uint64(SLOTS - 1)]
    for k in range(SHORTEST, LONGEST + 1):
        longer = np.flatnonzero(words.ends - words.starts > k)
        at = words.starts[longer]
        keys.append(row[longer] | mix64((total[at + k] - total[at]) * inverse[at], 32) & np.uint64(SLOTS - 1))
    found, times = np.unique(np.concatenate(keys), return_counts=True)
    bounds = np.searchsorted(found, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(SLOT_BITS))
    return bounds, (found & np.uint64(SLOTS - 1)).astype(np.int64), times, np.diff(words.first)


def weighed(times: np.ndarray, words: np.ndarray, view: str) -> np.ndarray:
    return np.sqrt(times / words) if view == "root" else times / np.sqrt(words)


@dataclass
class Texts:
    """Sparse rows: row r has the features ``at[bounds[r]:bounds[r + 1]]``, each ``times`` times, and ``words[r]`` words."""

    bounds: np.ndarray
    at: np.ndarray
    times: np.ndarray
    words: np.ndarray

    @property
    def n(self) -> int:
        return len(self.words)

    def part(self, rows: np.ndarray, view: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(feature, value, place among ``rows``) of the rows, and their number."""
        size = self.bounds[rows + 1] - self.bounds[rows]
        row = np.repeat(np.arange(len(rows)), size)
        own = self.bounds[rows][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        return self.at[own], weighed(self.times[own], self.words[rows][row], view), row, len(rows)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Logistic risk of scores: (positive part, negative part, gradients with respect to the two kinds of scores).

    The share of toxic texts in the unlabelled ones is taken out of their risk as negatives; if what is left is below zero,
    which no true risk is, the gradient goes up that part alone.
    """
    p, u = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    up = prior * np.logaddexp(0, -positive).mean()
    down = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    if down >= 0:
        return up, down, prior * (p - 1) / len(p) - prior * p / len(p), u / len(u)
    return up, down, prior * p / len(p), -u / len(u)


def train(positive: Texts, unlabelled: Texts, size: int, prior: float, view: str, decay: float, seed: int, rounds: int = 24, batches: int = 12, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and intercept of one classifier (Adam)."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(size + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros(size + 1), np.zeros(size + 1), 0
    batches = min(batches, positive.n, unlabelled.n)
    for k in range(rounds):
        dealt = [np.array_split(rng.permutation(x.n), batches) for x in (positive, unlabelled)]
        for rows in zip(*dealt, strict=True):
            parts = [x.part(own, view) for x, own in zip((positive, unlabelled), rows, strict=True)]
            scores = [np.bincount(row, v * weights[at], n) + weights[-1] for at, v, row, n in parts]
            *_, gp, gu = risk(*scores, prior)
            grad = decay * weights
            grad[-1] = gp.sum() + gu.sum()
            for (at, v, row, _), g in zip(parts, (gp, gu), strict=True):
                grad[:-1] += np.bincount(at, v * g[row], size)
            step += 1
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            weights -= rate * (1 - k / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


@dataclass
class Classifiers:
    """The mean of the classifiers' log odds; ``slots`` are the features they know."""

    slots: np.ndarray
    weights: list[np.ndarray]
    intercepts: list[float]

    def score(self, column: pa.Array) -> np.ndarray:
        place = np.full(SLOTS, -1, dtype=np.int32)
        place[self.slots] = np.arange(len(self.slots))
        bounds, found, times, words = features(column)
        row = np.repeat(np.arange(len(words)), np.diff(bounds))
        at = place[found]
        row, times, at = row[at >= 0], times[at >= 0], at[at >= 0]
        odds = np.full(len(words), np.mean(self.intercepts))
        for view in {view for view, _ in VIEWS}:
            weights = np.sum([w for w, (v, _) in zip(self.weights, VIEWS, strict=True) if v == view], axis=0) / len(VIEWS)
            odds += np.bincount(row, weighed(times, words[row], view) * weights[at], len(words))
        return np.round(1 / (1 + np.exp(-odds)), 8)


def _lowest(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct ids, those with the lowest seeded hashes, in 16 parts so that no task ranks all."""
    placed = rows.select("doc_id").distinct().withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy(F.pmod("h", F.lit(16))).orderBy("h", "doc_id")))
    return ranked.where(F.col("r") <= max(1, most // 16)).select("doc_id")


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 2048, most_unlabelled: int = 4096, prior: float | None = None, least_texts: int = 5, seed: int = 7) -> Classifiers | None:
    """Train on a bounded sample: ``most_toxic`` documents labelled 1 and ``most_unlabelled`` documents whatever their label, outside the held-out fold.

    The labels 0 are not learned from. They only give the share of toxic documents, unless ``prior`` states it: the mean of the labels
    (an id labelled both ways is toxic), held inside 0.001 and 0.5. A feature must occur in ``least_texts`` toxic documents (in a fifth of
    them, if they are few). None if no document is labelled 1.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id"))
    if prior is None:
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    toxic = _lowest(rows.join(known.where("toxic = 1"), "doc_id", "left_semi"), most_toxic, seed)
    chosen = toxic.select("doc_id", F.lit(1).alias("which")).union(_lowest(rows, most_unlabelled, seed + 1).select("doc_id", F.lit(0)))
    chosen = stored(chosen.groupBy(F.col("doc_id").alias("__id")).agg(F.max("which").alias("toxic"), F.min("which").alias("other")), "toxic-sample")
    sample = rows.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, found, times, words = features(batch.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "other")), *lists, pa.array(words, pa.int64())], names=["doc_id", "toxic", "other", "at", "times", "words"])

    table = sample.mapInArrow(run, "doc_id long, toxic int, other int, at array<int>, times array<int>, words long").where("words > 0").toArrow()
    if not table.num_rows:
        return None
    at, times = ([x.values.to_numpy() for x in table[c]] for c in ("at", "times"))
    ids, kinds, other, words = (table[c].to_numpy() for c in ("doc_id", "toxic", "other", "words"))
    # the order of training must not follow that of the tasks
    order = np.array(sorted(range(table.num_rows), key=lambda i: (ids[i], at[i].tobytes(), times[i].tobytes())))
    toxic, other = order[kinds[order] == 1], order[other[order] == 0]
    if not len(toxic) or not len(other):
        return None
    seen = np.bincount(np.concatenate([at[i] for i in toxic]), minlength=SLOTS)
    slots = np.flatnonzero(seen >= min(least_texts, max(1, len(toxic) // 5)))
    place = np.full(SLOTS, -1, dtype=np.int64)
    place[slots] = np.arange(len(slots))

    def rows_of(rows: np.ndarray) -> Texts:
        known = [place[at[i]] >= 0 for i in rows]
        bounds = np.cumsum([0, *(int(k.sum()) for k in known)])
        return Texts(bounds, np.concatenate([place[at[i]][k] for i, k in zip(rows, known, strict=True)]), np.concatenate([times[i][k] for i, k in zip(rows, known, strict=True)]), words[rows])

    prior = float(np.clip(prior, 0.001, 0.5))
    positive, unlabelled = rows_of(toxic), rows_of(other)
    fitted = [train(positive, unlabelled, len(slots), prior, view, decay, seed + k) for k, (view, decay) in enumerate(VIEWS)]
    return Classifiers(slots, [w for w, _ in fitted], [c for _, c in fitted])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for every row.

    Four linear classifiers, two for each of two ways to weigh a feature, are trained from confirmed toxic documents and unlabelled
    ones and averaged. The whole text counts; text alone is the input of a score. Null texts and texts without a letter have no features: their
    score is that of the intercepts. Score 0 where no toxic document can be learned from. A null id is
    outside the held-out fold. Repeated rows get equal scores; columns named like a result are replaced.

    The model (some 100 KB, see ``fit_toxicity``) travels with the task; texts are never shuffled.
    """
    names = ("held_out", "score", "predicted")
    docs = docs.drop(*names)
    model = fit_toxicity(docs, labels, **fit)
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                scores = model.score(batch.column("text")) if model else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema).select("*", is_held_out("doc_id").alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))
