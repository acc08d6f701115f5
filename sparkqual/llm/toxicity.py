"""Toxicity of texts: a linear classifier whose scores don't depend on which group is named.

Logistic regression over the distinct words of a text and their beginnings. For every training text that names a
group, a copy is made with the group swapped for another of its kind; the loss adds the squared
difference of the two scores. A text is thus not toxic because of the group it mentions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkqual.llm.tables import texts

# Training rows of each class (expected; all of a class that has fewer).
SAMPLE = 5000
# Words and their first letters are hashed to so many features. One is used if at least MIN_DOCS
# different training texts have it, and its shares in both classes differ by MIN_Z standard errors.
FEATURES = 1 << 20
STEMS = (4, 5, 6)
MIN_DOCS, MIN_Z = 4, 4.0
# Weights of the squared weights and of the squared changes under swaps.
RIDGE, SWAP = 2e-4, 1.0
STEPS = 400
# Words a worker keeps weights of.
CACHE = 500_000

# Names of groups by kind; a swap takes the next one of the same kind.
GROUPS = [
    ["women", "men", "girls", "boys", "transgender"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "lesbian", "bisexual", "straight"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "deaf", "blind", "autistic"],
    ["african", "european", "american", "chinese", "mexican", "indian"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]
_NEXT = {w: g[(k + 1) % len(g)] for g in GROUPS for k, w in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")


def _word_features(word: str) -> list[int]:
    """Slots of a word and of its beginnings."""
    parts = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
    return [zlib.crc32(p.encode()) & (FEATURES - 1) for p in parts]


def _features(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in _word_features(w)})


@dataclass
class Model:
    bias: float
    features: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        full = np.zeros(FEATURES, np.float64)
        full[self.features] = self.weights
        return full


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, weight, own features, features after the swap or null)."""
    for batch in batches:
        own, swapped = [], []
        for text in batch.column(2).to_pylist():
            words = set(_WORD.findall(text.lower()))
            own.append(_features(words))
            named = words & _NEXT.keys()
            swapped.append(_features((words - named) | {_NEXT[w] for w in named}) if named else None)
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(own, kind), pa.array(swapped, kind)],
            names=["label", "weight", "own", "swapped"],
        )


class _Rows:
    """Sparse 0/1 rows: products with a weight vector, and the transposed product."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.lengths)
        self.column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.n, self.size = len(rows), size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, v[self.row], self.size)


def _telling(label: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Features whose shares differ between the classes; copies of a text count once."""
    first = {(y, r.tobytes()): k for k, (y, r) in enumerate(zip(label.tolist(), rows, strict=True))}
    n, seen = np.zeros(2), np.zeros((2, FEATURES), np.float64)
    for (y, _), k in first.items():
        n[int(y)] += 1
        seen[int(y), rows[k]] += 1
    if not n.all():
        return np.zeros(0, np.int64)
    share = seen.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    z = np.abs(seen[1] / n[1] - seen[0] / n[0]) / error
    return np.flatnonzero((seen.sum(axis=0) >= MIN_DOCS) & (z >= MIN_Z))


def fit(examples: list[tuple], ridge: float = RIDGE, swap: float = SWAP, steps: int = STEPS) -> Model:
    """Minimise weighted log-loss + swap * squared score changes + ridge * squared weights.

    `examples`: (label, weight, own features, swapped features or None). With a single class, or no
    example, the score is constant: the smoothed share of label 1.
    """
    label = np.array([e[0] for e in examples], float)
    weight = np.array([e[1] for e in examples], float)
    share = (float((label * weight).sum()) + 0.5) / (float(weight.sum()) + 1.5)
    bias = float(np.log(share / (1 - share)))
    kept = _telling(label, [np.asarray(e[2], np.int64) for e in examples])
    if not len(kept) or len(set(label.tolist())) < 2:
        return Model(bias, np.zeros(0, np.int64), np.zeros(0))

    def narrow(found) -> np.ndarray:
        return np.flatnonzero(np.isin(kept, np.asarray(found, np.int64), assume_unique=True))

    own = _Rows([narrow(e[2]) for e in examples], len(kept))
    pairs = [k for k, e in enumerate(examples) if e[3] is not None]
    before, after = (_Rows([narrow(examples[k][i]) for k in pairs], len(kept)) for i in (2, 3))
    weight = weight / weight.sum()
    pair_weight = weight[pairs]
    w, speed = np.zeros(len(kept)), np.zeros(len(kept) + 1)
    for _ in range(steps):
        z = np.clip(bias + own.dot(w), -30, 30)
        error = weight * (1 / (1 + np.exp(-z)) - label)
        gradient = own.back(error) + ridge * w
        if pairs:
            change = pair_weight * (before.dot(w) - after.dot(w)) * 2 * swap
            gradient += before.back(change) - after.back(change)
        speed += np.append(gradient, error.sum()) ** 2
        step = 0.5 / np.sqrt(speed + 1e-12)
        w -= step[:-1] * gradient
        bias -= float(step[-1] * error.sum())
    return Model(bias, kept, w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` labelled documents of each class, chosen by a hash of the id.

    `labels` has doc_id and toxic; null ones are no labels, and of several for a document the
    largest counts. Only the chosen documents' word features reach the driver. Examples are
    weighted back to the share of their class.
    """
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    share = F.least(F.lit(1.0), F.lit(sample) / F.col("rows"))
    chosen = known.join(F.broadcast(sizes), "label").filter(place < share)
    chosen = chosen.select("doc_id", "label", (1 / share).alias("weight"))
    examples = (
        texts(docs)
        .join(F.broadcast(chosen), "doc_id")
        .select("label", "weight", "text")
        .mapInArrow(_examples, "label int, weight double, own array<int>, swapped array<int>")
        .toArrow()
    )
    return fit(list(zip(*[examples.column(c).to_pylist() for c in range(4)], strict=True)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of label 1 for every document, from its distinct words.

    Null or empty text, and text of unknown words, gets the score of no evidence. Null ids stay,
    repeated rows are scored once each, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.table(), {}
        for batch in batches:
            if len(known) > CACHE:
                known = {}
            sums = []
            for text in batch.column(1).to_pylist():
                words = set(_WORD.findall(text.lower()))
                for w in words.difference(known):
                    known[w] = [f for f in _word_features(w) if weights[f]]
                # A feature counts once, though several words may share it.
                found = set(chain.from_iterable(filter(None, map(known.__getitem__, words))))
                sums.append(weights[sorted(found)].sum() if found else 0.0)
            z = np.clip(model.bias + np.array(sums, float), -30, 30)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double")
