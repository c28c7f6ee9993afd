"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, also by their first four and five bytes as a plain stem,
pairs of neighbours, and pairs with one or two words between them, hashed to a fixed number
of buckets.  Per-coordinate rates and L1 leave few weights,
which go to the tasks as two short arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import grams
from gleaner.llm.labelled import in_fold, sample
from gleaner.llm.memory import returning
from gleaner.session import small_batches

U = np.uint64
BITS = 20
STEMS = (4, 5)
GAPS_BETWEEN = (1, 2, 3)
_code = np.arange(256)
# Words of this model: runs of ASCII letters and digits and of all other characters beyond ASCII.
GAPS = ~(((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128))


def features(part: grams.Slice) -> list[np.ndarray]:
    """Each text's distinct buckets of words, stems, pairs and skip-pairs; bucket 0 is the bias."""
    runs = grams.Buckets(grams.FOLDED[part.data])
    stems = [grams.mix(runs.of(part.starts, np.minimum(part.ends, part.starts + k)) + U(k)) for k in STEMS]
    out = []
    for i in range(len(part)):
        words, mine = part.words(i), slice(part.first[i], part.first[i + 1])
        pairs = [grams.mix(words[:-gap] * U(3) + words[gap:] + U(gap)) for gap in GAPS_BETWEEN]
        found = np.concatenate([words, *(s[mine] for s in stems), *pairs]) >> U(64 - BITS)
        out.append(np.unique(np.r_[U(0), found]).astype(np.int64))
    return out


class Ftrl:
    """FTRL-proximal: weights follow from z and n, and are zero while |z| stays within l1."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 16.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        was = self.n[at]
        self.n[at] = was + g * g
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / self.alpha * w


def train(texts: pa.Table, epochs: int = 10, **rates: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a weight, and the weights."""
    model = Ftrl(1 << BITS, **rates)
    seen = [f.astype(np.int32) for _, part in grams.slices(texts["text"], True, GAPS) for f in features(part)]
    labels = texts["y"].to_pylist()
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            model.learn(seen[k], labels[k])
    weights = model.weights(slice(None))
    at = np.flatnonzero(weights)
    return at, weights[at].astype(np.float32)


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = model.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        for batch in batches:
            for row, part in grams.slices(batch.column(1), True, GAPS):
                sums = np.array([weights[f].sum(dtype=float) for f in features(part)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(part)), pa.array(1 / (1 + np.exp(-sums)))], names=["doc_id", "score"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7,
                   train_rows: int = 12_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Trained on at most `train_rows` rows of labels (doc_id, toxic) outside the held-out fold,
    the one documented bound; every document is scored by its whole text.  A null or empty
    text gets the score of the bias alone.  Null ids are in no fold and repeated rows score
    alike.  Without any label every score is one half.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(sample(docs, labels, "toxic", folds, held, train_rows)))
    scored = docs.select("doc_id", "text").mapInArrow(returning(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", in_fold("doc_id", folds, held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
