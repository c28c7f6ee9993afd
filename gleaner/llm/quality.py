"""Quality by supervised subword embeddings.

A text is the average of learned vectors, one for each hashed word and character n-gram in
it and for each word that follows itself, and a softmax over two classes reads that average.  Vectors and output are trained
together by stochastic gradient descent in numpy.  With the output fixed, each bucket's
vector comes down to one number, so that is what goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm import grams
from gleaner.llm.labelled import in_fold, sample
from gleaner.llm.memory import returning
from gleaner.session import small_batches

U = np.uint64
BITS, SIZE = 17, 8
GRAMS = (3, 4)  # character n-grams, in code points, a word's edges included
EDGE = 32
REPEATED = U(1 << 63)  # the word pair of any word that follows itself


def features(text: bytes) -> np.ndarray:
    """Buckets of a text's words and n-grams, repeats included; bucket 0 is in every text."""
    codes = np.frombuffer(b" \0\0\0" + text.decode().encode("utf-32-le") + b" \0\0\0", np.uint32).astype(U)
    gap = (codes == EDGE) | ((codes - U(9)) < 5)
    codes[gap] = EDGE
    runs = grams.Buckets(grams.mix(codes * U(0x9E3779B97F4A7C15)))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    words = runs.of(starts, ends)
    again = np.full(np.count_nonzero(words[1:] == words[:-1]), REPEATED)
    found = [np.zeros(1, U), words, again]
    gaps = np.r_[0, np.cumsum(gap)]
    for n in GRAMS:
        # an edge may begin or end an n-gram, not stand within it
        at = np.flatnonzero(gaps[n - 1:-1] == gaps[1:len(gaps) - n + 1])
        found.append(grams.mix(runs.of(at, at + n) + U(n)))
    return (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def train(texts: pa.Table, epochs: int = 6, rate: float = 0.5) -> np.ndarray:
    """The number for each bucket; a text's log-odds of label 1 are their mean over its features."""
    order = np.random.default_rng(5)
    vectors = order.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE)).astype(np.float32)
    output = np.zeros((SIZE, 2), np.float32)
    labels = texts["y"].to_pylist()
    seen = []
    for text in texts["text"].to_pylist():
        at, count = np.unique(features(text.encode()), return_counts=True)
        seen.append((at.astype(np.int32), (count / count.sum()).astype(np.float32)))
    steps, done = epochs * len(seen), 0
    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            at, share = seen[k]
            mean = share @ vectors[at]
            logits = mean @ output
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[labels[k]] -= 1
            now = rate * (1 - done / steps)
            back = output @ wrong
            output -= now * np.outer(mean, wrong)
            vectors[at] -= (now * share)[:, None] * back * np.float32(len(at)) ** 0.5
            done += 1
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)


def _score(model) -> object:
    """Scores of the last column's texts, or of the field text where the only column is a struct."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            data, offsets = grams.text_buffers(pc.struct_field(last, "text") if batch.num_columns == 1 else last)
            odds = np.array([weights[features(data[a:b].tobytes())].mean(dtype=float)
                             for a, b in zip(offsets, offsets[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-odds)))], names=["key", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, key: str, folds: int = 5, held: int = 0,
                   train_rows: int = 4_000) -> DataFrame:
    """Rows (key, score) for every document; key is a column of docs, or a struct of the document with its text.

    Trained on at most `train_rows` rows of labels (doc_id, quality) outside the held-out
    fold, the one documented bound; every document is scored by its whole text.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(sample(docs, labels, "quality", folds, held, train_rows)))
    schema = docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).schema
    rows = docs.select(F.col(key).alias("key"), *["text"] * (not isinstance(docs.schema[key].dataType, StructType)))
    return rows.mapInArrow(returning(_score(model)), schema)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3,
                  train_rows: int = 4_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    score is the probability of label 1.  A null or empty text has the feature that all texts
    have, and its score.  Null ids are in no fold and repeated rows score alike.  Without any
    label every score is one half.
    """
    scored = quality_scores(docs, labels, "doc_id", folds, held, train_rows).withColumnRenamed("key", "doc_id")
    return scored.select("doc_id", in_fold("doc_id", folds, held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
