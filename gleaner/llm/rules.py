"""Quality rules combined by weak supervision.

Each rule votes good, bad or abstains.  No rule is believed outright: expectation-
maximisation over all documents estimates how often each rule gives each vote on good and on
bad texts, and a text is kept if its posterior probability of being good reaches one half.

Votes are counted by pattern.  There are at most 3 ** rules patterns whatever the input, so
the counts, and the posteriors that go back to the rows, are small by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import grams
from gleaner.llm.memory import returning
from gleaner.session import Steps, materialize, small_batches

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_letters", "n_plain_words", "n_distinct_words"]
_symbol = np.isin(np.arange(256), list(SYMBOLS))
_byte = np.arange(256)
_upper = (_byte >= 65) & (_byte <= 90)
_letter = _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 0xC0)  # a lead byte counts as a letter


def measure(part: grams.Slice, i: int, prints: np.ndarray) -> list[int]:
    """The MEASURES of one text, of whose 5-word windows the fingerprints are given."""
    data = part.data[part.offsets[i]:part.offsets[i + 1]]
    words = part.words(i)
    n = len(words)
    if not n:
        return [0, 0, int(_symbol[data].sum())] + [0] * (len(MEASURES) - 3)
    starts, ends = part.spans(i)
    chars = int((((data & 0xC0) != 0x80) & (data != 32) & ((data - np.uint8(9)) > 4)).sum())
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    repeated = 0
    if len(prints):
        _, at, counts = np.unique(prints, return_inverse=True, return_counts=True)
        edges = np.zeros(n + 1, np.int64)
        many = np.flatnonzero(counts[at] > 1)
        np.add.at(edges, many, 1)
        np.add.at(edges, many + 5, -1)
        repeated = int((np.cumsum(edges[:n]) > 0).sum())
    letters = _letter[data]
    sums = np.r_[0, np.cumsum(letters)]
    # a plain word has letters, and at most its last byte is something else
    tail = (sums[ends] - sums[starts] >= 1) & ~_symbol[data[ends - 1]] & ~_symbol[data[starts]]
    return [n, chars, int(_symbol[data].sum()), len(lines) - len(set(lines)), repeated, len(lines),
            int(_upper[data].sum()), int(letters.sum()), int(tail.sum()), len(np.unique(words))]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, part in grams.slices(batch.column(1)):
            found = np.array([measure(part, i, p) for i, p in enumerate(part.run_prints(5))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), *map(pa.array, found.T)],
                                             names=["doc_id", *MEASURES])


def _rules() -> dict[str, tuple[Column, Column]]:
    """By name: when the rule votes bad, and when good; else it abstains."""
    c = F.col
    return {
        "length": (c("n_words") < 10, c("n_words") >= 40),
        "repetition": (100 * c("n_repeat_words") > 20 * c("n_words"), 100 * c("n_repeat_words") <= 2 * c("n_words")),
        "symbols": (10 * c("n_symbols") > c("n_words"), 100 * c("n_symbols") <= c("n_words")),
        "lines": (2 * c("n_dup_lines") > c("n_lines"), c("n_dup_lines") == 0),
        "word_length": ((2 * c("word_chars") < 5 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
                        c("word_chars").between(3 * c("n_words"), 10 * c("n_words"))),
        "capitals": (2 * c("n_upper") > c("n_letters"), 5 * c("n_upper") <= c("n_letters")),
        "plain_words": (10 * c("n_plain_words") < 7 * c("n_words"), 100 * c("n_plain_words") >= 95 * c("n_words")),
        "variety": (c("n_words") > 10 * c("n_distinct_words"), c("n_words") <= 4 * c("n_distinct_words")),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, vote rates [class, rule, bad or good] and the share of good.

    patterns hold -1, 0 or 1 by rule; where a rule abstains it says nothing.  Rates start at
    a belief that rules are right more often than not and keep a few pseudo-votes of it; a
    rule's votes never come to speak for the opposite class.
    """
    belief = np.array([[0.40, 0.60], [0.02, 0.98]])  # votes bad and good on bad and on good texts
    rules = patterns.shape[1]
    rates = np.repeat(belief[:, None, :], rules, axis=1)
    share = 0.8
    hot = patterns[:, :, None] == np.array([-1, 1])
    good = np.full(len(patterns), share)
    for _ in range(rounds):
        log = np.stack([(hot * np.log(rates[k])).sum((1, 2)) for k in (0, 1)])
        log += np.log([[1 - share], [share]])
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(now - good).max(initial=0) < 1e-9:
            break
        good = now
        weight = np.stack([counts * (1 - good), counts * good])
        rates = np.einsum("cp,prv->crv", weight, hot) + 20 * belief[:, None, :]
        rates /= rates.sum(2, keepdims=True)
        for vote, side in ((0, 1), (1, 0)):  # a bad vote is at least as frequent on bad texts, a good one on good texts
            rates[side, :, vote] = np.minimum(rates[side, :, vote], rates[1 - side, :, vote])
        rates /= rates.sum(2, keepdims=True)
        share = float(np.clip((weight[1].sum() + 16) / (weight.sum() + 20), 0.02, 0.98))
    return good, rates, share


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the MEASURES, votes (a string of -, 0, +), posterior, base_failed, kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  base_failed holds for fewer than
    10 words or more than 20 per cent of them in repeated 5-word windows; such a text is not
    kept, any other is kept if its posterior reaches the threshold.  A null text is an empty
    one: no words, so base_failed.  Repeated rows and null ids are judged like other rows; an
    empty table gives an empty result.  Needs the columns doc_id and text.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    fields = ", ".join(f"{c} long" for c in ["doc_id", *MEASURES])
    vote = [F.when(bad, "-").when(good, "+").otherwise("0") for bad, good in _rules().values()]
    with Steps(spark, "rules") as steps:
        voted = steps.keep(docs.select("doc_id", "text").mapInArrow(returning(_measured), fields).withColumn("votes", F.concat(*vote)))
        counted = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** rules rows
        patterns = np.array([["-0+".index(v) - 1 for v in r["votes"]] for r in counted]).reshape(len(counted), len(vote))
        posterior, _, _ = fit_votes(patterns, np.array([r["count"] for r in counted], float))
        known = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(counted, posterior, strict=True)],
                                      "votes string, posterior double")
        out = voted.join(F.broadcast(known), "votes")
        failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        return materialize(out.select("doc_id", *MEASURES, "votes", "posterior", failed.alias("base_failed"),
                                      (~failed & (F.col("posterior") >= threshold)).alias("kept")))
