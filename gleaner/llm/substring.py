"""Removal of repeated passages by seeding on winnowed anchors and extending both ways.

A window is a run of `length` words; it is repeated if the same words start anywhere else.
Each window names one anchor: the run of SEED words inside it with the least fingerprint
(the first of equals).  Equal windows name equal anchors at the same place, so two copies of
a window always meet at their seed.  Neighbouring windows mostly name the same anchor; such
a stretch is one row, and only stretches whose anchor occurs twice go on.

Extension starts from the seed.  A stretch whose whole context (every word its windows cover)
occurs again is repeated as a whole, however many copies there are.  Contexts that differ are
extended as far as each window reaches to the left and right of the seed: one occurrence per
context gives the fingerprints of its windows, and those that another context shares are
repeats.  Overlapping windows join to maximal repeats when they are cut.  Work is linear in
the stretches; copies are never paired.

Anchors bring rows together and prove nothing.  Contexts, windows and rows are told apart by pairs of
fingerprints, 122 bits or more, so that no two of a corpus are taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import grams
from gleaner.llm.memory import returning
from gleaner.session import Steps, small_batches

SEED = 8
# Of rows, windows and contexts the pairs that tell them apart; a context also names its anchor.
KEY, WINDOW, CONTEXT = ["key", "key2"], ["window", "window2"], ["anchor", "context", "context2"]


def row_key() -> tuple[Column, Column]:
    """Two hashes of a row's id and text."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(29), "text", "doc_id")


def _same(side: str) -> Column:
    return (F.col("key") == F.col(f"{side}_key")) & (F.col("key2") == F.col(f"{side}_key2"))


def stretches(prints: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first window and number of windows of each stretch, from the hashes of a text's seeds; a window holds `reach` of them."""
    if len(prints) < reach:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    windows = np.lib.stride_tricks.sliding_window_view(prints, reach)
    anchor = windows.argmin(axis=1) + np.arange(len(windows))
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return anchor[first], first, np.diff(np.r_[first, len(anchor)])


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            for row, part in grams.slices(batch.column(2)):
                prints, found = grams.Buckets(part.hashes).windows(seed), []
                for i, (low, high) in enumerate(zip(part.first[:-1].tolist(), part.first[1:].tolist(), strict=True)):
                    at, first, count = stretches(prints[low:max(low, high - seed + 1)], length - seed + 1)
                    if len(at):
                        found.append((at, first, count, np.full(len(at), row + i), np.full(len(at), low)))
                if found:
                    at, first, count, texts, low = map(np.concatenate, zip(*found, strict=True))
                    starts = low + first
                    both = [grams.mix(grams.Runs(part.hashes, k).of(starts, starts + count - 1 + length) + (at - first).astype(np.uint64))
                            for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*map(grams.signed, (prints[low + at], *both)), *[pa.array(k[texts]) for k in keys],
                         pa.array(first, pa.int32()), pa.array(count, pa.int32())], names=[*CONTEXT, *KEY, "first", "count"])
    return run


def _windows(length: int):
    """Fingerprints of the windows of given stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            probes = batch.column(3).to_pylist()
            for row, part in grams.slices(pc.struct_field(batch.column(2), "text")):
                found = []
                for i in range(len(part)):
                    starts = np.concatenate([np.arange(p["first"], p["first"] + p["count"]) for p in probes[row + i]])
                    lone = np.repeat([p["lone"] for p in probes[row + i]], [p["count"] for p in probes[row + i]])
                    found.append((part.first[i] + starts, np.full(len(starts), row + i), starts, lone))
                if found:
                    place, at, start, lone = map(np.concatenate, zip(*found, strict=True))
                    both = [grams.Runs(part.hashes, k).of(place, place + length) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*map(grams.signed, both), *[pa.array(k[at]) for k in keys], pa.array(start, pa.int32()),
                         pa.array(lone, pa.bool_())], names=[*WINDOW, *KEY, "first", "lone"])
    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = batch.column(1).to_pylist()
            for row, part in grams.slices(pc.struct_field(batch.column(0), "text")):
                words, removed, texts = [], [], []
                for i in range(len(part)):
                    starts, ends = part.spans(i)
                    text = part.text(i)
                    words.append(len(starts))
                    edges = np.zeros(len(starts) + 1, np.int64)
                    for r in repeats[row + i] or ():
                        edges[r["first"]] += 1
                        edges[r["first"] + r["count"] - 1 + length] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    removed.append(int(gone.sum()))
                    if removed[-1]:
                        side = np.diff(np.r_[0, gone.astype(np.int8), 0])
                        left, right = starts[np.flatnonzero(side == 1)], ends[np.flatnonzero(side == -1) - 1]
                        text = b"".join(text[a:b] for a, b in zip(np.r_[0, right], np.r_[left, len(text)], strict=True))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(part)), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["doc", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, steps: Steps, length: int = 35) -> DataFrame:
    """One row per document: doc (a struct of the given columns), n_words, n_removed, kept_text.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  Every word covered by a window
    of `length` words that also starts anywhere else, in the same or another row, is cut out
    of the text; what stays keeps its white space.  Windows are judged on the input.  A null
    text has no words and an empty kept_text.  Rows that repeat an id or a whole row are rows
    like others: both copies of a repeated text of `length` words or more lose all words.
    Needs the columns doc_id and text; other columns, of whatever name, stay in doc.

    The rows are not written yet: they read the tables that `steps` keeps until it ends.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(*[k.alias(n) for k, n in zip(row_key(), KEY, strict=True)], F.struct(*docs.columns).alias("doc"))
    longs = "{0} long, {1} long"
    seeds = keyed.select(*KEY, "doc.text").mapInArrow(
        returning(_seeds(length, SEED)), f"anchor long, {longs.format(*CONTEXT[1:])}, {longs.format(*KEY)}, first int, count int")
    # Written by themselves, the keys below are shuffled for their joins alone, which lets Spark split a hot anchor's rows.
    common = steps.keep(seeds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    met = steps.keep(seeds.join(common, "anchor"))
    contexts = steps.keep(met.groupBy(CONTEXT).agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "count")).alias("one")))
    # Every stretch gets its context's count; those of lone contexts say nothing.
    whole = met.join(contexts.select(*CONTEXT, "n"), CONTEXT).select(
        *KEY, F.when(F.col("n") > 1, F.struct("first", "count")).alias("repeat"))
    mixed = steps.keep(contexts.groupBy("anchor").count().filter("count > 1").select("anchor"))
    probes = contexts.join(mixed, "anchor").groupBy(*[F.col(f"one.{k}").alias(f"probe_{k}") for k in KEY]).agg(
        F.collect_list(F.struct("one.first", "one.count", (F.col("n") == 1).alias("lone"))).alias("probes"))
    # Both uses of the texts take the same columns, so that Spark deals the texts out once; dealt for the
    # joins alone, the rows of a repeated key can be split.
    windows = keyed.join(probes, _same("probe")).select(*KEY, "doc", "probes").mapInArrow(
        returning(_windows(length)), f"{longs.format(*WINDOW)}, {longs.format(*KEY)}, first int, lone boolean")
    shared = windows.groupBy(WINDOW).agg(F.count("*").alias("n")).filter("n > 1").select(WINDOW)
    edges = windows.filter("lone").join(shared, WINDOW).select(
        *KEY, F.struct("first", F.lit(1).alias("count")).alias("repeat"))
    repeats = whole.union(edges).groupBy(*[F.col(k).alias(f"repeat_{k}") for k in KEY]).agg(
        F.collect_set("repeat").alias("repeats"))  # rows with equal keys bring the same stretches
    out = keyed.join(repeats, _same("repeat"), "left").select("doc", "repeats")
    schema = out.select("doc", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                        F.lit("").alias("kept_text")).schema
    return out.mapInArrow(returning(_cut(length)), schema)
