"""Terms of a dictionary table in texts, by an index of q-grams.

A gram is Q bytes in a row of a lower-case term or text, or all of a term that is shorter.  Every
term names one of its grams, the rarest, as its anchor.  A text with the term holds the anchor, so texts probe the anchors
with their distinct grams, an equi-join, and whatever meets is verified on the text itself.

Most grams of a text are no anchor.  A bitmap of the anchors, sized by the dictionary and of 8 MB at
most, goes to the tasks and keeps them from coming out; what it lets through by chance finds no partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.session import Steps

Q = 4
MOST_BITS = 1 << 26
SAMPLED_ROWS = 1_000  # texts that tell how rare grams are; the answer doesn't depend on them
SLICE_BYTES = 4 << 20


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """All runs of so many bytes as numbers, with their size above the fourth byte."""
    out = np.full(max(0, len(data) - size + 1), size << 32, np.int64)
    for k in range(size):
        out |= data[k:len(data) - size + 1 + k].astype(np.int64) << (8 * k)
    return out


def slot(grams: np.ndarray, bits: int) -> np.ndarray:
    """Place in a bitmap, whose size is a power of two."""
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts without nulls."""
    _, at, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _distinct(column: pa.Array, sizes: list[int], admitted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and grams, each gram once a row, some megabytes of text at a time."""
    data, offsets = _spans(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        part, ends = data[offsets[low]:offsets[high]], offsets[low + 1:high + 1] - offsets[low]
        for size in sizes:
            found = grams(part, size)
            at = np.arange(len(found)) if admitted is None else np.flatnonzero(admitted[slot(found, len(admitted))])
            row = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[np.minimum(row, len(ends) - 1)]  # doesn't go on into the next text
            row, found = row[inside], found[at[inside]]
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (found[1:] != found[:-1])][:len(row)]
            yield low + row[new], found[new]
        low = high


def _batches(column: pa.Array, rows: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), 50_000):
        part = slice(low, low + 50_000)
        yield pa.RecordBatch.from_arrays([column.take(pa.array(rows[part])), pa.array(found[part])], names=["row", "gram"])


def _probes(sizes: list[int], bitmap: Broadcast | None):
    """Distinct grams of texts; those of other sizes, or that the bitmap doesn't know, are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admitted = bitmap.value if bitmap is not None else None
        for batch in batches:
            for rows, found in _distinct(batch.column(1), sizes, admitted):
                yield from _batches(batch.column(0), rows, found)
    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of terms: of Q bytes, or the whole of a shorter term."""
    for batch in batches:
        found = [grams(np.frombuffer(low.encode(), np.uint8), min(Q, len(low.encode()))) for low in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        yield from _batches(batch.column(0), rows, np.concatenate([np.zeros(0, np.int64), *found]))


def _bitmap(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits, bool)
        for batch in batches:
            out[slot(batch.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])
    return run


def _candidates(df: DataFrame, row_id: str, body: str, vocab: DataFrame, term: str, steps: Steps) -> DataFrame:
    """(row, term, low): the lower-case terms whose anchors the rows' texts hold."""
    spark, kind = df.sparkSession, df.schema[row_id].dataType.simpleString()
    texts = df.select(F.col(row_id).alias("row"), X.lowered(F.col(body)).alias("text")).filter(F.col("text") != "")
    terms = steps.keep(vocab.select(F.col(term).alias("term")).filter(F.col("term") != "").distinct().select(
        "term", F.lower("term").alias("low")))
    sizes = sorted(r[0] for r in terms.select(F.least(F.octet_length("low"), F.lit(Q))).distinct().collect())  # at most Q
    held = texts.limit(SAMPLED_ROWS).mapInArrow(_probes(sizes, None), f"row {kind}, gram long").groupBy("gram").agg(
        F.count("*").alias("n"))
    own = terms.mapInArrow(_own, "row string, gram long").distinct()
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).getField("gram")
    anchors = steps.keep(own.join(held, "gram", "left").groupBy(F.col("row").alias("term")).agg(rarest.alias("gram")).join(terms, "term"))
    bits = min(MOST_BITS, 1 << max(16, (16 * anchors.count()).bit_length()))
    admitted = np.zeros(bits, bool)
    for r in anchors.select("gram").mapInArrow(_bitmap(bits), "bits binary").toLocalIterator():
        admitted |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    bitmap = spark.sparkContext.broadcast(admitted)
    probes = texts.mapInArrow(_probes(sizes, bitmap), f"row {kind}, gram long")
    # Written by itself, so that a gram that many texts hold can be split in the join.
    return steps.keep(steps.keep(probes).join(anchors, "gram").select("row", "term", "low"))


def _found(df: DataFrame, row_id: str, body: str, vocab: DataFrame, term: str, holds: Column) -> DataFrame:
    steps = Steps(df.sparkSession, "dictionary")
    candidates = _candidates(df, row_id, body, vocab, term, steps)
    texts = df.select(F.col(row_id).alias("row"), X.lowered(F.col(body)).alias("text"))
    return texts.join(candidates, "row").filter(holds).select(F.col("row").alias(row_id), F.col("term").alias(term))


def match_substrings(df: DataFrame, row_id: str, body: str, vocab: DataFrame, term: str = "term") -> DataFrame:
    """(row, term) pairs of the terms that occur anywhere in a text, inside words too, in any case.

    For vocabularies of any size, read from a table.  ``row_id`` tells the rows apart.  Null and empty texts
    hold no term, null and empty terms are in no text, and a term that is listed twice counts once.
    """
    return _found(df, row_id, body, vocab, term, F.contains("text", "low"))


def match_vocab(df: DataFrame, row_id: str, body: str, vocab: DataFrame, term: str = "term") -> DataFrame:
    """(row, term) pairs of the terms that occur between word boundaries; else as :func:`match_substrings`."""
    # boundaries of ASCII words, on which a term that begins or ends with another character needs a word beside it
    before = F.when(F.rlike("low", F.lit(r"^\w")), r"(?<!\w)").otherwise(r"(?<=\w)")
    after = F.when(F.rlike("low", F.lit(r"\w\z")), r"(?!\w)").otherwise(r"(?=\w)")
    literal = F.concat(before, F.lit(r"\Q"), F.replace("low", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), after)
    return _found(df, row_id, body, vocab, term, F.contains("text", "low") & F.rlike("text", literal))
