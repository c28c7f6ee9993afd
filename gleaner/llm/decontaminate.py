"""Benchmark passages in documents, found by greedy string tiling.

Documents are scanned against an index of the runs of MIN_MATCH tokens in the test items.  A
pair with shared runs goes on if these cover enough of the item, which bounds from above what
tiles can cover.  Tiling then marks the longest common run of unmarked tokens, again and again
down to MIN_MATCH tokens; Karp-Rabin fingerprints of all runs of a length tell which are
common.  A token is in one tile at most, so a passage whose sentences were put in another
order is covered as well as the original, and words that merely occur in both are not.

The test set is the query set.  Its index is broadcast, in blocks of at most BLOCK_TOKENS
tokens.  A larger set makes more blocks: the leaks found with one are written before the next is sent out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import grams
from gleaner.llm.toxicity import GAPS
from gleaner.llm.memory import returning
from gleaner.session import Steps, small_batches

U = np.uint64
MIN_MATCH = 5
BLOCK_TOKENS = 1_000_000
# Scripts written without spaces, each character of which is a token, and what beyond ASCII stands between tokens.
ALONE = "[" + "".join(rf"\p{{{script}}}" for script in (
    "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tai_Le New_Tai_Lue Tai_Tham Javanese Balinese".split())) + r"\x{30FC}\x{FF70}]"
BETWEEN = r"[^\x00-\x7F\p{L}\p{M}\p{N}]"
LEAK = "array<struct<item_id: long, item_tokens: int, covered_tokens: int, tiles: int, longest: int, coverage: double>>"


def tokens(column: pa.Array) -> Iterator[tuple[int, grams.Slice]]:
    """Lower-case runs of letters, their marks, and digits; single characters in scripts written without spaces."""
    texts = pc.utf8_lower(column.cast(pa.large_string()))
    odd = pc.fill_null(pc.match_substring_regex(texts, f"{BETWEEN}|{ALONE}"), False)
    if pc.any(odd).as_py():
        parted = pc.replace_substring_regex(pc.replace_substring_regex(texts.filter(odd), f"{BETWEEN}+", " "), f"({ALONE})", r" \1 ")
        texts = pc.replace_with_mask(texts, odd, parted)
    return grams.slices(texts, False, GAPS)


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (pattern position, text position, length), longest first, no token in two of them."""
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    runs_p, runs_t = grams.Runs(pattern), grams.Runs(text)
    found = []

    def unmarked(free: np.ndarray, length: int) -> np.ndarray:
        sums = np.r_[0, np.cumsum(free)]
        return np.flatnonzero(sums[length:] - sums[:-length] == length) if len(free) >= length else np.zeros(0, int)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at_p, at_t = unmarked(free_p, length), unmarked(free_t, length)
        print_p, print_t = runs_p.windows(length)[at_p], runs_t.windows(length)[at_t]
        return at_p[np.isin(print_p, print_t)], at_t, print_t, runs_p.windows(length)

    high = min(len(pattern), len(text))
    while high >= least:
        low, best = least, 0  # a longer common run holds shorter ones, so the longest is found by halving
        while low <= high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                best, low = middle, middle + 1
            else:
                high = middle - 1
        if not best:
            break
        at_p, at_t, print_t, prints = common(best)
        for p in at_p:
            if free_p[p:p + best].all():
                for t in at_t[print_t == prints[p]]:
                    if free_t[t:t + best].all() and (pattern[p:p + best] == text[t:t + best]).all():
                        free_p[p:p + best] = free_t[t:t + best] = False
                        found.append((int(p), int(t), best))
                        break
        high = best - 1  # every run of this length was tried
    return found


class Index:
    """The test items of one block, and where each run of MIN_MATCH tokens stands in them."""

    def __init__(self, items: pa.Table, least: int):
        self.ids, self.items, prints, owner, place = [], [], [], [], []
        ids = items["item_id"].to_pylist()
        for row, part in tokens(items["text"].combine_chunks()):
            for i in range(len(part)):
                words = part.words(i).copy()
                if len(words) >= least:
                    runs = grams.Runs(words).windows(least)
                    prints.append(runs)
                    owner.append(np.full(len(runs), len(self.items)))
                    place.append(np.arange(len(runs)))
                    self.ids.append(ids[row + i])
                    self.items.append(words)
        self.prints, self.owner, self.place = (
            np.concatenate(x) if x else np.zeros(0, t) for x, t in ((prints, U), (owner, int), (place, int)))
        order = np.argsort(self.prints, kind="stable")
        self.prints, self.owner, self.place = self.prints[order], self.owner[order], self.place[order]
        self.seen = np.zeros(1 << 20, bool)  # by the upper bits, to pass over most runs quickly
        self.seen[self.prints >> U(44)] = True

    def hits(self, prints: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[prints >> U(44)])
        return maybe[np.isin(prints[maybe], self.prints)]


def leaks(index: Index, words: np.ndarray, prints: np.ndarray, at: np.ndarray, least: int, share: float) -> list[dict]:
    """Items of the block that tiles cover to the share, from a document's shared runs."""
    low, high = (np.searchsorted(index.prints, prints[at], side) for side in ("left", "right"))
    entry = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
    start = np.repeat(at, high - low)
    out = []
    for item in np.unique(index.owner[entry]):
        mine = index.owner[entry] == item
        pattern = index.items[item]
        covered = np.zeros(len(pattern), bool)
        for k in range(least):
            covered[index.place[entry[mine]] + k] = True
        if covered.sum() < share * len(pattern):
            continue
        inside = np.zeros(len(words), bool)
        for k in range(least):
            inside[start[mine] + k] = True
        # Other tokens can be in no tile; one stand-in keeps the stretches apart.
        kept = inside | np.r_[False, inside[:-1]]
        text = np.where(inside, words, U(0))[kept]
        tiles = tile(pattern, text, least)
        total = sum(n for _, _, n in tiles)
        if total >= share * len(pattern):
            out.append({"item_id": index.ids[item], "item_tokens": len(pattern), "covered_tokens": total,
                        "tiles": len(tiles), "longest": tiles[0][2], "coverage": total / len(pattern)})
    return out


def _scan(index: Broadcast, least: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            found = batch.column(1).to_pylist()
            for row, part in tokens(pc.struct_field(batch.column(0), "text")):
                prints = grams.Runs(part.hashes).windows(least)
                at = block.hits(prints)
                text = np.searchsorted(part.first, at, "right") - 1
                whole = at + least <= part.first[text + 1]  # the run doesn't go on into the next text
                at, text = at[whole], text[whole]
                for i in np.unique(text):
                    first = part.first[i]
                    mine = at[text == i] - first
                    found[row + i] += leaks(block, part.words(i), prints[first:], mine, least, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, batch.schema.field(1).type)], schema=batch.schema)
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, least: int = MIN_MATCH) -> DataFrame:
    """One row per document: doc (a struct of the given columns) and leaks.

    leaks lists the items of which tiles of at least `least` tokens cover `share` or more:
    item_id, item_tokens, covered_tokens, tiles, longest, coverage.  Tokens are lower-case
    runs of letters and digits, or single characters where a script has no spaces.  Null and empty texts have no leaks; items of fewer than
    `least` tokens, or without text, match nothing.  Repeated documents and items each get
    their own entry, and a null doc_id or item_id is carried along.  Needs the columns text
    of docs, item_id and text of benchmark; other columns, of whatever name, stay in doc.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.array().cast(LEAK).alias("leaks"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // (4 * BLOCK_TOKENS) + 1
    steps = Steps(spark, "leaks")
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        index = spark.sparkContext.broadcast(Index(part.toArrow(), least))
        rows = rows.mapInArrow(returning(_scan(index, least, share)), rows.schema)
        if block + 1 < blocks:
            rows = steps.keep(rows)
            index.destroy()
    return rows

