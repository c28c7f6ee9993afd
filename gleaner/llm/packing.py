"""Packing of tokenised documents into fixed windows with a bounded number of open ones.

Each partition is packed as it streams by: whole windows are cut off long documents, and the
rest goes to the open window with the least room that still holds it.  Where none does and
the bound is reached, the fullest open window is emitted.  The windows left open at the end
of the partitions are then merged by best fit, in groups of bounded size.

Token ids come from runs of text between ASCII white space, which the tokenizer never joins,
so each distinct run is encoded once by a worker and looked up by its fingerprint from then on.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.grams import Slice, equal_spans, slices
from gleaner.llm.memory import returning
from gleaner.session import Steps, small_batches

CACHED_WORDS, CACHED_BYTES = 500_000, 16 << 20  # known words, of some 50 bytes each, and their own bytes, beyond which a worker begins anew
SLICE_BYTES = 1 << 20  # text whose distinct words are looked up together
MERGED_AT_ONCE = 4096  # open windows merged in one group
BROADCAST_WINDOWS = 500_000  # up to so many merged windows, of 24 bytes each, are broadcast
END = 1
ODD = regex.compile("[^\n -~]")  # what the byte alphabet shows as another character


class Encoder:
    """Token ids of whole texts, each with the end id appended.

    The tokenizer's own normaliser and splitter spend most of its time on keeping track of
    character offsets.  Both steps are done here on distinct words instead, by the rules in
    the vocabulary file, and its model gets what comes out: letters of the byte alphabet,
    blanks between words.  Every token's last id, and no other, stands for an end of word.
    Words that hold an added token of the file go to the tokenizer as it is, unless special
    tokens are to be encoded as ordinary text; it is loaded when the first such word turns up.
    What words are known lies in arrays, sorted by the words' fingerprints, with the words' bytes:
    a fingerprint finds a word, its bytes tell whether it is the one.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        model, names = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if names != ["NFC", "Replace", "Lowercase"] or not split["invert"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} is not a lower-case vocabulary with word ends")
        self.pattern = regex.compile("\n|" + split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(spec | bare))
        added = [t for t in spec["added_tokens"] if not (encode_special_tokens and t["special"])]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"] or regex.search(r"\s", t["content"]) for t in added):
            raise ValueError(f"{path} has added tokens that can't be found within a word")
        self.path, self.special = path, encode_special_tokens
        self.added = regex.compile(b"|".join(regex.escape(t["content"].encode()) for t in added)) if added else None
        self.final = np.zeros(1 + max(model["vocab"].values()), bool)
        self.final[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte alphabet shows as they are
        self.alphabet = np.zeros(256, "<u2")
        self.alphabet[shown] = shown
        self.alphabet[[b for b in range(256) if b not in shown]] = 256 + np.arange(256 - len(shown))
        self.alphabet[[10, 32]] = 32
        self.forget()

    def forget(self) -> None:
        """Know no word."""
        self.prints = np.zeros(0, np.uint64)
        self.starts, self.lengths, self.spelt, self.ends = (np.zeros(0, np.int64) for _ in range(4))
        self.flat = np.zeros(0, "<u4")  # ids of the known words, one after the other
        self.bytes = np.zeros(0, np.uint8)  # and their bytes, from spelt to ends

    @cached_property
    def whole(self):
        """The tokenizer as it is in the file."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = self.special
        return whole

    def split(self, words: list[bytes]) -> tuple[str, list[int]]:
        """The words' tokens with a blank between any two, and how many each word has."""
        text = b"\n".join(words).decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower() would look at the neighbours
        text = " ".join(self.pattern.findall(text.lower()))
        counts = [len(part.split(" ")) - 2 for part in f" {text} ".split("\n")]
        return text, counts

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        if self.added is None or not self.added.search(b"\n".join(words)):
            return self.encode_plain(words)
        special = np.array([self.added.search(w) is not None for w in words])
        plain, counts = self.encode_plain([w for w, s in zip(words, special.tolist(), strict=True) if not s])
        found = [e.ids for e in self.whole.encode_batch_fast(
            [w.decode() for w, s in zip(words, special.tolist(), strict=True) if s], add_special_tokens=False)]
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        lengths[~special], lengths[special] = counts, [len(i) for i in found]
        starts[~special] = np.cumsum(counts) - counts
        starts[special] = len(plain) + np.cumsum(lengths[special]) - lengths[special]
        flat = np.concatenate([plain, *[np.array(i, "<u4") for i in found]])
        return flat[spread(starts, lengths)], lengths

    def encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without added tokens."""
        flat, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for low in range(0, len(words), 1024):
            joined, counts = self.split(words[low:low + 1024])
            if ODD.search(joined):
                joined = self.alphabet[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.r_[0, 1 + np.flatnonzero(self.final[ids])][np.cumsum([0, *counts])]
            flat.append(ids)
            lengths.append(np.diff(ends))
        return np.concatenate(flat), np.concatenate(lengths)

    def learn(self, part: Slice, prints: np.ndarray, first: np.ndarray) -> None:
        """Have the ids of the slice's distinct words, given by fingerprint and one place of each."""
        if len(self.prints) > CACHED_WORDS or len(self.bytes) > CACHED_BYTES:
            self.forget()
        at = np.searchsorted(self.prints, prints)
        new = np.ones(len(prints), bool)
        inside = at < len(self.prints)
        new[inside] = self.prints[at[inside]] != prints[inside]
        if new.any():
            starts, ends = part.starts[first[new]], part.ends[first[new]]
            data = part.data.tobytes()
            flat, lengths = self.encode([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            spans = ends - starts
            spelt = len(self.bytes) + np.cumsum(spans) - spans
            for name, values in (("prints", prints[new]), ("starts", len(self.flat) + np.cumsum(lengths) - lengths),
                                 ("lengths", lengths), ("spelt", spelt), ("ends", spelt + spans)):
                setattr(self, name, np.insert(getattr(self, name), at[new], values))
            self.flat = np.concatenate([self.flat, flat])
            self.bytes = np.concatenate([self.bytes, part.data[spread(starts, spans)]])

    def ids(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slice's texts, and where each text's begin and end."""
        prints, first, place = np.unique(part.hashes, return_index=True, return_inverse=True)
        self.learn(part, prints, first)
        known = np.searchsorted(self.prints, prints)
        # every word against the known one of its fingerprint; those that differ are encoded by themselves
        mine = known[place]
        strange = np.flatnonzero(~equal_spans((part.data, part.starts, part.ends), (self.bytes, self.spelt[mine], self.ends[mine])))
        others, other_lengths = self.encode([part.data[part.starts[w]:part.ends[w]].tobytes() for w in strange.tolist()])
        # after its words each text has the end id, which is kept as one more word
        starts = np.r_[self.starts[known], len(self.flat), len(self.flat) + 1 + np.cumsum(other_lengths) - other_lengths]
        lengths = np.r_[self.lengths[known], 1, other_lengths]
        place[strange] = len(prints) + 1 + np.arange(len(strange))
        order = np.insert(place, part.first[1:], len(prints))
        counts = np.r_[0, np.cumsum(lengths[order])]
        out = np.concatenate([self.flat, np.array([END], "<u4"), others])[spread(starts[order], lengths[order])]
        return out, counts[part.first + np.arange(len(part) + 1)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the runs (start, length), one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def encoder(path: str, encode_special_tokens: bool) -> Encoder:
    """The encoder of this Python worker: later tasks of the worker find it with the words it knows.

    It hangs on a module of the interpreter, since this one comes to the worker anew with each task.
    """
    kept = sys.__dict__.setdefault("_gleaner_encoders", {})
    key = (path, encode_special_tokens)
    if key not in kept:
        kept[key] = Encoder(*key)
    return kept[key]


class Packer:
    """Open windows of one partition; window numbers count up from a base."""

    def __init__(self, window: int, most_open: int, base: int):
        self.window, self.most_open, self.next = window, most_open, base
        self.open: list[tuple[int, int]] = []  # room, window; sorted by room

    def place(self, length: int) -> tuple[int, int]:
        """The window and offset for a piece; windows that leave the open set take no more."""
        if length < self.window:
            k = bisect_left(self.open, (length, -1))
            if k < len(self.open):
                room, number = self.open.pop(k)
                if room > length:
                    insort(self.open, (room - length, number))
                return number, self.window - room
            if len(self.open) == self.most_open:
                self.open.pop(0)
        number, self.next = self.next, self.next + 1
        if length < self.window:
            insort(self.open, (self.window - length, number))
        return number, 0


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "window", "offset", "ids"]


def _pack(path: str, window: int, most_open: int, with_ids: bool, encode_special_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path, encode_special_tokens), Packer(window, most_open, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row, part in slices(batch.column(1), size=SLICE_BYTES):
                ids, ends = coder.ids(part)
                rows, out = [], {c: [] for c in COLUMNS}
                for i in range(len(part)):
                    mine = ids[ends[i]:ends[i + 1]]
                    for start in range(0, len(mine), window):
                        piece = mine[start:start + window]
                        number, offset = packer.place(len(piece))
                        rows.append(row + i)
                        for c, v in zip(COLUMNS, (start, len(piece), zlib.crc32(piece.tobytes()), len(mine), number, offset), strict=False):
                            out[c].append(v)
                arrays = [pa.array(out[c], pa.int64()) for c in COLUMNS[:-1]]
                if with_ids:  # the pieces, in order, are the ids
                    arrays.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(out["length"])].astype(np.int32), ids.view(np.int32)))
                else:
                    arrays.append(pa.nulls(len(rows), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *arrays], names=["doc_id", *COLUMNS])
    return run


def _merge(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Best fit, largest first; a sequence takes the number of its first window."""
        rows = rows.sort_values(["fill", "window"], ascending=[False, True])
        open_, out = [], []
        for number, fill in zip(rows["window"], rows["fill"], strict=True):
            k = bisect_left(open_, (fill, -1))
            room, sequence = open_.pop(k) if k < len(open_) else (window, number)
            out.append((number, sequence, window - room))
            if room > fill:
                insort(open_, (room - fill, sequence))
        return pd.DataFrame(out, columns=["old", "sequence_id", "moved"])
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, most_open: int = 64, with_ids: bool = True,
         encode_special_tokens: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    A document is the ids of its whole text and then id 1; a null or empty text is id 1
    alone.  Pieces are cut every `window` ids; start counts the document's ids before the
    piece, offset those of its sequence before it.  No sequence exceeds the window.  Rows
    that repeat a doc_id, or have none, are packed like others.  `tokenizer` is the path of
    the vocabulary file, the same on every machine.  `encode_special_tokens` is the tokenizer's
    switch of that name: special tokens in a text are ordinary text, or else their own ids.
    Needs the columns doc_id and text.
    """
    small_batches(docs.sparkSession)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, ids array<int>"
    steps = Steps(docs.sparkSession, "pack")
    pieces = steps.keep(docs.select("doc_id", "text").mapInArrow(
        returning(_pack(tokenizer, window, most_open, with_ids, encode_special_tokens)), fields))
    fills = steps.keep(pieces.groupBy("window").agg(F.sum("length").alias("fill")).filter(F.col("fill") < window))
    still_open = fills.count()
    groups = still_open // MERGED_AT_ONCE + 1
    merged = steps.keep(fills.groupBy(F.pmod(F.xxhash64("window"), F.lit(groups)).alias("g")).applyInPandas(
        _merge(window), "old long, sequence_id long, moved long"))
    if still_open <= BROADCAST_WINDOWS:
        merged = F.broadcast(merged)
    placed = pieces.join(merged, F.col("window") == F.col("old"), "left")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("sequence_id", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("moved", F.lit(0))).alias("offset"), *["ids"] * with_ids)
