"""Exact search for the largest inner products by segment statistics of several resolutions.

Of a segment of w dimensions only the mean and the deviation are looked at first.  For segments
of q and c, w * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2) is at most their squared distance, so
the sum over a vector's segments bounds its distance from below, and with the lengths of the two
vectors its inner product from above.  Bounds go from one segment to many; a pair stays as long as
its bound reaches the query's k-th best score so far, and what is left is worked out exactly.

Queries go out in passes of bounded size over all candidates, a chunk of candidates against
the queries of a pass as one matrix product.  A pass has two rounds: an eighth of the candidates first, from
which every query gets a score that its results must reach; then the others, of which each task only
passes on what reaches it, some eight times k rows a query however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.vectors import EXACT, matrix, widened
from gleaner.session import Steps, small_batches

SEGMENTS = (1, 4, 16)
BLOCK = 512  # queries packed into one row
PASS_BYTES, PASS_ROWS = 32 << 20, 1 << 16  # a pass holds half as many on average, dealt by block
QUERY_TILE = 1024
FIRST = 8  # one candidate in so many sets the scores to reach


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of a vector's segments, scaled so that two such rows' product bounds that of the vectors."""
    width = -(-x.shape[1] // segments)
    parts = widened(x, width * segments).reshape(len(x), segments, width)
    means = parts.mean(2) if width else np.zeros((len(x), segments))
    rest = np.sqrt(((parts - means[:, :, None]) ** 2).sum(2))
    return np.concatenate([np.sqrt(width) * means, rest], axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows of whole numbers, as longs; what lies beyond a long is the nearest one."""
    out = np.einsum("ij,ij->i", q, c)
    loose = np.flatnonzero(np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1) >= EXACT)
    scores = np.zeros(len(out), np.int64)
    safe = np.ones(len(out), bool)
    safe[loose] = False
    scores[safe] = out[safe].astype(np.int64)
    for i in loose.tolist():
        total = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[i].tolist(), strict=True))
        scores[i] = max(-(1 << 63), min((1 << 63) - 1, total))
    return scores


class Search:
    """The best candidates of a pass's queries that one task has come across."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, reach: np.ndarray, k: int):
        self.q, self.ids, self.reach, self.k = q, ids, reach.copy(), k
        self.coarse = {}
        self.norms = np.linalg.norm(q, axis=1)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        self.held = 0

    def add(self, c: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Search a chunk of candidates; those without an id are `missing` it."""
        dims = max(c.shape[1], self.q.shape[1])
        if self.q.shape[1] < dims:
            self.q, self.coarse = widened(self.q, dims), {}
        c = widened(c, dims)
        if not self.coarse:
            self.coarse = {s: features(self.q, s) for s in SEGMENTS}
        coarse = {s: features(c, s) for s in SEGMENTS}
        longest = np.linalg.norm(c, axis=1).max(initial=0)
        for low in range(0, len(self.q), QUERY_TILE):
            tile = np.arange(low, min(low + QUERY_TILE, len(self.q)))
            limit = self.reach[tile] - 0.5 - 1e-9 * self.norms[tile] * longest
            at, of = self._survivors(tile, c, coarse, limit, longest, ids, missing)
            scores = exact(self.q[at], c[of])
            good = (scores >= self.reach[at]) & ((ids[of] != self.ids[at]) | missing[of])
            self.found.append((at[good], scores[good], ids[of[good]], missing[of[good]]))
            self.held += int(good.sum())
            if self.held > max(100_000, 2 * self.k * len(self.q)):
                self.trim()

    def _survivors(self, tile, c, coarse, limit, longest, ids, missing) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that every bound lets through."""
        rows, columns, alive, pairs = tile, np.arange(len(c)), None, None
        for s in SEGMENTS:
            if pairs is None:
                ok = self.coarse[s][rows] @ coarse[s][columns].T >= limit[rows - tile[0], None]
                if alive is not None:
                    ok &= alive
                if 20 * np.count_nonzero(ok) < ok.size:
                    i, j = np.nonzero(ok)
                    pairs = rows[i], columns[j]
                else:
                    up, across = ok.any(1), ok.any(0)
                    rows, columns, alive = rows[up], columns[across], ok[np.ix_(up, across)]
            else:
                ok = np.einsum("ij,ij->i", self.coarse[s][pairs[0]], coarse[s][pairs[1]]) >= limit[pairs[0] - tile[0]]
                pairs = pairs[0][ok], pairs[1][ok]
        if pairs is not None:
            return pairs
        # many are left: one product narrows them to those that may be among the best of this chunk
        near = np.where(alive & ((self.ids[rows][:, None] != ids[columns]) | missing[columns]),
                        self.q[rows] @ c[columns].T, -np.inf)
        low = limit[rows - tile[0]]
        if len(columns) >= self.k:
            kth = np.partition(near, len(columns) - self.k, axis=1)[:, len(columns) - self.k]
            low = np.maximum(low, kth - 0.5 - 1e-9 * self.norms[rows] * longest)
        i, j = np.nonzero((near >= low[:, None]) & (near > -np.inf))
        return rows[i], columns[j]

    def trim(self) -> tuple[np.ndarray, ...]:
        """Keep each query's k best; candidates without an id come last among equals."""
        at, scores, ids, missing = map(np.concatenate, zip(*self.found, strict=True))
        order = np.lexsort((ids, missing, -scores, at))
        at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        order = order[nth < self.k]
        full = nth == self.k - 1
        self.reach[at[full]] = np.maximum(self.reach[at[full]], scores[order[nth[nth < self.k] == self.k - 1]])
        at = at[nth < self.k]
        self.found = [(at, scores[order], ids[order], missing[order])]
        self.held = len(at)
        return self.found[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            x = matrix(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([x.shape[1]], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "dims", "data"])
            number += 1


def _search(queries: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, x, reach = queries.value
        search = Search(x, ids, reach, k)
        for batch in batches:
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            search.add(matrix(batch.column(1)), batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), missing)
        at, scores, found, missing = search.trim()
        for low in range(0, len(at), 10_000):
            part = slice(low, low + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[at[part]]), pa.array(ids[at[part]]), pa.array(found[part], mask=missing[part]),
                 pa.array(scores[part])], names=["query", "query_id", "vec_id", "score"])
    return run


def _loaded(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids and vectors of a pass's queries."""
    rows = blocks.toArrow().sort_by("block").to_pylist()
    dims = max(r["dims"] for r in rows)
    x = [widened(np.frombuffer(r["data"]).reshape(len(r["ids"]), r["dims"]), dims) for r in rows]
    numbers = [(r["block"] << 10) + np.arange(len(r["ids"])) for r in rows]
    return np.concatenate(numbers), np.concatenate([np.array(r["ids"], np.int64) for r in rows]), np.concatenate(x)


def top_k(vectors: DataFrame, is_query: Column, k: int, steps: Steps) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score.

    vectors holds vec_id and x, an array of whole numbers as doubles; is_query picks the
    queries by vec_id, and every row with another vec_id is a candidate.  The score is the inner product as a
    long (the nearest one, where it lies beyond); larger is better, ties go to the smaller vec_id, null
    ids last.  Fewer candidates than k all come out.  Rows that repeat an id are queries and candidates of
    their own, but no candidates of each other's queries.  Shorter vectors count as having zeros at
    their end; components stay within the range of 32-bit floats.  Without queries or candidates
    the result is empty.

    The queries of a pass, some 32 MB at most, are sent to all tasks; nothing else is collected but
    their k-th scores.  A task holds k rows a query of the pass.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    vectors = vectors.select("vec_id", "x")
    blocks = steps.keep(vectors.filter(is_query).mapInArrow(_blocks, "block long, ids array<long>, dims long, data binary"))
    size = blocks.agg(F.sum(F.octet_length("data")).alias("bytes"), F.sum(F.size("ids")).alias("rows")).first()
    passes = 2 * max((size["bytes"] or 0) // PASS_BYTES, (size["rows"] or 0) // PASS_ROWS) + 1
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    first = F.pmod(F.xxhash64("vec_id"), F.lit(FIRST)) == 0
    fields = "query long, query_id long, vec_id long, score long"

    def ranked(rows: DataFrame) -> DataFrame:
        return steps.keep(rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))

    def found_by(candidates: DataFrame, queries: tuple) -> DataFrame:
        sent = sc.broadcast(queries)
        rows = steps.keep(candidates.mapInArrow(_search(sent, k), fields))
        sent.destroy()
        return rows

    parts = []
    for p in range(passes):
        mine = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(passes)) == p)
        if mine.isEmpty():
            continue
        numbers, ids, x = _loaded(mine)
        reach = np.full(len(ids), -np.inf)
        early = ranked(found_by(vectors.filter(first), (numbers, ids, x, reach)))
        told = early.filter(F.col("rank") == k).select("query", "score").toArrow()
        reach[np.searchsorted(numbers, told["query"].to_numpy())] = told["score"].to_numpy()
        late = found_by(vectors.filter(~first), (numbers, ids, x, reach))
        parts.append(ranked(early.drop("rank").union(late)))
    if not parts:
        parts = [spark.createDataFrame([], f"{fields}, rank int")]
    return reduce(DataFrame.union, parts).select("query_id", "rank", "vec_id", "score")
