"""MinHash near-duplicates with SuperMinHash signatures.

1. One pass makes each text's shingle set, its fingerprint and its banded signature.
   Texts with equal sets form a class, so exact copies cost one row from here on.
2. Classes that share a band hang on the band's smallest class; connected components of
   these stars are families.  A link can only lie within a family.
3. Each family's full sets meet once, and links are confirmed on them.  Families too large
   for one task are compared block against block; block pairs that are already connected
   are left out.
4. Union-find within tasks and star contraction across them give the components.

Signatures follow SuperMinHash: an element ranks the positions by a permutation of its own,
and a position keeps the least (rank, fraction).  Ranks of one element are correlated, which
lowers the variance, and steps stop once every position holds a rank below the next one.
The number of positions is a prime and permutations are affine maps modulo it: any two
positions then get each ordered pair of ranks equally often, as with shuffled permutations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import grams
from gleaner.llm.components import components
from gleaner.llm.memory import give_back, returning
from gleaner.session import Steps, materialize, small_batches

U = np.uint64
POSITIONS = 257
BANDS, ROWS = 42, 6  # at a similarity of 0.8 a pair misses every band with probability 3e-6
GROUP_SETS, GROUP_SHINGLES = 1500, 2_000_000  # a family within these is compared in one task
PIVOTS = 16
_order = np.argsort(grams.mix(np.arange(1, POSITIONS + 1, dtype=U)))[:BANDS * ROWS]


def shingle_sets(part: grams.Slice, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct fingerprints; a shorter text is one shingle, an empty one has none."""
    out = []
    for i, prints in enumerate(part.run_prints(size)):
        words = part.words(i)
        out.append(np.unique(prints) if len(words) >= size else grams.Runs(words).windows(len(words)) if len(words) else words)
    return out


def signature(elements: np.ndarray) -> np.ndarray:
    """SuperMinHash values of a set, one a position: the rank in the upper 16 bits."""
    m = POSITIONS
    step = (U(1) + grams.mix(elements ^ U(0xA5A5A5A5)) % U(m - 1))[:, None]
    start = (grams.mix(elements ^ U(0x5A5A5A5A5A)) % U(m))[:, None]
    out = np.full(m, np.iinfo(U).max, U)
    rank = 0
    while rank < m and int(out.max() >> U(48)) >= rank:
        wide = min(m - rank, 1 + int(2 * m * np.log(m)) // len(elements))
        ranks = np.arange(rank, rank + wide, dtype=U)[None, :]
        at = (start + step * ranks) % U(m)
        value = (ranks << U(48)) | (grams.mix(elements[:, None] + ranks * U(0x9E3779B97F4A7C15)) >> U(16))
        np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
        rank += wide
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """One key a band, different between bands."""
    rows = values[_order].reshape(BANDS, ROWS)
    keys = grams.mix(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    for k in range(ROWS):
        keys = grams.mix(keys * U(31) + rows[:, k])
    return keys


def _fingerprint(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in grams.slices(batch.column(2), fold=True):
                counts, prints, keys = [], [], []
                for elements in shingle_sets(part, size):
                    counts.append(len(elements))
                    prints.append(_fingerprint(elements))
                    keys.append(bands(signature(elements)).view(np.int64) if len(elements) else None)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(row, len(part)).columns[:2], pa.array(counts, pa.int64()),
                     pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "print", "bands"])
    return run


def _sets(size: int):
    """Full sets of the texts that stand for their classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(4).to_pylist()
            for row, part in grams.slices(batch.column(3), fold=True):
                found = shingle_sets(part, size)
                mine = [i for i, s in enumerate(found) if _fingerprint(s) == prints[row + i]]
                if mine:
                    picked = batch.slice(row, len(part)).take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays(
                        [*picked.columns[:3], pa.array([found[i].view(np.int64) for i in mine], pa.list_(pa.int64()))],
                        names=["cid", "family", "blocks", "elements"])
    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from 0/1 matrices over the elements both sides hold, some columns at a time."""
    vocabulary = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.searchsorted(vocabulary, flat)
        at[at == len(vocabulary)] = 0
        hit = vocabulary[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    if not len(vocabulary):
        return out
    (rows_l, cols_l), (rows_r, cols_r) = cells(left), cells(right)
    by_l, by_r = np.argsort(cols_l, kind="stable"), np.argsort(cols_r, kind="stable")
    rows_l, cols_l, rows_r, cols_r = rows_l[by_l], cols_l[by_l], rows_r[by_r], cols_r[by_r]
    for low in range(0, len(vocabulary), 2048):
        def dense(rows: np.ndarray, cols: np.ndarray, n: int, low: int = low) -> np.ndarray:
            part = slice(*np.searchsorted(cols, [low, low + 2048]))
            cell = np.zeros((n, 2048), np.float32)
            cell[rows[part], cols[part] - low] = 1
            return cell
        out += dense(rows_l, cols_l, len(left)) @ dense(rows_r, cols_r, len(right)).T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs reach the similarity, counted exactly."""
    inter = np.rint(_shared(left, right)).astype(np.int64)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
    return 100 * inter >= percent * union


def _roots(linked: np.ndarray) -> np.ndarray:
    """Union-find over a square matrix of links: each row's smallest reachable row."""
    parent = np.arange(len(linked))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(linked)):
        mine = find(i)
        near = np.flatnonzero(linked[i, i + 1:]) + i + 1
        for j in near[parent[near] != mine]:
            other = find(j)
            if other != mine:
                parent[max(mine, other)] = min(mine, other)
                mine = min(mine, other)
    return np.array([find(i) for i in range(len(linked))])


def _read(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = rows.drop_duplicates("cid").sort_values("cid")
    return rows["cid"].to_numpy(), [np.asarray(x, np.int64).view(U) for x in rows["elements"]]


def _within(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, sets = _read(rows)
        roots = _roots(_linked(sets, sets, percent))
        if len(ids) > 100:
            give_back()
        return pd.DataFrame({"a": ids, "b": ids[roots]}).query("a != b")
    return run


def _across(percent: int):
    """Links between two blocks whose members are not connected yet; one link a pair of components."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": []}
        sides = [rows[rows["side"] == k] for k in (0, 1)]
        if all(len(s) for s in sides):
            (a, x), (b, y) = map(_read, sides)
            root = dict(zip(rows["cid"], rows["root"], strict=True))
            ra, rb = np.array([root[k] for k in a]), np.array([root[k] for k in b])
            i, j = np.nonzero(_linked(x, y, percent) & (ra[:, None] != rb[None, :]))
            found = pd.DataFrame({"a": a[i], "b": b[j], "p": ra[i], "q": rb[j]}).drop_duplicates(["p", "q"])
            out = found[["a", "b"]]
            give_back()
        return pd.DataFrame(out, dtype="int64")
    return run


def _offsets(room: DataFrame, steps: Steps) -> DataFrame:
    """The sum of holds before each (family, root), about the largest first; from (family, root, holds, blocks).

    Roots are dealt to as many buckets as the family has blocks, within powers of two of their
    size.  Only the buckets' sums are added up in one task a family.
    """
    part = ["family", "power", "bucket"]

    def before(name: str, order: Window) -> Column:
        return F.coalesce(F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    room = steps.keep(room.select("family", "root", "holds", F.floor(F.log2("holds")).alias("power"),
                                  F.pmod(F.xxhash64("root"), F.col("blocks")).alias("bucket")))
    sums = room.groupBy(part).agg(F.sum("holds").alias("total"))
    sums = sums.withColumn("start", before("total", Window.partitionBy("family").orderBy(F.desc("power"), "bucket")))
    inner = before("holds", Window.partitionBy(part).orderBy(F.desc("holds"), "root"))
    return room.withColumn("inner", inner).join(sums.drop("total"), part).select(
        "family", "root", "holds", (F.col("start") + F.col("inner")).alias("before"))


def _large_families(members: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """Links within families that one task can't hold, from members (cid, family, blocks, elements)."""
    edge = "a long, b long"
    block = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    members = steps.keep(members.withColumn("block", block))
    rank = F.xxhash64("cid", F.lit(1))
    # The pivots of a family are the members of least hash: each block names its own few, and the least of these stay.
    first = members.select("family", "block", "blocks", "cid", rank.alias("h")).withColumn(
        "k", F.row_number().over(Window.partitionBy("family", "block").orderBy("h", "cid"))).filter(F.col("k") <= PIVOTS)
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy("h", "cid"))).filter(
        F.col("k") <= PIVOTS)
    pivots = members.join(first.select("cid"), "cid", "left_semi").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    near = steps.keep(members.union(pivots.select(members.columns)).groupBy("family", "block").applyInPandas(_within(percent), edge))
    roots = components(near, steps)
    placed = steps.keep(members.join(roots, F.col("cid") == F.col("node"), "left").select(
        "cid", "family", "blocks", "elements", F.coalesce("root", "cid").alias("root")))
    # Connected members go to the same blocks, so that most pairs of blocks have nothing left to compare.
    weight = F.sum(F.size("elements") + GROUP_SHINGLES // GROUP_SETS).alias("holds")
    room = _offsets(placed.groupBy("family", "root").agg(weight, F.max("blocks").alias("blocks")), steps)
    placed = placed.join(room, ["family", "root"]).withColumn("block", F.floor(
        (F.col("before") + F.pmod(F.xxhash64("cid"), F.col("holds"))) / F.lit(GROUP_SHINGLES)))
    placed = steps.keep(placed.select("cid", "family", "elements", "root", "block"))
    blocks = placed.groupBy("family", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr(
        "x.family = y.family and x.block <= y.block and not (x.low = x.high and y.low = y.high and x.low = y.low)"))
    pairs = steps.keep(pairs.select(F.col("x.family").alias("family"), F.col("x.block").alias("p"), F.col("y.block").alias("q")))
    sides = [placed.join(pairs.withColumn("block", F.col(name)), ["family", "block"]).withColumn("side", F.lit(k))
             for k, name in enumerate("pq")]
    far = sides[0].union(sides[1]).groupBy("family", "p", "q").applyInPandas(_across(percent), edge)
    return near.union(far)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash, chosen.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z folded.  Documents link
    when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is
    the smallest doc_id reachable and kept says whether it is the row's own.  A null or
    wordless text has no shingles and links with nothing.  Rows that repeat a doc_id are
    separate documents.  A null doc_id is passed over when the smallest is taken; a
    component without any id has a null component_id, and its rows count as kept.
    text_hash is the row's xxhash64 of the text, and chosen marks one text of each
    component (all rows of it, if it is repeated with its id).
    Needs the columns doc_id and text; others are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    with Steps(spark, "near") as steps:
        signed = steps.keep(docs.mapInArrow(
            returning(_sign(shingle_words)), "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>"))
        head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("head")
        classes = signed.filter("n_shingles > 0").groupBy("print").agg(
            head, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        classes = steps.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
        banded = classes.select("cid", F.explode("bands").alias("band"))
        # Aggregates that their own rows are joined to are written first, so that Spark can split a hot key's rows.
        hubs = steps.keep(banded.groupBy("band").agg(F.min("cid").alias("hub"), F.count("*").alias("c")).filter("c > 1"))
        families = components(banded.join(hubs, "band").select(
            F.col("cid").alias("a"), F.col("hub").alias("b")), steps)
        members = steps.keep(classes.drop("bands").join(families, F.col("cid") == F.col("node")).select(
            "cid", "print", "n", "head", F.col("root").alias("family")))
        sizes = steps.keep(members.groupBy("family").agg(F.greatest(
            F.ceil(F.count("*") / F.lit(GROUP_SETS)), F.ceil(F.sum("n") / F.lit(GROUP_SHINGLES))).alias("blocks")))
        wanted = members.join(sizes, "family")
        sets = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (
            F.col("text_hash") == F.col("head.text_hash"))).select(
            "cid", "family", "blocks", "text", "print").mapInArrow(
            returning(_sets(shingle_words)), "cid long, family long, blocks long, elements array<long>")
        sets = steps.keep(sets)
        links = sets.filter("blocks = 1").groupBy("family").applyInPandas(_within(percent), "a long, b long")
        large = sets.filter("blocks > 1")
        if not large.isEmpty():
            links = links.union(_large_families(large, percent, steps))
        roots = components(links, steps)
        owned = steps.keep(classes.select("print", "cid", "head").join(roots, F.col("cid") == F.col("node"), "left").withColumn(
            "root", F.coalesce("root", "cid")))
        named = steps.keep(owned.groupBy("root").agg(F.min("head").alias("least")))
        owned = owned.join(named, "root").select("print", "least")
        out = signed.filter("n_shingles > 0").drop("bands").join(owned, "print").select(
            "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "text_hash",
            F.col("least.text_hash").alias("first_hash"))
        alone = signed.filter("n_shingles = 0").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.col("text_hash").alias("first_hash"))
        kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
        return materialize(out.union(alone).select(
            "doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash",
            (kept & (F.col("text_hash") == F.col("first_hash"))).alias("chosen")))
