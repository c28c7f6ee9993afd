"""Uniform shuffling into shards of exact size, in DataFrame operations only.

The rows of the source blocks are dealt to shards by a communication matrix: entry (block,
shard) says how many of the block's rows go there.  It is drawn at once, with the law that a
uniform permutation of all rows would give it: shard sizes are fixed, and splitting the blocks
into halves again and again, each half's share of every shard is multivariate hypergeometric.
Then each block permutes its rows and cuts them by its line of the matrix, rows are exchanged,
and each shard permutes what it got.  No step sorts or ranks all rows together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import Steps, materialize

BLOCK_BITS = 17  # a source block is up to 2 ** 17 neighbouring rows of one partition
BUCKET_ROWS = 50_000  # expected rows of a shard that one task permutes
REACH = 12  # a draw looks this many standard deviations around the mode; beyond lie less than 1e-30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_up(last: Column) -> Column:
    """1 to last, nothing if last is 0."""
    return F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>"))


def hypergeometric(pool: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of the drawn are marked, by inversion of u in [0, 1).

    Probabilities follow from their neighbours' by ratios, beginning at the mode with 1.
    """
    d = [c.cast("double") for c in (pool, marked, drawn)]

    def spread(v: Column) -> Column:
        share = v["k"] / F.greatest(v["n"], F.lit(1.0))
        sd = F.sqrt(v["d"] * share * (1 - share) * (v["n"] - v["d"]) / F.greatest(v["n"] - 1, F.lit(1.0)))
        low, high = F.greatest(F.lit(0.0), v["d"] + v["k"] - v["n"]), F.least(v["d"], v["k"])
        mode = F.least(F.greatest(F.floor((v["d"] + 1) * (v["k"] + 1) / (v["n"] + 2)).cast("double"), low), high)
        reach = F.ceil(REACH * sd + REACH)
        return F.struct(v["n"].alias("n"), v["k"].alias("k"), v["d"].alias("d"), mode.alias("mode"),
                        F.least((high - mode).cast("long"), reach).alias("ups"),
                        F.least((mode - low).cast("long"), reach).alias("downs"))

    def up(v: Column, w: Column, j: Column) -> Column:
        at = v["mode"] + j - 1
        return w * (v["k"] - at) * (v["d"] - at) / ((at + 1) * (v["n"] - v["k"] - v["d"] + at + 1))

    def down(v: Column, w: Column, j: Column) -> Column:
        at = v["mode"] - j + 1
        return w * at * (v["n"] - v["k"] - v["d"] + at) / ((v["k"] - at + 1) * (v["d"] - at + 1))

    def total(v: Column, steps: str, ratio: Callable) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(_count_up(v[steps]), start, lambda a, j: _let(ratio(v, a["w"], j), lambda w: F.struct(
            w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])

    def walk(v: Column, steps: str, ratio: Callable, target: Column) -> Column:
        """The first step at which the sum of weights passes the target."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))
        return F.aggregate(_count_up(v[steps]), start, lambda a, j: _let(ratio(v, a["w"], j), lambda w: F.struct(
            w.alias("w"), (a["sum"] + w).alias("sum"),
            F.when(a["sum"] <= target, j).otherwise(a["at"]).alias("at"))), lambda a: a["at"])

    def invert(v: Column) -> Column:
        sums = F.struct(v.alias("v"), total(v, "ups", up).alias("up"), total(v, "downs", down).alias("down"))
        return _let(sums, lambda s: _let(u * (1 + s["up"] + s["down"]), lambda x: v["mode"].cast("long") + F.when(
            x < 1, F.lit(0).cast("long")).when(x < 1 + s["up"], walk(v, "ups", up, x - 1)).otherwise(
            -walk(v, "downs", down, x - 1 - s["up"]))))

    return _let(_let(F.struct(d[0].alias("n"), d[1].alias("k"), d[2].alias("d")), spread), invert)


def draw(room: Column, drawn: Column, uniform: Callable[[Column], Column]) -> Column:
    """Multivariate hypergeometric counts: of all places in `room`, by shard, `drawn` are taken."""
    start = F.struct(drawn.alias("left"), F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("pool"),
                     F.array().cast("array<long>").alias("taken"))

    def take(state: Column, shard: Column) -> Column:
        mine = F.element_at(room, shard.cast("int"))
        return _let(hypergeometric(state["pool"], mine, state["left"], uniform(shard)), lambda k: F.struct(
            (state["left"] - k).alias("left"), (state["pool"] - mine).alias("pool"),
            F.concat(state["taken"], F.array(k)).alias("taken")))

    return F.aggregate(_count_up(F.size(room).cast("long")), start, take, lambda a: a["taken"])


def communication_matrix(blocks: DataFrame, shards: int, seed: int, steps: Steps) -> DataFrame:
    """Rows (block, counts) from rows (block, n): how many of a block's rows each shard gets.

    Shard sizes differ by one row at most.  One row for every block is gathered to begin with;
    blocks hold up to 2 ** BLOCK_BITS rows, so that is a small list, split in two at each level.
    """
    blocks = steps.keep(blocks)
    some = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    room = F.array(*[F.lit(some["rows"] // shards + (s < some["rows"] % shards)).cast("long") for s in range(shards)])
    nodes = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks")).filter(
        F.size("blocks") > 0).select("blocks", room.alias("room"), F.lit(1).cast("long").alias("path"))
    for level in range(math.ceil(math.log2(max(some["blocks"], 1)))):
        if level == 6:  # so many lists are worth spreading over tasks
            nodes = nodes.repartition("path")
        half = F.floor(F.size("blocks") / 2).cast("int")
        left = F.slice("blocks", F.lit(1), half)
        rows = F.aggregate(left, F.lit(0).cast("long"), lambda a, b: a + b["n"])
        uniform = F.xxhash64(F.lit(seed), F.col("path"))
        taken = draw(F.col("room"), rows, lambda s, h=uniform: F.pmod(
            F.xxhash64(h, s), F.lit(1 << 53)).cast("double") / float(1 << 53))
        split = nodes.withColumn("taken", F.when(F.size("blocks") > 1, taken))
        parts = F.when(F.size("blocks") > 1, F.array(
            F.struct(left.alias("blocks"), F.col("taken").alias("room"), (2 * F.col("path")).alias("path")),
            F.struct(F.slice("blocks", half + 1, F.size("blocks")).alias("blocks"), F.zip_with(
                "room", "taken", lambda a, b: a - b).alias("room"), (2 * F.col("path") + 1).alias("path")),
        )).otherwise(F.array(F.struct("blocks", "room", "path")))
        nodes = split.select(F.explode(parts).alias("node")).select("node.*")
    return steps.keep(nodes.select(F.element_at("blocks", 1)["block"].alias("block"), F.col("room").alias("counts")))


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """One row per given row: doc (a struct of the given columns), shard (int from 0), slot (long from 0, gapless).

    All assignments with these shard sizes are equally likely, as far as hashes of row
    numbers are random; sizes differ by at most one.  Equal rows, equal texts, nulls and empty
    texts are rows like any other, since only the place of a row counts.  An empty table gives
    an empty result, and with fewer rows than shards some shards stay empty.
    """
    with Steps(docs.sparkSession, "shards") as steps:
        rows = steps.keep(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
        placed = rows.select("row", F.shiftright("row", BLOCK_BITS).alias("block"))
        matrix = communication_matrix(placed.groupBy("block").agg(F.count("*").alias("n")), shards, seed, steps)
        ends = F.transform("counts", lambda _, i: F.aggregate(
            F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))

        def mixed(salt: int) -> list[Column]:
            return [F.xxhash64(F.lit(seed + salt), F.col("row")), F.col("row")]

        local = Window.partitionBy("block").orderBy(*mixed(1))
        placed = placed.withColumn("at", F.row_number().over(local) - 1).join(
            matrix.select("block", ends.alias("ends")), "block")
        placed = placed.select("row", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"))
        buckets = rows.count() // (shards * BUCKET_ROWS) + 1
        placed = steps.keep(placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("row")), F.lit(buckets))))
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = placed.groupBy("shard", "bucket").count().select(
            "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        within = Window.partitionBy("shard", "bucket").orderBy(*mixed(3))
        slots = placed.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"]).select(
            F.col("row").alias("slot_row"), "shard", (F.col("start") + F.col("nth")).alias("slot"))
        return materialize(rows.join(slots, F.col("row") == F.col("slot_row")).select("doc", "shard", "slot"))
