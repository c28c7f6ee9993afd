"""Sharding by exact counts and packing by exact ids."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from gleaner.llm import sharding
from gleaner.llm.packing import pack
from gleaner.session import Steps

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_draws_follow_the_law(spark):
    pool, marked, drawn, n = 23, 9, 11, 20_000
    got = spark.range(n).select(sharding.hypergeometric(
        F.lit(pool), F.lit(marked), F.lit(drawn), (F.col("id") + 0.5) / n).alias("k")).groupBy("k").count().collect()
    want = {k: math.comb(marked, k) * math.comb(pool - marked, drawn - k) / math.comb(pool, drawn) for k in range(10)}
    assert sum(r["count"] for r in got) == n
    assert all(abs(r["count"] / n - want[r["k"]]) < 2e-4 for r in got)


def test_draws_at_the_edges(spark):
    cases = [(0, 0, 0), (5, 0, 3), (5, 5, 3), (5, 2, 5), (5, 2, 0), (10_000_000_000, 1_250_000_000, 5_000_000_000)]
    rows = spark.createDataFrame(cases, "a long, b long, c long").select("*", *[
        sharding.hypergeometric(F.col("a"), F.col("b"), F.col("c"), F.lit(u)).alias(f"k{i}") for i, u in enumerate((0.0, 0.5, 1 - 2**-53))])
    got = {(r["a"], r["b"], r["c"]): (r["k0"], r["k1"], r["k2"]) for r in rows.collect()}
    assert got[(0, 0, 0)] == got[(5, 0, 3)] == got[(5, 2, 0)] == (0, 0, 0)
    assert got[(5, 5, 3)] == (3, 3, 3) and got[(5, 2, 5)] == (2, 2, 2)
    # the mode comes first, then what lies above it, then what lies below; a standard deviation is 16,536
    mode, half, last = (k - 625_000_000 for k in got[cases[-1]])
    assert mode == 0 and 50_000 < half < 90_000 and -250_000 < last < -100_000


def test_matrix_has_exact_margins(spark):
    sizes = [(b, n) for b, n in enumerate([0, 1, 7, 1000, 131072, 5, 5, 40, 3])]
    with Steps(spark, "test") as steps:
        rows = sharding.communication_matrix(spark.createDataFrame(sizes, "block long, n long"), 8, 3, steps).collect()
    assert {r["block"]: sum(r["counts"]) for r in rows} == dict(sizes)
    shards = np.sum([r["counts"] for r in rows], axis=0)
    assert shards.sum() == sum(n for _, n in sizes) and shards.max() - shards.min() <= 1


def test_shuffle_is_exact_and_mixed(spark):
    docs = spark.range(0, 5003, 1, 7).select(F.col("id").alias("doc_id"), F.lit("x").alias("row"), F.lit(1).alias("shard"))
    rows = sharding.shuffle_to_shards(docs, 8).select("doc.doc_id", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(5003))
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    place = np.array([(r["shard"], r["slot"]) for r in sorted(rows, key=lambda r: r["doc_id"])])
    assert abs(np.corrcoef(np.arange(5003), place[:, 0])[0, 1]) < 0.05
    assert abs(np.corrcoef(np.arange(5003), place[:, 1])[0, 1]) < 0.05
    again = sharding.shuffle_to_shards(docs, 8).select("doc.doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = sharding.shuffle_to_shards(spark.range(0, 3000, 1, 3).withColumnRenamed("id", "doc_id"), 8).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes.values()) == {375}
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, k) for s in range(8) for k in range(375)}
    # by chance alone, neighbours come to share a shard one time in eight
    shard = [r["shard"] for r in sorted(rows, key=lambda r: r["doc"]["doc_id"])]
    assert 0.08 < np.mean([a == b for a, b in zip(shard, shard[1:], strict=False)]) < 0.17


def test_shards_of_odd_rows(odd):
    assert sharding.shuffle_to_shards(odd, 5).count() == odd.count()
    assert sharding.shuffle_to_shards(odd.limit(0), 5).count() == 0
    assert sharding.shuffle_to_shards(odd.limit(1), 5).count() == 1


def exact(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packs(docs, window, **how):
    rows = pack(docs, PATH, window, **how).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, tuple(exact(t))) for d, t in texts)
    by_doc = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
    whole = Counter()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: (r["doc_tokens"], r["start"]))
        if len({r["start"] for r in pieces}) == len(pieces):
            assert all(a["start"] + a["length"] == b["start"] for a, b in zip(pieces, pieces[1:], strict=False))
            whole[(d, tuple(i for r in pieces for i in r["ids"]))] += 1
        else:  # rows that share an id: each fits in one piece here
            whole.update((d, tuple(r["ids"])) for r in pieces)
    assert whole == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= window
    return len(sequences), sum(r["length"] for r in rows)


def test_packs_equal_the_tokenizer(frame, spark, folder):
    special = "<|endoftext|> don't WE'LL it's naïve ΟΔΟΣ Σίσυφος İstanbul éá ẛ̣ 日本語 ½ ²3 \x1cx\x85y   ...!!! '' 'S á"
    docs = frame([(1, special), (2, special.upper()), (3, None), (4, ""), (None, "no id"), (5, "twice"), (5, "twice"),
                  (6, " ".join(f"word{i}" for i in range(900)))])
    check_packs(docs.repartition(3), 64, most_open=2)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    sequences, tokens = check_packs(table.repartition(5), 2048)
    assert tokens / (2048 * sequences) > 0.92  # 94 sequences, five of them open to the end


def test_packs_of_odd_rows(odd):
    check_packs(odd, 1_000_000)
    assert pack(odd.limit(0), PATH).count() == 0
