"""Models and queries against plain loops over single documents."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import components, decontaminate, grams, quality, queries, toxicity
from gleaner.llm.labelled import sample
from gleaner.llm.near_dedup import near_duplicates
from gleaner.llm.rules import judge
from gleaner.session import Steps

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture
def tables(spark):
    return [spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels")]


def logistic(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def toxic_features(text):
    """Words, stems, neighbours and skip-pairs by name, and the bucket of each."""
    word = lambda b, n=None: int(grams.Slice(np.frombuffer(b, np.uint8), np.array([0, len(b)])).hashes[0])
    codes = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = [bytes(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", codes)]
    mixed = lambda x: int(grams.mix(np.array([x % 2**64], np.uint64))[0]) >> 44
    out = {0}
    for w in words:
        out.add(word(w) >> 44)
        for k in toxicity.STEMS:
            runs = grams.Buckets(grams.FOLDED[np.frombuffer(w[:k], np.uint8)])
            out.add(mixed(int(runs.of(np.array([0]), np.array([len(w[:k])]))[0]) + k))
    for gap in toxicity.GAPS_BETWEEN:
        out |= {mixed(word(a) * 3 + word(b) + gap) for a, b in zip(words, words[gap:])}
    return sorted(out)


def test_toxicity_equals_a_plain_model(tables, monkeypatch):
    docs, labels = tables
    texts = sample(docs.withColumn("text", F.substring("text", 1, 300)), labels, "toxic", 3, 1, 60)
    seen = [toxic_features(t) for t in texts["text"].to_pylist()]
    alpha, beta, l1, l2 = 2.0, 1.0, 0.5, 1.0
    z, n, order = {}, {}, np.random.default_rng(11)

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -math.copysign(abs(z[i]) - l1, z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(len(seen)).tolist():
            now = {i: weight(i) for i in seen[k]}
            g = logistic(math.fsum(now.values())) - texts["y"][k].as_py()
            for i, w in now.items():
                was = n.get(i, 0.0)
                n[i] = was + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(was)) / alpha * w
    plain = {i: w for i in z if (w := weight(i))}
    at, weights = toxicity.train(texts, epochs=3, l1=l1)
    assert at.tolist() == sorted(plain) and np.allclose(weights, [plain[i] for i in at.tolist()], atol=1e-5)
    monkeypatch.setattr(toxicity, "train", lambda _: (at, weights))
    some = docs.orderBy("doc_id").limit(12)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(some, labels).collect()}
    for r in some.collect():
        want = 1 / (1 + math.exp(-sum(plain.get(i, 0.0) for i in toxic_features(r["text"]))))
        assert abs(got[r["doc_id"]] - want) < 1e-4


def run_hash(codes):
    values = grams.mix(np.array(codes, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(grams.Buckets(values).of(np.array([0]), np.array([len(codes)]))[0])


def quality_features(text):
    """Buckets of the words, of words that follow themselves, and of n-grams with no white space but at their ends."""
    codes = [32 if c in "\t\n\x0b\x0c\r " else ord(c) for c in f" {text} "]
    words = [[ord(c) for c in w] for w in re.split("[\t\n\x0b\x0c\r ]+", text) if w]
    out = [0, *(run_hash(w) for w in words), *(1 << 63 for a, b in zip(words, words[1:]) if a == b)]
    for n in quality.GRAMS:
        for i in range(len(codes) - n + 1):
            if 32 not in codes[i + 1:i + n - 1]:
                out.append(int(grams.mix(np.array([(run_hash(codes[i:i + n]) + n) % 2**64], np.uint64))[0]))
    return [x >> 64 - quality.BITS for x in out]


def test_quality_equals_a_plain_model(tables, monkeypatch):
    """Training and scores, one feature after the other in double precision."""
    docs, labels = tables
    monkeypatch.setattr(quality, "BITS", 10)
    texts = sample(docs.withColumn("text", F.substring("text", 1, 150)), labels, "quality", 5, 0, 30)
    draw = np.random.default_rng(5)
    vectors = draw.uniform(-1 / 8, 1 / 8, (1 << 10, 8)).astype(np.float32).astype(float)
    output = np.zeros((8, 2))
    seen = [quality_features(t) for t in texts["text"].to_pylist()]
    steps, done = 6 * len(seen), 0
    for _ in range(6):
        for k in draw.permutation(len(seen)).tolist():
            mine = seen[k]
            mean = sum(vectors[i] for i in mine) / len(mine)
            odds = [math.exp(mean @ output[:, c]) for c in (0, 1)]
            wrong = [odds[c] / sum(odds) - (c == texts["y"][k].as_py()) for c in (0, 1)]
            rate = 0.5 * (1 - done / steps)
            back = output @ wrong
            output = output - rate * np.outer(mean, wrong)
            for i in sorted(set(mine)):
                vectors[i] -= rate * mine.count(i) / len(mine) * back * len(set(mine)) ** 0.5
            done += 1
    plain = vectors @ (output[:, 1] - output[:, 0])
    weights = quality.train(texts)
    assert np.abs(weights - plain).max() < 1e-3 and np.abs(plain).max() > 0.01
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    weights = quality.train(sample(docs, labels, "quality", 5, 0, 4_000))
    for r in docs.orderBy("doc_id").limit(15).collect():
        mine = quality_features(r["text"])
        want = sum(float(weights[i]) for i in mine) / len(mine)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-want))) < 1e-4


def votes(n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines, n_upper, n_letters, n_plain, n_distinct):
    pick = lambda bad, good: -1 if bad else 1 if good else 0
    return (pick(n_words < 10, n_words >= 40), pick(n_repeat > 0.2 * n_words, n_repeat <= 0.02 * n_words),
            pick(n_symbols > n_words / 10, n_symbols <= n_words / 100), pick(n_dup_lines > n_lines / 2, n_dup_lines == 0),
            pick(word_chars < 2.5 * n_words or word_chars > 12 * n_words, 3 * n_words <= word_chars <= 10 * n_words),
            pick(n_upper > n_letters / 2, n_upper <= n_letters / 5), pick(n_plain < 0.7 * n_words, n_plain >= 0.95 * n_words),
            pick(n_words > 10 * n_distinct, n_words <= 4 * n_distinct))


def test_posterior_equals_plain_em(tables):
    """Expectation-maximisation document by document, from votes taken of the measures anew."""
    rows = judge(tables[0]).collect()
    cast = [votes(*(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
                                   "n_letters", "n_plain_words", "n_distinct_words"))) for r in rows]
    assert ["".join("-0+"[v + 1] for v in c) for c in cast] == [r["votes"] for r in rows]
    bad_good = {0: (0.40, 0.60), 1: (0.02, 0.98)}
    rate = {(c, k): list(bad_good[c]) for c in (0, 1) for k in range(8)}
    share, good = 0.8, [0.8] * len(cast)
    for _ in range(200):
        now = []
        for c in cast:
            like = [1 - share, share]
            for k, v in enumerate(c):
                if v:
                    like = [like[side] * rate[side, k][v > 0] for side in (0, 1)]
            now.append(like[1] / (like[0] + like[1]))
        if max(abs(a - b) for a, b in zip(now, good)) < 1e-9:
            break
        good = now
        for k in range(8):
            for side in (0, 1):
                n = [20 * x for x in bad_good[side]]
                for c, p in zip(cast, good):
                    if c[k]:
                        n[c[k] > 0] += p if side else 1 - p
                rate[side, k] = [x / sum(n) for x in n]
            (b0, g0), (b1, g1) = rate[0, k], rate[1, k]
            b1, g0 = min(b1, b0), min(g0, g1)
            rate[0, k], rate[1, k] = [b0 / (b0 + g0), g0 / (b0 + g0)], [b1 / (b1 + g1), g1 / (b1 + g1)]
        share = min(0.98, max(0.02, (sum(good) + 16) / (len(good) + 20)))
    for r, p in zip(rows, good):
        assert abs(r["posterior"] - p) < 1e-6
        assert r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_sharding_query(spark, frame, tmp_path):
    texts = ["", None, "é", "plain", "plain", "x" * 70_000]
    frame(list(enumerate(texts * 5))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_sharding(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == [
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts * 5)]
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    shards = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in shards) and max(map(len, shards)) - min(map(len, shards)) <= 1


def test_components_of_a_hub(spark):
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(200_000, 200_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with Steps(spark, "test") as steps:
        rows = components.components(hub.union(chain), steps)
        got = {(r["root"], r["n"]) for r in rows.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 100_001), (200_000, 41)}


def test_near_duplicates_of_one_large_family(frame):
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(60)]
    texts = [" ".join(base[:k % 50] + [f"v{k}"] + base[k % 50 + 1:]) for k in range(3_000)] + ["something else entirely here"]
    rows = near_duplicates(frame(list(enumerate(texts))), 2, 80).select("doc_id", "component_id").collect()
    assert {(r["component_id"], r["doc_id"] == 3_000) for r in rows} == {(0, False), (3_000, True)}


def test_benchmark_blocks_are_sent_one_at_a_time(spark, frame, monkeypatch):
    words = [[f"b{k}w{i}" for i in range(12)] for k in range(40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "item_id long, text string")
    docs = frame([(k, f"head {' '.join(w)} tail") for k, w in enumerate(words)] + [(99, "nothing")])
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 60)
    sc = spark.sparkContext
    living, most, plain = [], [], type(sc).broadcast

    def broadcast(self, value):
        out = plain(self, value)
        if isinstance(value, decontaminate.Index):
            living.append(out)
            most.append(len(living))
            end = out.destroy
            out.destroy = lambda *a: (living.remove(out), end(*a))
        return out

    monkeypatch.setattr(type(sc), "broadcast", broadcast)
    rows = decontaminate.find_leaks(docs, bench)
    got = {r["doc"]["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in rows.collect()}
    assert got == {k: [k] for k in range(40)} | {99: []}
    assert len(most) >= 10 and max(most) == 1
