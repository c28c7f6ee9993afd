"""Fingerprints of words and runs, also of those made to collide in the ring of 64-bit integers."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import grams, packing, substring
from gleaner.llm.near_dedup import near_duplicates
from gleaner.llm.rules import judge
from gleaner.session import Steps

PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, a, b):
    """A Thue-Morse sequence of n symbols and its complement."""
    one, two = [a], [b]
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


def test_field_arithmetic():
    draw = np.random.default_rng(1)
    a = np.r_[draw.integers(0, grams.PRIME, 500), [0, 1, grams.PRIME - 1, grams.PRIME - 1]].astype(np.uint64)
    b = a[::-1].copy()
    assert grams.times(a, b).tolist() == [x * y % grams.PRIME for x, y in zip(a.tolist(), b.tolist())]
    for family, base in enumerate(grams.BASES):
        ups, downs = grams.powers(5000, family)
        assert ups[4999] == pow(base, 4999, grams.PRIME) and downs[4999] == pow(base, -4999, grams.PRIME)


@pytest.mark.parametrize("family", [0, 1])
def test_runs_are_polynomials(family):
    values = np.random.default_rng(2).integers(0, 2**64 - 1, 6000, dtype=np.uint64)
    starts, ends = np.array([0, 0, 17, 5990]), np.array([1, 6000, 4000, 6000])
    plain = [sum(int(v) * pow(grams.BASES[family], i, grams.PRIME) for i, v in enumerate(values[a:b])) % grams.PRIME
             for a, b in zip(starts, ends)]
    want = grams.mix(np.array(plain, np.uint64) + np.uint64(0x5851F42D4C957F2D))
    runs = grams.Runs(values, family)
    assert (runs.of(starts, ends) == want).all()
    assert (runs.windows(30) == runs.of(np.arange(5971), np.arange(30, 6001))).all()


def test_words_of_all_lengths_differ():
    words = ["a" * n for n in range(1, 200)] + ["a" * n + "b" for n in range(199)] + ["b" + "a" * n for n in range(1, 199)]
    words += ["".join(w) for n in (64, 1024, 4096) for w in thue_morse(n, "x", "y")]
    for _, part in grams.slices(pa.array([" ".join(words)])):
        assert len(set(part.hashes.tolist())) == len(set(words))
        spans = part.data, part.starts, part.ends
        assert grams.equal_spans(spans, spans).all()
        turned = part.data, part.starts[::-1], part.ends[::-1]
        same = [a == b for a, b in zip(words, words[::-1])]
        assert grams.equal_spans(spans, turned).tolist() == same


def test_runs_of_words_differ():
    for _, part in grams.slices(pa.array([" ".join(x for w in thue_morse(2048, "so", "no") for x in w)])):
        runs = grams.Runs(part.hashes)
        one, two = runs.of(np.array([0, 2048]), np.array([2048, 4096])).tolist()
        assert one != two


@pytest.fixture
def pair(frame):
    """Two texts of 60 words, one of which is a Thue-Morse word in the first and its complement in the second."""
    one, two = ("".join(w) for w in thue_morse(2048, "a", "b"))
    words = [f"word{i}" for i in range(60)]
    return frame([(k, " ".join([*words[:30], w, *words[30:]])) for k, w in ((1, one), (2, two))])


def test_substring_keeps_what_only_looks_alike(pair):
    with Steps(pair.sparkSession, "test") as steps:
        got = substring.remove_repeats(pair, steps, length=35).select("doc.doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0)]


def test_substring_tells_rows_of_one_hash_apart(frame, monkeypatch):
    monkeypatch.setattr(substring, "row_key", lambda: (F.lit(5).cast("long"), F.xxhash64("text", "doc_id")))
    shared = " ".join(f"s{i}" for i in range(40))
    docs = frame([(1, f"{shared} one tail"), (2, "short text"), (3, f"a longer head of it {shared}"), (4, None)])
    with Steps(docs.sparkSession, "test") as steps:
        got = substring.remove_repeats(docs, steps, length=35).select("doc.doc_id", "n_removed", "kept_text").collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"].split()) for r in got) == [
        (1, 40, ["one", "tail"]), (2, 0, ["short", "text"]), (3, 40, "a longer head of it".split()), (4, 0, [])]


def test_near_duplicates_count_it_as_another_word(pair):
    got = near_duplicates(pair.filter("doc_id = 1").union(pair.filter("doc_id = 2")), 2, 97).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2)]  # 58 of 62 shingles are shared


def test_rules_see_no_repetition(frame):
    one, two = ("".join(w) for w in thue_morse(1024, "a", "b"))
    text = f"m n o p {one} m n o p {two}"
    assert [tuple(r) for r in judge(frame([(1, text)])).select("n_words", "n_repeat_words").collect()] == [(10, 0)]


def test_encoder_compares_bytes(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    one, two = ("".join(w) for w in thue_morse(2048, "a", "b"))
    texts = [f"{one} and {two}", "another-text of-eleven-bytes", two, "of-eleven_bytes  another text"]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]

    def ids(coder):
        out = []
        for text in texts:
            for _, part in grams.slices(pa.array([text])):
                found, ends = coder.ids(part)
                out.append(found[ends[0]:ends[1]].tolist())
        return out

    assert ids(packing.Encoder(PATH)) == want
    # all words of a length share a fingerprint
    monkeypatch.setattr(grams, "hash_words", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    coder = packing.Encoder(PATH)
    assert ids(coder) == want and ids(coder) == want
    monkeypatch.setattr(packing, "CACHED_WORDS", 1)
    assert ids(packing.Encoder(PATH)) == want


def test_long_words_are_hashed_whole():
    word = "z" * 100_000
    for _, part in grams.slices(pa.array([word + " " + word[:-1] + "y"])):
        digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
        assert part.hashes[0] == int.from_bytes(digest, "little") != part.hashes[1]


def test_control_characters_among_plain_words():
    from tokenizers import Tokenizer

    tokenizer, coder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for text in ["a\x00b plain words", "x\x7fy \x01 z", "tab\x0b\x1cin \x1f"]:
        for _, part in grams.slices(pa.array([text])):
            assert coder.ids(part)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
