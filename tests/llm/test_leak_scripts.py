"""Benchmark items in other scripts, and copies with other punctuation."""

import pyarrow as pa

from gleaner.llm import grams
from gleaner.llm.decontaminate import find_leaks, tokens


def cut(text):
    """Tokens as the hashes of the words that they should be."""
    return [part.words(0).tolist() for _, part in tokens(pa.array([text]))][0]


def words(text):
    return [part.words(0).tolist() for _, part in grams.slices(pa.array([text]))][0]


def test_tokens():
    for text, want in [
        ("“It’s” a — b…c d", "it s a b c d"), ("Größe,naïve¿qué?", "größe naïve qué"), ("日本語のABC、コーヒー。", "日 本 語 の abc コ ー ヒ ー"),
        ("été हिन्दी ٣٤", "été हिन्दी ٣٤"), ("ภาษา", "ภ า ษ า"), ("Ünïcode x—y", "ünïcode x y"), ("plain, ASCII-text 12", "plain ascii text 12"),
        ("한국어 문장", "한국어 문장")]:
        assert cut(text) == words(want), text
    some = pa.array([None, "a—b", "", "a b", "日本"])
    assert [part.words(i).tolist() for _, part in tokens(some) for i in range(len(part))] == [[], words("a b"), [], words("a b"), words("日 本")]


def test_leaks_in_other_scripts(spark, frame):
    chinese, quoted = "今天天气很好我们一起去公园散步吧", "“One”—two… ‘three’ four’s five six “seven” eight"
    bench = spark.createDataFrame([(1, chinese), (2, quoted)], "item_id long, text string")
    docs = frame([(1, f"他说:{chinese}。然后就走了"), (2, "so one two three four's five six seven eight it is"), (3, "天天很"), (4, "one, four; eight")])
    got = {r["doc"]["doc_id"]: [(x["item_id"], x["item_tokens"], x["coverage"]) for x in r["leaks"]] for r in find_leaks(docs, bench).collect()}
    assert got == {1: [(1, 16, 1.0)], 2: [(2, 9, 1.0)], 3: [], 4: []}
