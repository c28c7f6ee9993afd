"""Packing of texts that hold the tokenizer's special tokens."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from gleaner.llm import queries, stages
from gleaner.llm.grams import slices
from gleaner.llm.packing import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "hello <|endoftext|> world", "hello world", "<|endoftext|>", "x<|startoftext|><|endoftext|>y's don't<|endoftext|>'s", "<|ENDOFTEXT|> <|endof", None, "",
    "É<|endoftext|>́a é<|endoftext|> 日本<|startoftext|>語 <|endoftext|>　Σ<|endoftext|>ΟΔΟΣ", "<|endoftext|> hello <|endoftext|>", "İ<|endoftext|>½\x85<|endoftext|>"]


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_plain_call():
    coder = Encoder(PATH)
    for _ in range(2):  # from the model, then from what is known
        for _, part in slices(pa.array(TEXTS)):
            ids, ends = coder.ids(part)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [plain(t) for t in TEXTS]
    assert plain(TEXTS[0]) == [3306, 49407, 1002, 1]


def test_query_and_stage_use_the_plain_call(frame, spark, tmp_path):
    docs = frame(list(enumerate(TEXTS)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: plain(t) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["ids"] for r in stages.packed(spark, docs, str(tmp_path)).collect()} == want
    assert {r["doc_id"]: r["ids_crc32"] for r in queries.QUERIES["op6_packing"](spark, str(tmp_path)).collect()} == {
        i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}
