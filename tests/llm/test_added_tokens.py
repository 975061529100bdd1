"""Texts that hold an added token of the tokenizer's file get the ids that the plain library gives."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import token_store
from tessera.llm.queries import tokenizer

END = "<|endoftext|>"
TEXTS = [END, f"one text {END} and more", f"one text{END}and more", f"{END} at first", f"at last {END}", f" {END}\n{END}  two", f"a\n{END}\nb", f"x{END}{END}.", "<|endoftext| >", "one text and more", "<|endoftext|", None]


def test_added_tokens(spark):
    t = Tokenizer.from_file(tokenizer())
    want, at = [], 0
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert 50256 in t.encode(TEXTS[1], add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_store(df, tokenizer()).collect())
    assert got == want
