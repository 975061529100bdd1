"""Token shards: the grammar to its end, random access, and words against the plain library."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_store
from tessera.llm.queries import tokenizer


def expanded(symbols, rules, first):
    out = []
    todo = symbols.tolist()[::-1]
    while todo:
        x = todo.pop()
        todo += [] if x < first else rules[x - first].tolist()[::-1]
        if x < first:
            out.append(x)
    return out


@pytest.mark.parametrize(("seed", "kinds", "n"), [(1, 3, 3000), (2, 40, 6000), (3, 2, 500), (4, 500, 2000), (5, 1, 300)])
def test_grammar_runs_to_its_end(seed, kinds, n):
    rng = random.Random(seed)
    ids = np.array([rng.randint(1, kinds) for _ in range(n)], "<u4")
    ends = np.array(sorted({*rng.sample(range(n), 20), n - 1}))
    ids[ends] = 0
    symbols, rules, last = token_store.grammar(ids, ends, 1000)
    assert expanded(symbols, rules, 1000) == ids.tolist()
    assert (symbols[last] == 0).all() and len(last) == len(ends)
    spans = np.cumsum([len(expanded(np.array([s]), rules, 1000)) for s in symbols])
    assert (spans[last] - 1 == ends).all()
    left = Counter(p for p in zip(symbols.tolist(), symbols.tolist()[1:]) if 0 not in p and p[0] != p[1])
    assert max(left.values(), default=0) < 2 * token_store.LEAST
    used = Counter([*symbols.tolist(), *rules.ravel().tolist()])
    assert all(used[1000 + k] for k in range(len(rules)))


def test_more_symbols_than_16_bits_hold():
    rng = random.Random(6)
    ids = [x for _ in range(8) for k in range(9000) for x in (k % 300 + 1, k // 300 + 1)] * 2
    rng.shuffle(pairs := [ids[k : k + 2] for k in range(0, len(ids), 2)])
    parts = [np.array([x for p in pairs[k : k + 500] for x in p] + [0], "<u4").tobytes() for k in range(0, len(pairs), 500)]
    shard = token_store.Shard(token_store.pack(parts, 65_000))
    assert len(shard.rules) > 536 and shard.symbols.max() >= 1 << 16
    assert shard.all().astype("<u4").tobytes() == b"".join(parts)
    whole = np.frombuffer(parts[3], "<u4")
    assert shard.doc(3).tolist() == whole.tolist() and shard.window(3, 17, 400).tolist() == whole[17:400].tolist()


def test_words_against_the_library(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 300)
    monkeypatch.setattr(token_store, "PIECE", 64)
    rng = random.Random(7)
    library = Tokenizer.from_file(tokenizer())
    encoder = token_store.Encoder(tokenizer())
    assert encoder.joinable
    letters = "abcdeXYZéüñßÀ" * 3 + "0'-.,;$%&!?()日ł  \t"
    for _ in range(6):
        texts = []
        for _ in range(150):
            made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))]
            texts.append("".join(w + rng.choice(" " * 9 + "\n") for w in made)[: rng.choice([None, -1])])
        texts += ["", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "z" * 5000 + " a", "it's Bob's, isn't it?", "A.B, c$$$ d%%%", "<|endoftext|>", "é" * 4100]
        rng.shuffle(texts)
        got = encoder.encode(pa.array([t.encode() for t in texts], pa.binary()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.words) <= 300


def test_rows_that_share_an_id(spark):
    rows = [(1, "bb"), (1, "a a a"), (None, "x"), (1, "aa"), (None, None), (1, "bb")] * 3
    library = Tokenizer.from_file(tokenizer())
    want, at = [], 0
    for doc, text in sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, len(r[1]), r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5):
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.token_store(df.repartition(n), tokenizer()).collect())
        assert [(d, s, n_, c) for s, d, n_, c in got] == want
