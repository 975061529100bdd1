"""Repeats with the parameters that the query uses, against a count of all strings of 400 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import common, repeats

SPAN = repeats.SPAN


def whole(texts):
    rows = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + SPAN] for b in rows for p in range(len(b) - SPAN + 1))
    for b in rows:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - SPAN + 1):
            if seen[b[p : p + SPAN]] > 1:
                cover[p : p + SPAN] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        yield len(b), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("often", [1000, 2])
def test_production(spark, monkeypatch, often):
    monkeypatch.setattr(common, "OFTEN", often)  # keys that are dealt out: almost all, or those of half the rows
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["été", "naïve", "und", "x"]) + str(rng.randrange(10**6)) for _ in range(n))
    license_, passage = words(70), words(200)
    texts = [f"{words(rng.randint(5, 60))}\n{license_}\n{words(rng.randint(5, 60))}" for _ in range(40)]  # one line in half of all
    for size in (399, 400, 401, 900):
        part = passage[rng.randrange(300) :].encode()[:size].decode(errors="ignore")
        texts += [words(9) + part + words(9), part + "é" + words(9)]
    texts += [passage + words(3) + passage[100:], "ab" * 900, "ab" * 300, "z" * SPAN, "z" * (SPAN - 1), words(30), "", None, texts[3], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    want = dict(enumerate(whole(texts)))
    assert {k for k in want if got[k] != want[k]} == set() and len(got) == len(texts)
