"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic


def plain_runs(s, least=6, exponent=4):
    n, out = len(s), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and s[k] == s[k + q]:
                k += 1
            if k + q - i >= max(least, exponent * q):
                out.setdefault((i, k + q - i), q)
            i = k + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def sequences(seed):
    rng = random.Random(seed)
    for _ in range(60):
        s = []
        while len(s) < rng.choice([0, 1, 5, 6, 40, 300]):
            part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 9))]
            s += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randrange(len(part) + 1)]
        yield s


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    all_ = list(sequences(seed))
    for many in (all_, *[[s] for s in all_[:20]]):
        got = periodic.runs([np.array(s, np.int64) for s in many])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(s) for s in many]


def test_long_runs_are_few_levels(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 1000)
    s = np.array(([1, 2, 1, 2, 1, 2, 3] * 500) + [7] * 900 + list(range(100, 400)))
    assert len(periodic.recompressed(s)) < 90
    assert [tuple(r) for r in periodic.runs([s])[0].tolist()] == plain_runs(s.tolist())


def test_extensions_of_all_pairs():
    rng = random.Random(4)
    s = np.array([rng.randrange(2) for _ in range(60)] + [0, 1] * 20 + [0] * 20 + [9])
    i, j = np.triu_indices(len(s), 1)
    want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
    assert periodic.extensions(periodic.recompressed(s), i, j).tolist() == want


def test_query_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "a b c", "x " * 50, "no run here at all", "à b à b\tà b à b à", *(" ".join(f"w{x}" for x in s) for s in sequences(9))]
    ids = list(range(len(texts)))
    rows = [(k, t, "other") for k, t in zip(ids, texts)] + [(None, "y " * 9, "z"), (4, "x " * 50, "other")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((tuple(r) for r in periodic.digests(periodic.periodic_runs(df, change=periodic.tail_repeated)).collect()), key=repr)

    def want(k, t):
        w = (t or "").split()
        h = zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = plain_runs(w)
        gone = {x for a, n, q in found for x in range(a + q, a + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        tail = (sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        return (k, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *tail)

    assert got == sorted((want(k, t) for k, t, _ in rows), key=repr)
    assert periodic.digests(periodic.periodic_runs(df.limit(0))).collect() == []
