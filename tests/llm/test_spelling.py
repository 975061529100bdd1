"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling


def apart(a, b):
    """Whether exactly one edit parts two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain(rows):
    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w, c in n.items():
        near = [x for x in n if apart(w, x)]
        form = min(near, key=lambda x: (-n[x], x), default=None)
        form = form if form is not None and n[form] >= 10 * c else None
        out[w] = [form, w, c, len(near), n.get(form)]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return sorted((w, *v) for w, v in out.items())


def texts(seed, letters="abé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(40)]
    base += ["a" * k for k in (7, 8, 9)] + [f"{'ab' * 30}{x}" for x in ("", "a", "b", "ba")]
    rows = [(None, None), (1, ""), (2, " 12 .. ")]
    for k in range(60):
        words = [rng.choice(base[: rng.choice([3, 10, len(base)])]) for _ in range(60)]
        words = [w if rng.random() < 0.8 else w[: (j := rng.randrange(len(w)))] + rng.choice(letters) + w[j + 1 :] for w in words]
        rows.append((k, rng.choice([" ", "-", "1\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows + rows[5:8] + [(None, "abéabéabé " * 3)]


@pytest.mark.parametrize(("seed", "most", "share"), [(1, 20_000, 8_000), (2, 20_000, 40), (3, 5, 30), (4, 1, 1_000)])
def test_variants(spark, seed, most, share):
    rows = texts(seed)
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    got = spelling.spelling_variants(spelling.vocabulary(df, every=31), most=most, share=share)
    want = plain(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and any(r[1] for r in want) and any(r[4] > 2 for r in want)


def test_roots_follow_forms(spark):
    words = [("abcdefgh", 1000), ("abcdefgx", 100), ("abcdefyx", 10), ("abcdezyx", 1), ("qqqqqqqq", 5)]
    got = spelling.spelling_variants(spark.createDataFrame(words, "word string, n long"))
    assert {r.word: (r.form, r.root) for r in got.collect()} == {
        "abcdefgh": (None, "abcdefgh"), "abcdefgx": ("abcdefgh", "abcdefgh"), "abcdefyx": ("abcdefgx", "abcdefgh"), "abcdezyx": ("abcdefyx", "abcdefgh"), "qqqqqqqq": (None, "qqqqqqqq"),
    }


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.vocabulary(df, every=31)).collect() == []
