"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import ngram_join


def plain(rows, shingle=3, percent=90):
    def of(text):
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        return {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())

    sets = [of(t) for _, t in rows]
    least = [k for k, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for k, i in enumerate(least):
        if i is not None:
            best[find(k)] = min(i, best.get(find(k), i))
    return sorted(((i, len(sets[k]), best.get(find(k)) if sets[k] else i) for k, i in enumerate(least)), key=repr)


def corpus(seed, families=12, members=14, length=70):
    rng = random.Random(seed)
    shared = " ".join(f"license{k}" for k in range(25))
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three"]
    for f in range(families):
        base = [f"f{f}w{rng.randrange(40)}" for _ in range(rng.randrange(5, length))]
        for m in range(members):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
            if rng.random() < 0.2:
                w = w[: rng.randrange(1, len(w) + 1)]
            texts.append(" ".join(w) + (f" {shared}" if f % 3 == 0 else ""))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts), (None, texts[9]), (None, "nothing like it at all"), (3, texts[12])]


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_components(spark, monkeypatch, seed, small):
    if small:  # several blocks of a group, several tasks of a shingle, several pieces
        for name, n in (("MEMBERS", 2), ("SHINGLES", 100), ("LISTED", 3), ("PIECE", 2000)):
            monkeypatch.setattr(ngram_join, name, n)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.similar_documents(df).collect()), key=repr)
    assert got == plain(rows)
    assert len({r[2] for r in got}) < len(rows) - 40


def test_other_similarity(spark):
    rows = corpus(5, families=6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.similar_documents(df, 2, 60).collect()), key=repr) == plain(rows, 2, 60)


def test_empty(spark):
    for rows in ([], [(1, None), (2, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in ngram_join.similar_documents(df).collect()) == [(i, 0, i) for i, _ in rows]


def test_planes():
    for kind in (np.uint32, np.uint64):
        x = np.array([0, 1, 255, 256, 2**31, 7], kind)
        assert ngram_join.unplaned(ngram_join.planes(x), kind).tolist() == x.tolist()
        assert ngram_join.unplaned(ngram_join.planes(x[:0]), kind).tolist() == []


def test_pairs_of_near_copies(spark, monkeypatch):
    """A family of near copies is connected by its heads, so the pairs that are verified grow with its members, not with their square."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(600)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in range(rng.randrange(7)):  # among the first words, so that the rarest shared shingles differ from set to set
            w[rng.randrange(60)] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    made, inner = [], ngram_join.materialise

    def counted(df, label):
        out = inner(df, label)
        if label == "join-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.similar_documents(df).collect()), key=repr) == plain(rows)
    assert 0 < sum(made) < 20 * len(rows), made
