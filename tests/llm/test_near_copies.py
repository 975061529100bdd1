"""The pipeline's near-dedup stage against brute force."""

import random

import corpus_pipeline
import pytest
from tessera.llm import near_copies

SCHEMA = "doc_id long, text string, key long, bands string"


def changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_near_copies_go_at_four_fifths(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    texts = [None, "", " \n", "a b", "A b", "a c", *(" ".join(w) for w in base)]
    texts += [changed(rng, w, n) for w, n in zip(base, [1, 2, 3, 4, 5, 6] * 5)]
    texts += [" ".join(base[0]).upper(), texts[-1], changed(rng, texts[-1].split(), 2)]
    sets = [near_copies.shingles((t or "").encode()) for t in texts]
    root = list(range(len(texts)))
    alike = [(i, j) for i in root for j in root if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in root:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert 20 < len(set(root)) < len(texts) - 15
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == df.columns


def test_pairs_beside_the_head_of_a_bucket(spark, monkeypatch):
    # one bucket for all: every pair collides, and only the check decides
    monkeypatch.setattr(near_copies, "sketched", lambda rows, shingle: _one_bucket(rows))
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(6)]
    texts = [t for w in base for t in (" ".join(w), changed(rng, w, 1), changed(rng, w, 1))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.without_near_copies(df).collect()) == [0, 3, 6, 9, 12, 15]


@pytest.mark.parametrize(("families", "copies", "members"), [(40, 3, None), (40, 3, 7), (5, 400, None)])
def test_large_buckets_lose_no_link(spark, monkeypatch, families, copies, members):
    monkeypatch.setattr(near_copies, "sketched", lambda rows, shingle: _one_bucket(rows))
    if members:
        monkeypatch.setattr(near_copies, "MEMBERS", members)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(families)]
    texts = [t for w in base for t in [" ".join(w), *(changed(rng, w, rng.choice([1, 2, 3])) for _ in range(copies - 1))]]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in root[:]:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in near_copies.without_near_copies(df).collect()) == sorted({find(k) for k in root})


def _one_bucket(rows):
    from pyspark.sql import functions as F

    return rows.select("id", "key", F.lit(96).alias("n"), F.array(F.lit(1).cast("long")).alias("bands"))


def test_null_and_shared_ids(spark):
    a, b, c = ("one two three four five six seven", "other words stand in this text here", "a third text of yet more words")
    rows = [(None, a), (None, a), (None, b), (1, c), (1, a), (2, c), (2, b), (1, c)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in near_copies.without_near_copies(df).collect()) == sorted([(1, a), (2, b), (1, c)])
    nulls = df.filter("doc_id is null")
    assert sorted((r.doc_id, r.text) for r in near_copies.without_near_copies(nulls).collect()) == sorted([(None, a), (None, b)])


def test_fingerprints_find_what_no_sketch_does(spark, monkeypatch):
    from pyspark.sql import functions as F

    # no two texts share a bucket: only fingerprints let them meet
    monkeypatch.setattr(near_copies, "sketched", lambda rows, shingle: rows.select("id", "key", F.lit(1).alias("n"), F.array("key").alias("bands")))
    rng = random.Random(10)
    base = [[f"w{rng.randrange(5000)}" for _ in range(3000)] for _ in range(4)]
    near = []
    for w in base:
        fp = near_copies.simhash.fingerprints([" ".join(w).encode()], 5)[0]
        tries = (changed(rng, w, 1) for _ in range(200))
        near.append(next(t for t in tries if 0 < int(fp ^ near_copies.simhash.fingerprints([t.encode()], 5)[0]).bit_count() <= 2))
    # texts that differ beyond their words share a fingerprint
    texts = [*(" ".join(w) for w in base), *near, "  ".join(base[0])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()) == [0, 1, 2, 3]
