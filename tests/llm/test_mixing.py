"""Mixing: hot keys, ties, null ids, clashing columns, many sources."""

import random
from collections import defaultdict

import pytest

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def goals(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by capping and resharing until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[n] for n in capped)
        open_ = sum(weight[n] for n in names if n not in capped)
        want = {n: most * sizes[n] if n in capped else left * weight[n] / open_ for n in names}
        over = {n for n in names if want[n] > most * sizes[n] + 1e-9}
        if not over:
            return want
        capped |= over


def check(rows, docs):
    assert sorted((repr(r.doc_id), r.size) for r in rows) == sorted((repr(d), len((t or "").split())) for d, t, _ in docs)
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
        longest[s] = max(longest[s], len((t or "").split()))
    want = goals(sizes)
    of = {d: s for d, _, s in docs}
    alone = len(of) == len(docs)  # otherwise sources are told apart by their sizes
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r.times <= 2 and r.taken == r.times * r.size
        by[of[r.doc_id] if alone else (r.source_size, round(r.target, 3))] += r.taken
    for s in sizes:
        assert abs(by[s if alone else (sizes[s], round(want[s], 3))] - want[s]) <= longest[s] / 2 + 1e-6, s


@pytest.mark.parametrize("lot", [20_000, 3])
def test_equal_rows_meet_the_target(spark, lot):
    rng = random.Random(1)
    docs = [(None, "one two three four five six seven", "a")] * 700 + [(None, "x " * rng.randint(0, 40), "b") for _ in range(300)]
    docs += [(7, f"{k} " * rng.randint(1, 30), "c") for k in range(200)] + [(8, "y y", None)] * 90
    runs = [sorted(map(repr, mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(n), lot=lot).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
    check(mixing.mix(spark.createDataFrame(docs, SCHEMA), lot=lot).collect(), docs)


@pytest.mark.parametrize("lot", [20_000, 2])
def test_low_weights(spark, lot):
    rng = random.Random(2)
    docs = [(k, "w " * rng.randint(1, 9) + "#" * rng.randint(0, 4000), "one") for k in range(900)] + [(k, "w w " * rng.randint(1, 90), "two") for k in range(100)]
    check(mixing.mix(spark.createDataFrame(docs, SCHEMA), lot=lot).collect(), docs)


def test_many_sources(spark):
    rng = random.Random(3)
    docs = [(k, "w " * rng.randint(0, 12), rng.choice([None, "", "é", *map(str, range(60))])) for k in range(1500)]
    check(mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect(), docs)


def test_low_quality_is_taken_less(spark):
    docs = [(k, "w " * 20 + ("#" * 4000 if k % 2 else ""), "a") for k in range(400)] + [(k, "w " * 20, "b") for k in range(2000)]
    rows = mixing.mix(spark.createDataFrame(docs, SCHEMA), weights=(1, 30)).filter("source_size = 8200").collect()
    good, bad = (sum(r.times for r in rows if r.doc_id % 2 == k) for k in (0, 1))
    assert good > 2 * bad


def test_other_columns_may_have_any_name(spark):
    names = "_source _size target _id _bucket size place doc id times last edge n words before rest digit epochs taken draw weight row lot source_size col".split()
    df = spark.createDataFrame([(k, "w " * (k % 9), f"s{k % 3}", *range(len(names))) for k in range(60)], SCHEMA + "".join(f", {n} int" for n in names))
    out = mixing.mixed(df)
    assert out.schema == df.schema
    want = {r.doc_id: r.times for r in mixing.mix(df).collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
        assert [r[n] for n in names] == list(range(len(names)))
    assert got == {k: n for k, n in want.items() if n}


def test_mixed_takes_as_many_of_equal_rows(spark):
    docs = [(1, "a b c d", "x")] * 50 + [(None, "a b", "y")] * 70
    want = sum(r.times for r in mixing.mix(spark.createDataFrame(docs, SCHEMA), lot=7).collect())
    assert mixing.mixed(spark.createDataFrame(docs, SCHEMA).repartition(6), lot=7).count() == want
