"""Decontamination against brute force: every item in every passage, whatever the groups of the index."""

import random

import pytest

from tessera.llm import decontam


def sentence(rng, n):
    w = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    return (" ".join(w) + ".").capitalize() if w else ""


def runs(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def overlaps(text, item):
    """The best (whole, question, answer) of the item's passages, or None."""
    words, own, best = decontam.words_of(text or ""), decontam.words_of(item), None
    q, x = map(decontam.words_of, decontam.halves(item))
    q = q if x and len(q) >= 5 else []
    stride = 64
    while stride < 1.25 * len(own):
        stride *= 2
    for p in range(0, max(1, len(words)), stride):
        part = words[p : p + 2 * stride]
        got = []
        for s in (own, q, x):
            want = runs(s, min(5, len(s)))
            got.append(len(want & runs(part, min(5, len(s)))) / len(want) if want else 0.0)
        if max(got[:2]) >= 0.8 and (not x or got[2] >= 0.8):
            best = max(best or (0.0, 0.0, 0.0), tuple(got))
    return best


def cases():
    rng = random.Random(4)
    items = [" ".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 4))) for _ in range(30)]
    items += [sentence(rng, 400), " ".join(sentence(rng, 60) for _ in range(30)), "a b", "", None, ".", items[0], "one two three four five six. Yes"]
    docs = [None, "", " ", "a b", "x a b. c", "z" * 5000]
    for k in range(80):
        item = items[k % len(items)] or ""
        if k % 3 == 0:
            w = item.split()
            if w:
                w[rng.randrange(len(w))] = rng.choice([w[0], "zz"])
            item = " ".join(w).upper()
        elif k % 3 == 1:
            item = " blue ".join(decontam.halves(item)) if k % 2 else decontam.halves(item)[0]
        docs.append(" ".join([sentence(rng, rng.randint(0, 300)), item, sentence(rng, rng.randint(0, 300))]))
    return docs, items


def table(spark, docs):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, item_id int").repartition(3)


@pytest.mark.parametrize("group", [500_000, 200, 1])
def test_against_brute_force(spark, group):
    docs, items = cases()
    want = {(d, i): o for d, t in enumerate(docs) for i, x in enumerate(items) if x and (o := overlaps(t, x))}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.leaks(table(spark, docs), bench, group=group).collect()
    got = {(r.doc_id, r.item_id): (r.overlap, r.question_overlap, r.answer_overlap) for r in rows}
    rounded = lambda found: {k: tuple(round(x, 9) for x in v) for k, v in found.items()}
    assert len(rows) == len(got) and rounded(got) == rounded(want)
    assert any(w < 0.8 <= q for w, q, _ in want.values()) and len(want) > 30
    kept = decontam.without_leaks(table(spark, docs), bench, group=group)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs))) - {d for d, _ in want}) and kept.columns == ["doc_id", "text", "item_id"]


def test_other_items_change_nothing(spark):
    rng = random.Random(5)
    item, far = " ".join(sentence(rng, 12) for _ in range(3)), sentence(rng, 2000)
    docs = [sentence(rng, 50) + " " + item + " " + sentence(rng, 200), sentence(rng, 700) + " " + far]
    for more in ([], [far], [far, sentence(rng, 9000)]):
        bench = spark.createDataFrame(list(enumerate([item, *more])), "item_id long, text string")
        got = {(r.doc_id, r.item_id, r.overlap) for r in decontam.leaks(table(spark, docs), bench).collect()}
        assert got == {(0, 0, 1.0)} | ({(1, 1, 1.0)} if more else set())


def test_long_items_and_repeated_rows(spark):
    rng = random.Random(6)
    item = sentence(rng, 30_000)
    docs = [item, " ".join(item.split()[:4096]), " ".join(item.split()[100:3000])] * 2
    bench = spark.createDataFrame([(None, item), (3, "q"), (3, "q")], "item_id long, text string")
    rows = decontam.leaks(table(spark, docs), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, -1), (3, -1)]


def test_a_long_item_is_one(spark):
    rng = random.Random(7)
    item = " ".join(sentence(rng, 4096).rstrip(".").split() + ["the"])
    docs = ["over the hill", "nothing", "the", item]
    bench = spark.createDataFrame([(1, item), (2, "What is the name of the river? Elbe.")], "item_id long, text string")
    docs += ["What is the name of the river? Elbe. It is long.", "What is the name of the river? Rhine.", "Elbe"]
    assert sorted(r.doc_id for r in decontam.without_leaks(table(spark, docs), bench).collect()) == [0, 1, 2, 5, 6]
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(table(spark, docs), bench).collect()) == [(3, 1), (4, 2)]
