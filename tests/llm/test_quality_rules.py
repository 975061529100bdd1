"""Quality rules: fences and verdicts against brute force, clashing columns."""

import math
import random
from collections import defaultdict

from tessera.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, _n_words int, hi_symbols int, kept int, n_lines string, _lang string, bucket int"


def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, "a"), ("en", None)][: 2 if k < 500 else 5])
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9 if lang != "de" else 15))) for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.05:
            w = [x + "#" * 9 for x in w]
        if rng.random() < 0.05:
            w = [x * 12 for x in w]
        lines = [" ".join(w[i : i + 10]) for i in range(0, len(w), 10)]
        if rng.random() < 0.05:
            lines = [x for x in lines for _ in range(2)]
        rows.append((k, "\n".join(lines), lang, source))
    return rows + [(1000, None, "en", "a"), (1001, "", "xx", "y"), (1002, "word " * 5000, "en", "a"), rows[0]]


def counts(text):
    b = (text or "").encode()
    w = b.split()
    win = defaultdict(list)
    for k in range(len(w) - 7):
        win[tuple(w[k : k + 8])].append(k)
    rep = len({k + d for ks in win.values() if len(ks) > 1 for k in ks for d in range(8)})
    lines = [x for x in b.split(b"\n") if x.split()]
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(b.count(c) for c in b"#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": rep, "n_lines": len(lines)}


def quartile(values, part):
    at = sorted(math.floor(math.log(1 + v / q.UNIT) / math.log(q.GROWTH)) for v in values)[math.ceil(len(values) * part) - 1]
    return (q.GROWTH ** (at + 0.5) - 1) * q.UNIT


def verdicts(rows):
    found = [(counts(t), (lang, source)) for _, t, lang, source in rows]
    failed = [c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"] for c, _ in found]
    values = defaultdict(list)
    for (c, group), bad in zip(found, failed):
        if not bad:
            for name, a, b, *_ in q.RATIOS:
                values[group, name].append(c[a] / c[b])
                values[None, name].append(c[a] / c[b])
    out = []
    for (c, group), bad in zip(found, failed):
        broken = []
        for name, a, b, distance, lower in q.RATIOS:
            own, every = values.get((group, name)), values[None, name]
            if not own or not c[b]:
                continue
            low, high = ((quartile(own, p) * len(own) + quartile(every, p) * q.PRIOR) / (len(own) + q.PRIOR) for p in (0.25, 0.75))
            apart = max(high - low, distance) * q.REACH
            v = c[a] / c[b]
            if v > high + apart or lower and v < low - min(apart, low * 0.75):
                broken.append(name)
        out.append((bad, not bad and not broken, sorted(broken)))
    return out


def test_verdicts_against_brute_force(spark):
    rows = corpus()
    want = verdicts(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4) for r in rows], SCHEMA).repartition(5)
    got = defaultdict(list)
    for r in q.quality_rules(df).collect():
        got[r.doc_id].append((r.base_failed, r.kept, sorted(r.failed_rules)))
    for r, w in zip(rows, want):
        assert w in got[r[0]], r[0]
    assert sum(map(len, got.values())) == len(rows) and sum(not k and not b for b, k, _ in want) > 20
    kept = q.kept(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r, w in zip(rows, want) if w[1])
