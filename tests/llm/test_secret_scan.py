"""Secrets: base spans and ownership against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tessera.llm import common, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain(text):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def label(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def corpus():
    rng = random.Random(8)
    live = ["Zx9aB3dE6gH8jK1mN4pQ7", "Qw2eR4tY6uI8oP0aS1dF3", "Mn7bV5cX3zL1kJ9hG8fD6"]
    pieces = ["password", "API_KEY", "apikey", "Token", '"', "'", " ", ":", "=", " = ", "é", "\n", "abc123", "x.y-z/+", "AKIA", "A1" * 8, "0123456789abcdef", "00ff" * 6, "hunter", *live]
    texts = [None, "", " ", "z" * 100_000, "password: " + "a" * 100_000, "token=" * 3000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 16))) for _ in range(400)]
    texts += [f"key {live[0]} here"] * 300
    return texts, [rng.choice([None, "s1", "s2"]) if k % 2 else "s3" for k in range(len(texts))], [rng.choice([None, "en", "de", "fr"]) for _ in texts]


@pytest.mark.parametrize("often", [1000, 1])
def test_against_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(common, "OFTEN", often)
    texts, owners, repositories = corpus()
    rows = list(zip(range(len(texts)), texts, owners, repositories, range(len(texts))))
    df = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, source string, lang string, owners int").repartition(5)
    where, spans = defaultdict(set), []
    for t, o, r in zip(texts, owners, repositories):
        base = plain(t or "")
        more = [(s, 3, e, v) for s, e, _, v in secret_scan.candidates(t or "", [(s, e, k, v) for s, k, e, v in base])]
        spans.append((base, more))
        for *_, v in base + more:
            where[v].add((o, r))
    is_live = {v: len({o for o, _ in w}) < 2 and len(w) < 4 for v, w in where.items()}
    got = sorted(secret_scan.secret_scan(df).collect())
    assert len(got) == len(texts) + 1
    for r in got:
        base, more = spans[r.doc_id]
        every = sorted(base + [x for x in more if is_live[x[3]]])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(label(base).encode()).hexdigest() and r.spans == label(every)
        assert (r.n_live, r.n_example) == (sum(is_live[x[3]] for x in base), sum(not is_live[x[3]] for x in base))
        assert r.n_added == len(every) - len(base)
        assert r.most_owners == max((len({o for o, _ in where[x[3]]}) for x in every), default=0)
        assert r.most_repositories == max((len(where[x[3]]) for x in every), default=0)


def test_owners_and_repositories_both_decide(spark):
    one, copied, spread = "Zx9aB3dE6gH8jK1mN4pQ7", "Yw8cD2fG5hJ7kL9nP3rS6", "Tv5bN8mK2jH4gF6dS9aQ1"
    rows = [(0, one, "s", "a"), (1, one, "s", "b"), (2, copied, "s", "a"), (3, copied, "t", "a"), *((4 + k, spread, "s", f"r{k}") for k in range(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.n_added for r in secret_scan.secret_scan(df).collect()} == {0: 1, 1: 1} | dict.fromkeys(range(2, 8), 0)
    assert secret_scan.secret_scan(df.limit(0)).count() == 0
