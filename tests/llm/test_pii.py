"""Personal data: base spans against the plain patterns, the field against lines it has not seen, and what it adds."""

import hashlib
import random
import re
from itertools import product

import numpy as np

from tessera.llm import pii
from tessera.llm.pii_table import LABELLED

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Lines the field is not trained on: text, and the personal data in it that no pattern finds.
UNSEEN = [
    ("you may call (303) 555-0142 any time", "303"), ("fax 212-555-0188 now", "212"), ("tel. 040 7654321", "040"), ("ligne 06 98 76 54 32 ouverte", "06"), ("host 2001:db8::42:1 died", "2001"),
    ("charged 4012.8888.8888.1881 again", "4012"), ("+1 (555) 555-0100 4692571279950054", "+1"), ("send it to boss@devbox today", "boss"),
    ("in 2011 and 2012 we had 23", None), ("license 2.0. or 3.0", None), ("order 1234567890123456 arrived", None), ("at 11:15 on 2020-02-28", None), ("pages 100-120 of 300", None),
    ("1999-2003", None), ("ISBN 978-0-306-40615-7", None), ("zip 60601", None), ("score 4-1", None), ("a@b.example and 10.0.0.1", None),
]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [(s, e, pii.BASE[k]) for s, k, e in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    pieces = ["a", "é", "@", ".", "..", "-", " ", "\n", "+", "(", ")", "x.y", "1", "25", "255", "256", "0", "4111111111111111", "4111 1111 1111 1111", "+1 212 555 0147", "10.0.0.1", "a@b.c", "%"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = plain(text)
        assert pii.base_spans(text) == want, text
        found += len(want)
    assert found > 5000
    for text in ("9" * 5000, "a" * 5000 + "@", "1." * 3000, "+1" * 2000, "@" * 3000):
        assert pii.base_spans(text) == plain(text)


def test_field_finds_what_patterns_miss():
    field = pii.train(LABELLED)
    right = 0
    for text, start in UNSEEN:
        base, every = pii.find(field, [text])[0]
        more = [x for x in every if x not in base]
        right += (not more) if start is None else len(more) == 1 and text[more[0][0] :].startswith(start)
        assert set(base) <= set(every) and base == plain(text)
    assert right >= len(UNSEEN) - 1


def test_field_fits_its_table():
    field = pii.train(LABELLED)
    found = [x for line in LABELLED for x in pii.labelled(line)]
    got = pii.decode(field, [c for c, _ in found])
    words = [(int(a), b) for ys, (_, want) in zip(got, found) for a, b in zip(ys, want)]
    assert sum(a == b for a, b in words) >= 0.98 * len(words)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    n = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.BUCKETS, n)), rng.normal(size=(n + 1, n)))
    x, lengths = rng.integers(0, pii.BUCKETS, (6, 3, pii.N_FEATURES)), np.array([1, 2, 3, 3, 2, 1])
    got = field.viterbi(x, lengths)
    for k, length in enumerate(lengths):
        score = lambda y: field.move[-1, y[0]] + sum(field.emit[x[k, j]].sum(0)[y[j]] for j in range(len(y))) + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023
        assert tuple(got[k, :length]) == max(product(range(n), repeat=int(length)), key=score)


def test_query(spark):
    texts = ["mail a.b+c@x-y.co.uk, ip 10.0.0.255 and 1.2.3.256", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (212) 555-0147 or (242) 555-6226", "", None, "z" * 300_000, "call (242) 555-6226 " * 3000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_added int, spans string").repartition(3)
    rows = sorted(pii.personal_data(df).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts) + 1))
    label = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    for r, t in zip(rows, [*texts, texts[0]]):
        want = plain(t or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in want) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(label(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf_")] == [s for s in label(want).split(",") if s]
    assert rows[2].spans == "phone:5:22,crf_phone:26:40" and rows[2].n_added == 1 and rows[6].n_added == 3000
    none = spark.createDataFrame([], "line string")
    assert {r.n_added for r in pii.personal_data(df, none).collect()} == {0}


def test_long_chains_in_pieces(monkeypatch):
    field = pii.train(pii.LABELLED)
    rng = random.Random(11)
    words = [rng.choice(["12", "+49", "555-1234", "a@b.co", "10.0.0.1", "4111", "x1"]) for _ in range(700)]
    texts = [" ".join(words), "1", "a 7 b\n" * 50, "call +1 202 555 0199 now", " ".join(words[:63]), " ".join(words[:64]), " ".join(words[:65])]
    found = [c for t in texts for c in pii.chains(t)]
    whole = pii.decode(field, found)
    one_by_one = [field.viterbi(*pii.padded([c]))[0] for c in found]
    monkeypatch.setattr(pii, "PIECE", 64)
    monkeypatch.setattr(pii, "CELLS", 100)
    for got in (whole, pii.decode(field, found)):
        assert all(a.tolist() == b.tolist() for a, b in zip(got, one_by_one, strict=True))


def test_many_numbers_stay_small():
    import tracemalloc

    field = pii.train(pii.LABELLED)
    texts = ["a 1 " * 3000, "1 " * 20_000, "b 22\n" * 3000]
    found = [c for t in texts for c in pii.chains(t)]
    tracemalloc.start()
    assert len(pii.decode(field, found)) == len(found) and max(len(c.words) for c in found) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
