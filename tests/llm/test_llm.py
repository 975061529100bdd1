"""The numbered operators against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import decontam, mixing, near_copies, pii, quality_model, quality_rules, repeats, secret_scan, simhash, token_store, url_filter
from tessera.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, fp string"
ODD = [None, "", " ", "a", "a b", "x\ty\nz  w", "é ü   日本", "word " * 30, "z" * 50_000, "same text here " * 40, "same text here " * 40]


def docs(spark, texts, source=lambda i: None if i % 5 == 0 else f"s{i % 3}"):
    """Rows with nulls, a repeated row and extra columns whose names the operators use inside."""
    rows = [(i, t, None if i % 4 == 0 else "en", source(i), None, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]] if rows else [], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = [words(rng, rng.randint(30, 200)) for _ in range(25)]
    made += [made[0], made[1] + " tail", made[2][:700] + " # " + made[3][:600]]
    return ODD + made


def test_repeats(spark, texts):
    for hot in (4000, 1):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts), span=60, gram=20, hot=hot).collect()}
        rows = [t.encode() if t else b"" for t in [*texts, texts[-1]]]
        seen = Counter(b[p : p + 60] for b in rows for p in range(len(b) - 59))
        for i, b in enumerate(rows[:-1]):
            cover = np.zeros(len(b), bool)
            for p in range(len(b) - 59):
                if seen[b[p : p + 60]] > 1:
                    cover[p : p + 60] = True
            kept = bytes(np.frombuffer(b, np.uint8)[~cover])
            runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
            assert got[i] == (len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()), (hot, i)


def test_merge_orders_and_shares():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
    out = list(repeats.merge([repeats.front_coded(r) for r in runs]))
    assert [x[2] for x in out] == sorted(x for r in runs for x in r)
    assert [x[3] for x in out[1:]] == [repeats.common(a[2], b[2]) for a, b in zip(out, out[1:])]


def test_simhash(spark, texts):
    from xxhash import xxh64_intdigest

    def fp(t):
        w = (t or "").encode().translate(simhash.LOWER).split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] * bool(w)
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0

    want = [fp(t) for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (want[i] ^ want[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (f"{want[i]:016x}", root[i]) for i in range(len(texts))}


def test_simhash_components(spark):
    rng = random.Random(3)
    fps = {0}
    for _ in range(60):
        x = rng.choice(sorted(fps))
        fps.add(x ^ 1 << rng.randint(0, 62) ^ 1 << rng.randint(0, 62) if rng.random() < 0.6 else rng.getrandbits(63))
    fps = sorted(fps)
    near = lambda a, b, r: (a ^ b).bit_count() <= r
    for radius in (1, 2):
        root = {f: f for f in fps}
        for _ in fps:
            for a in fps:
                for b in fps:
                    if near(a, b, radius):
                        root[a] = root[b] = min(root[a], root[b])
        df = spark.createDataFrame([(f,) for f in fps], "fp long")
        got = {r.node: r.root for r in simhash.components(simhash.links(df, radius)).collect()}
        assert got == {f: r for f, r in root.items() if any(near(f, g, radius) for g in fps if g != f)}


def test_quality_counts(spark, texts):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        w = b.split()
        win = defaultdict(list)
        for k in range(len(w) - 7):
            win[tuple(w[k : k + 8])].append(k)
        rep = {k + d for ks in win.values() if len(ks) > 1 for k in ks for d in range(8)}
        lines = [x for x in b.split(b"\n") if x.split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(b.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.kept(docs(spark, texts)).columns == docs(spark, texts).columns


def test_mixing(spark, texts):
    a, b = (sorted(map(tuple, mixing.mix(docs(spark, texts).repartition(n)).collect())) for n in (2, 5))
    assert a == b and len(a) == len(texts) + 1
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for (doc, size, source_size, target, times, taken) in a:
        assert taken == times * size and 0 <= times <= 2
        s = by[None if doc % 5 == 0 else f"s{doc % 3}"]
        s[0] += size
        s[1] += taken
        s[2] = target
        s[3] = max(s[3], size)
        assert source_size >= size
    names = sorted(by, key=lambda x: (x is None, x or ""))
    goal, weight = 1.5 * sum(s[0] for s in by.values()), {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    want, capped = {}, set()
    while True:
        left = goal - sum(2 * by[n][0] for n in capped)
        want = {n: 2.0 * by[n][0] if n in capped else left * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names}
        over = {n for n in names if want[n] > 2 * by[n][0] + 1e-9}
        if not over:
            break
        capped |= over
    for n in names:
        assert abs(by[n][2] - want[n]) < 1e-6 and abs(by[n][1] - want[n]) <= by[n][3]
    mixed = mixing.mixed(docs(spark, texts))
    assert mixed.columns == docs(spark, texts).columns and mixed.count() == sum(r[4] for r in a)


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want, at = [], 0
    for i, x in enumerate([*texts, texts[-1]]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((min(i, len(texts) - 1), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    shards = token_store.write_shards(docs(spark, texts), tokenizer(), shard_ids=2000)
    assert shards.count() > 3
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_shards(shards).collect())
    assert got == want


def test_quality_model(spark):
    rng = random.Random(6)
    texts = [words(rng, 60) if i % 2 else "BUY NOW!! " * 20 for i in range(400)]
    df = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, None)], "doc_id long, quality int")
    rows = quality_model.quality_scores(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 400)
    assert {r.score for r in quality_model.quality_scores(df, labels.filter("quality is null")).collect()} == {0.5}


def test_urls(spark):
    urls = ["http://A.example.com/en/7x?q", "http://b.net/de/1", "https://example.net/de/8#f", "http://x.org/es/", "ftp://bad.io/x", None, "nothing", "http://evilcom/en/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.page_id: r for r in url_filter.url_filter(pages, none).collect()}
    assert [(rows[i].rule, rows[i].verdict) for i in range(8)] == [
        ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    bad = spark.createDataFrame([(i, f"http://bad.io/{i}", "h") for i in range(40)] + [(100 + i, f"http://h{i % 9}.com/", "h") for i in range(90)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(100 + i, 1) for i in range(90)], "doc_id long, quality int")
    assert {(r.host, r.verdict) for r in url_filter.url_filter(bad, labels).collect()} == {("bad.io", "block"), *((f"h{k}.com", "allow") for k in range(9))}


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        simhash.near_duplicates(none), near_copies.without_near_copies(none), quality_rules.quality_rules(none), quality_rules.kept(none), mixing.mix(none), mixing.mixed(none),
        decontam.leaks(none, bench), decontam.without_leaks(none, bench), token_store.token_store(none, tokenizer()), secret_scan.secret_scan(none), pii.personal_data(none),
        quality_model.quality_scores(none, labels), repeats.remove_repeats(none),
    ):
        assert df.count() == 0


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[-1][:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert rows and all(n >= 20 for n in (len((texts[i] or "").split()) for i in ids)) and len(texts) - 1 not in ids
    assert sorted(r.start for r in rows)[0] == 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
