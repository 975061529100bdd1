"""Copies of a text don't reach the sort of suffixes again and again."""

import random
import uuid

import pytest

from tessera.llm import repeats


@pytest.mark.parametrize("hot", [4000, 1])
@pytest.mark.parametrize("often", [1000, 1])
def test_copies_are_sorted_once(spark, tmp_path, monkeypatch, hot, often):
    name, folder = ("sorted_runs" if hot > 1 else "single_windows"), str(tmp_path)
    inner = getattr(repeats, name)
    monkeypatch.setattr(repeats, "OFTEN", often)

    def counted(batches, **more):
        def seen():
            for batch in batches:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write("\n".join(map(str, batch.column("t1").to_pylist())))
                yield batch

        yield from inner(seen(), **more)

    monkeypatch.setattr(repeats, name, counted)
    rng = random.Random(9)
    text = " ".join(str(rng.random()) for _ in range(30))
    near = text[:250] + "#" + text[251:]
    df = spark.createDataFrame([*((i, text) for i in range(50)), (50, near), *((None, text) for _ in range(50))], "doc_id long, text string").repartition(8)
    rows = repeats.remove_repeats(df, span=60, gram=20, hot=hot).collect()
    texts = [t for f in tmp_path.iterdir() for t in f.read_text().split()]
    assert len(texts) == len(set(texts)) == 2
    assert len(rows) == 101 and all(r.n_removed == r.n_bytes for r in rows if r.doc_id != 50)
