"""Streams whose state ends, against the batch operators, with events out of order, late and repeated."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.streaming import streams


def feed(spark, folder, batches, schema):
    """Each batch as a file, in order of their names; a stream reads one a trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{folder}/{k:03d}")
    whole = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return whole, stream


def run(spark, df, name, mode, checkpoint):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    states = q.lastProgress.stateOperators[-1].numRowsTotal
    q.stop()
    return spark.table(name).collect(), states


def shuffled(rng, rows, late):
    """Rows in batches, each delayed by up to ``late`` seconds, some twice, and an event far ahead that lets the watermark pass."""
    rows = rows + rng.sample(rows, len(rows) // 5)
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(late))
    return [rows[k : k + 40] for k in range(0, len(rows), 40)]


def test_reviews(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(12), 9000 + 60 * k, k, rng.choice(["REJECTED", "REJECTED", "PENDING", "REJECTED", "APPROVED", "MODIFIED"])) for k in range(160)]
    end = [(999, 10_000_000, 9999, "PENDING")]
    whole, stream = feed(spark, tmp_path / "in", [*shuffled(rng, rows, 500), *[end] * 4], "session_key long, s long, id long, decision string")
    got, left = run(spark, streams.review_states(stream, keep_days=1, late="10 minutes"), "reviews", "update", tmp_path / "cp")
    last = {}
    for r in got:
        last[r.session_key] = (r["round"], r.approved, r.terminated, r.last_status)
    last.pop(999, None)
    want = {r.session_key: (r["round"], r.approved, r.terminated, r.last_status) for r in sessions.review_states(whole.dropDuplicates(["session_key", "id"])).collect()}
    want.pop(999)
    assert last == want
    assert left <= 8  # of the session far ahead alone: its event, held or applied, and timers


def test_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(15), 9000 + 60 * k, k, rng.choice(["RUNNING", "RUNNING", "SUCCESS", "FAILED"])) for k in range(160)]
    end = [(999, 10_000_000, 9999, "RUNNING")]
    whole, stream = feed(spark, tmp_path / "in", [*shuffled(rng, rows, 500), *[end] * 4], "task_id long, s long, id long, event string")
    got, left = run(spark, streams.task_states(stream, keep_days=1, late="10 minutes"), "tasks", "update", tmp_path / "cp")
    of = lambda r: (r.status, r.started_at, r.finished_at, r.events, r.progress)
    last = {r.task_id: of(r) for r in got}
    want = {r.task_id: of(r) for r in sessions.task_states(whole.dropDuplicates(["task_id", "id"])).collect()}
    assert {k: v for k, v in last.items() if k != 999} == {k: v for k, v in want.items() if k != 999}
    assert left <= 8


def test_cache_entries(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(6), 9000 + 60 * rng.randrange(900), k) for k in range(240)] + [(7, 9000 + 1800 * k, 1000 + k) for k in range(9)]
    end = [(999, 10_000_000, 9999)]
    whole, stream = feed(spark, tmp_path / "in", [*shuffled(rng, rows, 500), *[end] * 4], "key long, s long, id long")
    got, left = run(spark, streams.cache_writes(stream, 3600, "10 minutes"), "writes", "append", tmp_path / "cp")
    want = sessions.cache_writes(whole.dropDuplicates(["key", "id"])).collect()
    assert sorted((r.key, r.id, r.ts) for r in got if r.key != 999) == sorted((r.key, r.id, r.ts) for r in want if r.key != 999) and len(got) > 20
    assert left <= 8


@pytest.mark.parametrize("restart", [False, True])
def test_intake_once(spark, tmp_path, restart):
    folder, taken, status = tmp_path / "in", str(tmp_path / "taken"), str(tmp_path / "status")
    folder.mkdir()
    spark.createDataFrame([(k, "PENDING" if k < 6 else "RUNNING") for k in range(9)], "task_id long, status string").write.parquet(status)
    lines = lambda rows: "".join(json.dumps({"task_id": t, "action": a, "ts": f"2024-01-01T00:00:{s:02d}Z"}) + "\n" for t, a, s in rows)
    rows = streams.messages(spark, str(folder), "task_id long, action string, ts timestamp", maxFilesPerTrigger="1")
    start = lambda: streams.intake(rows, spark.read.parquet(status), streams.replacing_batches(taken), ("PARSE",), str(tmp_path / "cp"))
    (folder / "a.json").write_text(lines([(1, "PARSE", 1), (1, "PARSE", 2), (2, "NO", 3), (None, "PARSE", 4), (7, "PARSE", 5)]))
    q = start()
    q.processAllAvailable()
    if restart:
        q.stop()
        q = start()
    (folder / "b.json").write_text(lines([(1, "PARSE", 6), (3, "PARSE", 7)]))
    q.processAllAvailable()
    (folder / "c.json").write_text(lines([(3, "PARSE", 8), (1, "PARSE", 8), (5, "PARSE", 9)]))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.task_id for r in spark.read.parquet(taken).collect()) == [1, 3, 5]
