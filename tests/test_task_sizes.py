"""Tasks stay small as tables grow: rows are dealt by their number, pairs are checked as they meet, little is broadcast unasked."""

from functools import partial

from pyspark.sql import functions as F
from tessera import session
from tessera.operators import issues, manifests, ranks
from tessera.sources import tables


def test_rows_are_dealt_by_their_number(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(1000).withColumn("k", F.col("id") % 500)
    assert ranks.dealt(rows, "k", most=10).rdd.getNumPartitions() == 100
    assert ranks.dealt(rows, "k").rdd.getNumPartitions() == parts


def test_declarations_of_a_file_are_dealt_and_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(manifests, "dealt", partial(ranks.dealt, most=10))
    rows = [(1, f"f{k}", k % 7, n, f"g:{k % 3}", None if n == 2 else "1" if n == 0 or k % 2 else "2") for k in range(100) for n in range(3)]
    rows += [(None, None, 4, 0, "g:x", "1"), (None, None, 5, 1, "g:x", "3"), (2, "once", 1, 0, "g:1", "1")]
    coords = spark.createDataFrame(rows, "project_id long, file_path string, line long, ordinal long, dep_id string, version string")
    found = manifests.conflicts(coords)
    assert found.rdd.getNumPartitions() == 31
    assert sorted((r.file_path or "", r.line) for r in found.collect()) == sorted([("", 5), *((f"f{k}", k % 7) for k in range(0, 100, 2))])
    assert sorted(r.file_path for r in manifests.duplicates(coords).collect()) == sorted(f"f{k}" for k in range(1, 100, 2))


def test_lines_are_checked_as_issues_meet_files(spark):
    text = "\n".join("abc")
    files = spark.createDataFrame([(1, f"f{k}", 0, text if k < 5 else None) for k in range(6)], "project_id long, file_path string, slot long, content string")
    counts = files.select("project_id", "file_path", "slot").join(issues.line_counts(files), ["project_id", "file_path"])
    found = spark.createDataFrame([(1, line, line, 0) for line in range(6)], "project_id long, line long, pos long, slot long")
    marks = issues.line_marks(found, counts, ["project_id", "slot"])
    assert sorted((r.file_path, r.line) for r in marks.collect()) == [(f"f{k}", n) for k in range(5) for n in (1, 2, 3)]
    # nothing moves behind the join of issues and files
    plan = marks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "line#" in next(x for x in plan.splitlines() if "Join" in x)


def test_tables_that_files_hide_are_not_broadcast(spark):
    # 40 MB of texts that repeat themselves: their files take less than the 10 MB that Spark would broadcast
    table = tables.materialise(spark.range(20_000).withColumn("text", F.repeat(F.md5(F.col("id").cast("string")), F.lit(60))), "hidden")
    assert 256 << 10 < table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 << 20
    joined = spark.range(2_000_000).join(table, "id")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_threshold_of_the_session_stays(spark):
    before = spark.conf.get(session.UNASKED)
    try:
        for own, then in (("64m", "64m"), ("-1", "-1"), ("10485760b", str(session.UNASKED_BYTES))):
            spark.conf.set(session.UNASKED, own)
            session.ship(spark)
            assert spark.conf.get(session.UNASKED) == then
    finally:
        spark.conf.set(session.UNASKED, before)
