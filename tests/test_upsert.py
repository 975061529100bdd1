"""The upsert sink: read, upsert, read back; a failed job leaves the old table."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import tables

SCHEMA = "project_id int, path string, checksum string, updated_at int"
KEYS = ["project_id", "path"]


def found(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("project_id", "path", "checksum", "updated_at").collect())


def files(path, project):
    return sorted(f for f in os.listdir(f"{path}/project_id={project}") if f.endswith(".parquet"))


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    tables.upsert(df([(1, "a", "x", 1), (1, "b", "x", 1), (2, "a", "x", 1), (2, "a", "w", 0)]), path, KEYS)
    assert found(spark, path) == [(1, "a", "x", 1), (1, "b", "x", 1), (2, "a", "x", 1)]
    untouched = files(path, 2)
    tables.upsert(df([(1, "a", "y", 1), (1, "b", "old", 0), (3, "c", "z", 5)]), path, KEYS)
    assert found(spark, path) == [(1, "a", "y", 1), (1, "b", "x", 1), (2, "a", "x", 1), (3, "c", "z", 5)]
    assert files(path, 2) == untouched
    tables.upsert(spark.read.parquet(path).withColumn("updated_at", F.col("updated_at") + 1), path, KEYS)
    assert found(spark, path) == [(1, "a", "y", 2), (1, "b", "x", 2), (2, "a", "x", 2), (3, "c", "z", 6)]
    tables.upsert(df([]), path, KEYS)
    before = found(spark, path)
    with pytest.raises(Exception, match="stop"):
        tables.upsert(df([(1, "a", "bad", 9), (2, "n", "bad", 9)]).withColumn("checksum", F.when(F.col("project_id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("checksum"))), path, KEYS)
    assert found(spark, path) == before
