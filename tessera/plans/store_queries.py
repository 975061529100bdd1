"""Queries that write tables or run streams below the shared folder and read back what they left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..streaming import streams
from .queries import View, query

#: Delay of a stream over rows that are all there already: none of them is late.
BACKFILL = "36500 days"


def folder(spark: SparkSession, label: str) -> str:
    return f"{tables.own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def arriving(v: View, name: str) -> DataFrame:
    """A table of the driver's as a stream of its files."""
    spark, root = v.args
    rows = streams.table(spark, f"{root}/{name}.parquet*", v(name).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time with a zone


# --- sources and sinks --------------------------------------------------------

NAMED = """(SELECT project_id, CASE size % 7 WHEN 0 THEN path || '/POM.xml' WHEN 1 THEN path || '/dev-Requirements.txt' WHEN 2 THEN path || '/requirements.txt' WHEN 3 THEN path || '/xrequirements.txt' WHEN 4 THEN 'pom.xml' ELSE path END AS path, size FROM {v_files})"""


@query(f"SELECT project_id, path, size FROM {NAMED} WHERE lower(string_split(path, '/')[-1]) IN ('pom.xml', 'requirements.txt') OR lower(string_split(path, '/')[-1]) LIKE '%-requirements.txt'")
def s2_manifest_files(v):
    way, under = F.col("size") % 7, lambda name: F.concat("path", F.lit(name))
    path = F.when(way == 0, under("/POM.xml")).when(way == 1, under("/dev-Requirements.txt")).when(way == 2, under("/requirements.txt")).when(way == 3, under("/xrequirements.txt")).when(way == 4, "pom.xml").otherwise(F.col("path"))
    return tables.manifests(v("v_files").withColumn("path", path)).select("project_id", "path", "size")


@query("SELECT 'v1' AS version, sample_id, category, array_to_string(required, ',') AS required, documentation FROM {v_expected}")
def s4_samples(v):
    rows = v("v_expected").select(F.floor(F.col("sample_id") / 1000).alias("part"), F.struct("sample_id", "category", "required", "documentation").alias("s"))
    document = F.to_json(F.struct(F.lit("v1").alias("version"), F.collect_list("s").alias("samples")))  # a thousand ids a document
    path = folder(rows.sparkSession, "samples")
    rows.groupBy("part").agg(document.alias("value")).write.partitionBy("part").text(path)
    got = tables.samples(rows.sparkSession, path, "sample_id bigint, category string, required array<string>, documentation boolean")
    return got.select("version", "sample_id", "category", F.array_join("required", ",").alias("required"), "documentation")


@query("SELECT project_id, pos, risk_level FROM {v_issues} WHERE project_id % 2 = 1 OR risk_level = 'HIGH' OR project_id NOT IN (SELECT project_id FROM {v_issues} WHERE risk_level = 'HIGH')")
def s7_replaced_projects(v):
    rows = v("v_issues").select("project_id", "pos", "risk_level")
    path = folder(rows.sparkSession, "issues")
    tables.replace_projects(rows, path)
    tables.replace_projects(rows.filter("project_id % 2 = 0 and risk_level = 'HIGH'"), path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("SELECT pos, part, 'reports/' || CAST(project_id AS STRING) || '/' || part || '/' || CAST(pos AS STRING) AS object_key FROM {v_issues}, (SELECT unnest(['a', 'b']) AS part) WHERE part = 'a' OR risk_level = 'HIGH'")
def s9_appended(v):
    rows = v("v_issues").select(F.lit("reports").alias("root"), F.col("project_id").cast("string").alias("project"), F.col("pos"), F.col("pos").cast("string").alias("name"), "risk_level")
    path = folder(rows.sparkSession, "reports")
    for part, chosen in (("a", rows), ("b", rows.filter("risk_level = 'HIGH'"))):
        tables.append(chosen.withColumn("part", F.lit(part)), path, "root", "project", "part", "name")
    return rows.sparkSession.read.parquet(path).select("pos", "part", "object_key")


# --- streams, run over a table's files until none is left ----------------------


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id % 10 AS project_id, CASE WHEN value >= 60 THEN 'HIGH' WHEN value >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, count(*) AS n FROM {events} GROUP BY ALL""")
def t7_live_counts(v):
    level = F.when(F.col("value") >= 60, "HIGH").when(F.col("value") >= 25, "MEDIUM").otherwise("LOW")
    rows = arriving(v, "events").select("ts", (F.col("user_id") % 10).alias("project_id"), level.alias("risk_level"))
    spark = rows.sparkSession
    path, key = folder(spark, "live"), ["project_id", "start", "risk_level"]

    def put(batch: DataFrame, nth: int) -> None:
        tables.upsert(batch.withColumn("updated_at", F.lit(nth)), path, key)  # a batch that is repeated changes nothing

    counts = streams.live_counts(rows, late=BACKFILL)
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", folder(spark, "live-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("project_id").cast("long").alias("project_id"), "risk_level", "n")


@query("SELECT DISTINCT user_id AS task_id FROM {events} WHERE event_type IN ('purchase', 'signup') AND user_id % 3 <> 0")
def t1_task_intake(v):
    tasks = arriving(v, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("action"), "ts")
    state = F.when(F.col("user_id") % 3 == 0, "DONE").otherwise("PENDING")
    status = v("events").select(F.col("user_id").alias("task_id"), state.alias("status")).distinct()
    spark = tasks.sparkSession
    path, seen = folder(spark, "taken"), folder(spark, "taken-state")
    for _ in range(2):  # the second run goes on where the first ended
        running = streams.intake(tasks, status, streams.replacing_batches(path), ("purchase", "signup"), seen, BACKFILL)
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return spark.read.parquet(path).select("task_id")
