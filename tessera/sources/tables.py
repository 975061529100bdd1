"""Tables in and out, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    Where none is set a local session gets a temporary one (tests); on a
    cluster that is an error, as executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_dir(spark: SparkSession) -> str:
    """The folder below the shared one in which this application's tables lie."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove the tables that this application has written to cut lineage; results that still read them must be written first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replace_projects(rows: DataFrame, path: str) -> None:
    """Replace all rows of the projects that ``rows`` holds, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert(rows: DataFrame, path: str, keys: list[str], newest: str = "updated_at", by: str = "project_id") -> None:
    """Put ``rows`` into the table at ``path``: one row per key, the one with the largest ``newest``.

    Only partitions (``by``, one of the keys) that new rows fall in are read
    and written. What they will hold is written beside the table first, so
    ``rows`` may come from the table itself and a lost executor costs a stage;
    then Spark's committer puts the finished partitions in place of the old
    ones, so a job that fails before leaves the table as it was. Of rows of a
    key with the same ``newest`` those of ``rows`` win; columns of the table
    that ``rows`` lacks become null.
    """
    spark = rows.sparkSession
    new = rows.withColumn("_new", F.lit(1))
    both = new
    if exists(spark, path):
        held = spark.read.parquet(path)
        old = held.join(F.broadcast(partitions(rows, by)), by, "left_semi").withColumn("_new", F.lit(0))
        both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(newest, "_new"))
    staged = materialise(both.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*").drop("_new"), "upsert")
    staged.repartition(by, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def partitions(rows: DataFrame, by: str, most: int = 100_000) -> DataFrame:
    """The distinct values of a partition column, which a table has few of: more than ``most`` are an error, as no table is laid out by so many."""
    found = materialise(rows.select(by).distinct(), "partitions")
    if found.count() > most:
        raise ValueError(f"{by} has over {most} values, which is no partition column")
    return found


def append(rows: DataFrame, path: str, *key: str) -> None:
    """Append rows, each with an object key built from columns."""
    rows.withColumn("object_key", F.concat_ws("/", *key)).write.mode("append").parquet(path)


def corpus(spark: SparkSession, root: str, glob: str = "*", most: int = 4 << 20) -> DataFrame:
    """Files below a folder: (path, size, content), those above ``most`` bytes marked ``skipped`` and without content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return rows.select("path", F.col("length").alias("size"), F.when(F.col("length") <= most, F.col("content")).alias("content"), (F.col("length") > most).alias("skipped"))


def manifests(files: DataFrame) -> DataFrame:
    """Dependency manifests among files, by name."""
    name = F.lower(F.substring_index("path", "/", -1))
    return files.filter((name == "pom.xml") | name.rlike(r"^(.*-)?requirements\.txt$"))


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A labelled data set, a JSON document with an array ``samples``, as a row per sample."""
    return spark.read.schema(f"version string, samples array<struct<{schema}>>").option("multiLine", "true").json(path).select("version", F.explode("samples").alias("s")).select("version", "s.*")
