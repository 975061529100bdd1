"""What a scan of source trees reads: files (project_id, file_path, content) in order of their path, counted by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

#: Fixed value: characters above which a source is not read.
MOST_CHARS = 4 << 20


def readable(content: Column, most_chars: int = MOST_CHARS) -> Column:
    """Whether a source can be read: it is there and not too long, in characters."""
    return content.isNotNull() & (F.length(content) <= most_chars)


def placed(files: DataFrame, suffix: str = ".java", most_files: int | None = None, most_chars: int = MOST_CHARS) -> DataFrame:
    """Files that end in ``suffix`` as (project_id, file_path, nth, status), without their content.

    nth is a file's place in its project by path; status is SCANNED, SKIPPED
    (absent or longer than ``most_chars``) or, beyond the first ``most_files``,
    TRUNCATED. No project is one task.
    """
    own = files.filter(F.col("file_path").endswith(suffix))
    slim = own.select("project_id", "file_path", F.when(readable(F.col("content"), most_chars), "SCANNED").otherwise("SKIPPED").alias("status"))
    rows = ranked(slim, ["project_id"], ["file_path"])
    if most_files is not None:
        rows = rows.withColumn("status", F.when(F.col("nth") > most_files, "TRUNCATED").otherwise(F.col("status")))
    return rows.select("project_id", "file_path", "nth", "status")


def chosen(files: DataFrame, suffix: str = ".java", most_files: int | None = None, most_chars: int = MOST_CHARS) -> DataFrame:
    """The files that a scan reads, with their content; without a limit on files nothing is shuffled."""
    own = files.filter(F.col("file_path").endswith(suffix))
    if most_files is None:
        return own.filter(readable(F.col("content"), most_chars))
    first = placed(files, suffix, most_files, most_chars).filter("status = 'SCANNED'").select("project_id", "file_path")
    return own.join(first, ["project_id", "file_path"], "left_semi")


def report(rows: DataFrame) -> DataFrame:
    """Per project of ``placed`` rows: total, scanned (looked at, those skipped included), skipped, truncated, and the first file left out."""
    over = F.col("status") == "TRUNCATED"
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~over).alias("scanned"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.bool_or(over).alias("truncated"), F.min_by("file_path", F.when(over, F.col("nth"))).alias("first_left"),
    )
