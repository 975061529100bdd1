"""Ranks within groups of any size, where no group is one task, and rows dealt so that tasks stay small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: Rows of a partition that ``monotonically_increasing_id`` can count.
ROWS = 1 << 33
#: Rows of small groups that a task is dealt.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt by ``keys`` over so many partitions that each holds about ``most`` rows or fewer, whatever Spark's number of partitions; for windows and aggregates over groups that are small themselves."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // most)), *keys)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "nth", total: str | None = None) -> DataFrame:
    """``rows`` with their place in their group by ``order``, from 1, as ``row_number`` over a window gives it; with ``total`` also the group's rows.

    Rows are dealt by ranges of group and order and sorted there, so a large
    group lies in many partitions. A row's place is its place in its partition
    plus what earlier partitions hold of its group: a table of a row for each
    partition and group, over which alone a window runs. Rows that agree in
    ``order`` get places in no fixed order.
    """
    group = list(group)
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.floor(F.col("_at") / ROWS).alias("_part")
    held = materialise(dealt.groupBy(*group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "rank-offsets")
    # nulls are a group like any other
    same = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(same).alias("_total"))
    on = F.floor(F.col("_at") / ROWS) == F.col("_p")
    for k, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    out = dealt.join(held, on).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return out.select(*rows.columns, name, *([F.col("_total").alias(total)] if total else []))
