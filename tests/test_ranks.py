"""Ranks over ranges against row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked


def test_ranks_are_row_numbers(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.col("id") % 7).otherwise(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("o"), "id")
    got = ranked(rows, ["g"], [F.desc("o"), "id"], "place", "total")
    of = Window.partitionBy("g")
    want = rows.withColumns({"place": F.row_number().over(of.orderBy(F.desc("o"), "id")), "total": F.count(F.lit(1)).over(of)})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert ranked(rows.limit(0), ["g"], ["id"]).collect() == []
    at_once = ranked(rows, [], ["id"]).collect()
    assert sorted((r.id, r.nth) for r in at_once) == [(k, k + 1) for k in range(5000)]
