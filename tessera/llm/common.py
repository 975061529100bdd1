"""Helpers that the training-data operators share.

Everything here keeps data on the executors: tables that cut lineage are
written below the shared folder named by ``spark.checkpoint.dir``, and tables
are broadcast only after their rows have been counted against a bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialise, shared_dir

__all__ = ["materialise", "shared_dir", "small", "by_key", "dealt", "plus", "word_count", "as_bytes", "flat", "summed", "slices", "components"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table counts as small enough to broadcast.
BROADCAST_ROWS = 50_000
#: A key counts as frequent if this number times its rows is all rows or more, so that many keys are frequent at most.
OFTEN = 1000
#: Parts that the rows of a frequent key are dealt into.
SALTS = 256


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_key(rows: DataFrame, keyed: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row per key and says in ``n`` how many rows have it.

    Keys of a thousandth of all rows or more, a thousand at most at any size,
    are broadcast, so that none of them meets in one task; the others are
    shuffled.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    often = F.broadcast(keyed.filter(F.col(n) * OFTEN >= total).drop(n))
    seldom = rows.join(often.select(key), key, "left_anti").join(keyed.drop(n), key, how)
    return rows.join(often, key).unionByName(seldom)


def dealt(rows: DataFrame, keyed: DataFrame, key: Sequence[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined in one pass with ``keyed``, which has a row per key and says in ``n`` how many rows have it.

    Rows of keys that a thousandth of all rows have are dealt into ``SALTS``
    parts by a hash of the row, and such keys, a thousand at most at any size,
    are repeated for each part, so no key meets in one task.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * OFTEN >= total
    often = F.broadcast(keyed.filter(hot).select(*key, F.lit(True).alias("_often")))
    salt = F.when(F.col("_often"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(often, list(key), "left").withColumn("_salt", salt).drop("_often")
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(keyed.withColumn("_salt", F.explode(parts)), [*key, "_salt"], how).drop("_salt")


def plus(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """A copy of ``schema`` with more fields."""
    out = T.StructType(list(schema.fields))
    for name, kind in fields:
        out.add(name, kind)
    return out


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes, nulls as empty texts."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).fill_null(b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column behind each other, and where each value starts (one more entry than values)."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - (offsets[0] if len(column) else 0)


def summed(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks between neighbouring offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[offsets])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= most:
            yield batch
            continue
        offsets = flat(as_bytes(batch.column(column)))[1]
        cuts = np.flatnonzero(np.diff(offsets[1:] // most)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (node, root), root being the smallest node.

    Every node keeps the smallest root seen among its neighbours, then roots
    are replaced by the roots of their roots (pointer jumping), so the rounds
    grow with the logarithm of the longest chain. Each round is one aggregate
    and two joins over node rows; states are written to the shared folder.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:  # roots only fall, so it ends
        seen = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        hooked = state.join(seen, state.node == seen.a).select("node", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        # the root's own smaller root pulls whole trees along
        pulled = hooked.groupBy(F.col("old").alias("t")).agg(F.min("root").alias("to"))
        moved = (
            hooked.join(pulled, hooked.root == pulled.t, "left")
            .join(state.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left")
            .select("node", "old", F.least("root", F.coalesce("to", "root"), F.coalesce("r2", "root")).alias("root"))
        )
        moved = materialise(moved, "roots")
        state = moved.select("node", "root")
        if moved.filter("old <> root").isEmpty():
            return state
