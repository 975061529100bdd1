"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts are lower-cased (A-Z), cut into words and shingles, and every shingle is
hashed with XXH64; a fingerprint bit is set if over half of the hashes set it.
Two fingerprints at ``radius`` or fewer differing bits have a variant in
common that is at most half the radius away from both. So every distinct
fingerprint emits all its variants within half the radius, the variants are
shuffled, and fingerprints that meet on one are verified and linked to the
smallest of them. Documents with equal fingerprints are grouped first, so a
group of copies counts once however large it is, and a variant can be met by
no more fingerprints than its ball holds.

Cases: null and empty texts, and texts of white space, have fingerprint zero
and are linked like any other; repeated rows share their fingerprint; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_key, components, materialise, plus, slices

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bit_counts(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For runs of hashes (of the given lengths, behind each other) how many set each of the 64 bits."""
    out = np.zeros((len(lengths), BITS), np.int64)
    to = np.cumsum(lengths)
    start = to - lengths
    some = np.flatnonzero(lengths)
    for a in range(0, int(lengths.sum()), AT_ONCE):
        b = min(a + AT_ONCE, int(to[-1]))
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(to[some], a, "right"), np.searchsorted(start[some], b, "left")
        rows = some[first:last]
        at = np.maximum(start[rows] - a, 0)
        out[rows] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return out


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if not words:
            continue
        if len(words) <= shingle:
            found = [b" ".join(words)]
        else:
            found = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))  # noqa: B905
        hashes += [xxh64_intdigest(x, SEED) for x in found]
        lengths[i] = len(found)
    counts = bit_counts(np.array(hashes, np.uint64), lengths)
    bits = (2 * counts > lengths[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long."""
    schema = plus(docs.schema, (name, "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = fingerprints(as_bytes(batch.column(text_col)).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` differing bits of ``fp``, as an array."""
    masks = [0, *(reduce(lambda x, k: x | 1 << k, ks, 0) for r in range(1, radius + 1) for ks in combinations(range(BITS), r))]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all at ``radius`` or fewer bits."""
    variants = fps.select("fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> least")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) > radius
    near = met.filter(~far).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    if radius % 2 == 0:
        return near  # whatever meets on a variant is within the radius
    # an odd radius lets fingerprints meet that are one bit too far apart: link all that are near within the ball
    pairs = variants.alias("x").join(variants.alias("y"), "variant").filter("x.fp < y.fp")
    return pairs.filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicates: doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest id in the group), a row per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(with_fingerprint(rows, "text", shingle).drop("text"), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = components(links(fps.select("fp"), radius))
    named = fps.join(found, fps.fp == found.node, "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = materialise(named.join(smallest, "root").select("fp", "n", "component_id"), "component-ids")
    return by_key(rows, ids, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
