"""Removing near copies: of texts that share 80 % of their five-word shingles one stays.

Texts get SimHash fingerprints of these shingles, and those at ``RADIUS`` or
fewer differing bits meet by ball hashing, as in ``simhash``; texts that share
a fingerprint meet the smallest of them.

Fingerprints alone can't tell all: at a similarity of 0.8 about ten of 64 bits
differ, and balls of that radius are too large to shuffle. So a text also gets
shorter sketches, each of ``ROWS`` minima of its hashed shingles, and texts
that agree on all minima of one of ``BANDS`` sketches collide. A pair of
similarity s collides with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at
0.8, more above.

Whatever meets or collides is settled by the shingles themselves. The texts of a bucket
are checked against its smallest one, and groups are formed. Texts of a bucket
that are not in the group of its smallest one are then checked against all
others in it: the bucket is cut into blocks of ``MEMBERS`` texts or fewer, each
pair of blocks is one row, and its task compares sets of hashed shingles and
gives no more links than it has texts. So every pair that collides is decided,
however large a bucket is, and no pair of texts is a row of its own. There
shingles are known by 64 bits of a hash.

Copies of a text count once from the start. Of each group the row with the
smallest doc_id stays, null ids last; of several texts under that id the one
with the smallest hash, and of equal rows one. Texts are known by 64 bits of a
hash.

Cases: null texts, empty ones and those of white space share no shingle but
count as copies of each other; a text of up to five words is one shingle;
null or repeated ids and other columns of any name do no harm; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngram_join, simhash
from .common import as_bytes, by_key, components, materialise, slices
from .simhash import AT_ONCE, LOWER, SEED

SHINGLE, LEAST = 5, 0.8
#: Bits in which fingerprints that meet may differ.
RADIUS = 2
#: Sketches of a text, and minima in each.
BANDS, ROWS = 20, 5
#: Texts of a block, and their shingles.
MEMBERS, SHINGLES = 512, 1 << 20
_drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0xFF51AFD7ED558CCD)
EMPTY = ~np.uint64(0)


def shingles(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of a text."""
    words = text.translate(LOWER).split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))  # noqa: B905


def similar(a: set[bytes], b: set[bytes], least: float) -> bool:
    """Whether the Jaccard similarity is ``least`` or more; texts without shingles are alike."""
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def sketches(sets: list[set[bytes]]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set."""
    from xxhash import xxh64_intdigest

    out = np.empty((len(sets), BANDS), np.uint64)
    lengths = np.array([max(1, len(s)) for s in sets], np.int64)
    to = np.cumsum(lengths)
    begin = 0
    while begin < len(sets):
        end = max(begin + 1, int(np.searchsorted(to, to[begin] - lengths[begin] + AT_ONCE, "right")))
        hashes = np.array([h for s in sets[begin:end] for h in ([xxh64_intdigest(x, SEED) for x in s] or [int(EMPTY)])], np.uint64)
        starts = to[begin:end] - lengths[begin:end] - (to[begin] - lengths[begin])
        for band in range(BANDS):
            key = np.full(end - begin, band, np.uint64)
            for flip, times in _drawn[band]:
                least = np.minimum.reduceat((hashes ^ flip) * times, starts)
                key = (key ^ least) * MIX
                key ^= key >> np.uint64(32)
            out[begin:end, band] = key
        begin = end
    return out


def sketched(rows: DataFrame, shingle: int) -> DataFrame:
    """Of rows (id, key, text): id, key, n (shingles) and bands (keys of the sketches)."""
    schema = T.StructType([rows.schema["id"], rows.schema["key"]]).add("n", "integer").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t, shingle) for t in as_bytes(batch.column("text")).to_pylist()]
            keys = pa.array(sketches(sets).view(np.int64).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), bands], names=schema.names)

    return rows.select("id", "key", "text").mapInArrow(run, schema)


def texts_of(keys: DataFrame, rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, text) of distinct keys: of copies only rows with the smallest id are looked at, and of these one."""
    named = keys.join(distinct.select("key", F.col("least_id").alias("of")), "key").withColumnRenamed("key", "k")
    return rows.join(named, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("of"))).groupBy("key").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of pairs (a, b) of text keys those that are similar enough."""
    pairs = materialise(pairs.select("a", "b").distinct(), "near-pairs")
    named = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    texts = materialise(texts_of(named, rows, distinct), "near-texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 1 << 20):
            last, found, keep = None, set(), []
            for x, y in zip(as_bytes(batch.column("x")).to_pylist(), as_bytes(batch.column("y")).to_pylist(), strict=True):
                if x != last:
                    last, found = x, shingles(x, shingle)
                keep.append(similar(found, shingles(y, shingle), least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")


def by_fingerprint(rows: DataFrame, shingle: int, radius: int = RADIUS) -> DataFrame:
    """Of rows (key, text) the pairs (a, b) of text keys that meet by their fingerprints: each with the smallest one of its fingerprint, and those of near fingerprints."""
    prints = materialise(simhash.with_fingerprint(rows.select("key", "text"), "text", shingle).select("key", "fp").distinct(), "near-fingerprints")
    heads = materialise(prints.groupBy("fp").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")), "near-heads")
    same = by_key(prints, heads, "fp", "n").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = materialise(simhash.links(heads.select("fp"), radius), "near-balls")
    for c in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")), c)
    return same.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")))


def groups(rows: DataFrame, slim: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of rows (id, key, text) and their sketches the texts that are in groups: (node, root), both keys."""
    distinct = materialise(slim.groupBy("key").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-distinct")
    members = distinct.select("key", "n", F.explode("bands").alias("bucket"))
    met = members.groupBy("bucket").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialise(members.join(met, "bucket"), "near-members")
    sizes = distinct.select(F.col("key").alias("head"), F.col("n").alias("head_n"))
    # sets of very different sizes can't be similar enough
    could = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - F.lit(1e-6)
    first = members.filter("key <> head").select("key", "head", "n").distinct().join(sizes, "head").filter(could(F.col("n"), F.col("head_n")))
    first = first.select(F.col("head").alias("a"), F.col("key").alias("b"))
    links = verified(by_fingerprint(rows, shingle).unionByName(first), rows, distinct, shingle, least)

    found = components(links)
    now = members.join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    now = now.join(found.select(F.col("node").alias("head"), F.col("root").alias("head_root")), "head", "left")
    now = materialise(now.filter("key <> head").withColumn("open", F.col("root") != F.coalesce("head_root", "head")).select("bucket", "key", "n", "open"), "near-rooted")
    # of two texts that no link through the head joins at least one is open; the head itself has been checked
    left = now.filter("open").groupBy("bucket").agg(F.count(F.lit(1)).alias("x_size"))
    size = now.groupBy("bucket").agg(F.count(F.lit(1)).alias("y_size"), F.max("n").alias("longest")).filter("y_size > 1")
    pieces = lambda c: F.greatest(F.ceil(F.col(c) / MEMBERS), F.ceil(F.col(c) * F.col("longest") / SHINGLES)).cast("int")
    cut = materialise(left.join(size, "bucket").select("bucket", pieces("x_size").alias("xs"), pieces("y_size").alias("ys")), "near-open")
    now = now.join(cut, "bucket")
    sets = hashed(texts_of(now.select("key").distinct(), rows, distinct), shingle)
    now = materialise(now.join(materialise(sets, "near-sets"), "key"), "near-inside")
    member = F.struct("key", "n", "shingles")
    nth = lambda c: F.pmod(F.xxhash64("key"), c).cast("int")
    blocks = lambda rows, c, name: rows.groupBy("bucket", nth(c).alias(c[0])).agg(F.collect_list(member).alias(name))  # noqa: E731  (MEMBERS or so)
    x, y = blocks(now.filter("open"), "xs", "left"), blocks(now, "ys", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for k in range(got.num_rows):
                if found := ngram_join.verified(got.column("left")[k].as_py(), got.column("right")[k].as_py(), 100 * least):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    more = x.join(y, "bucket").select("left", "right").mapInArrow(run, "a long, b long")
    return components(links.unionByName(materialise(more, "near-more")))


def hashed(texts: DataFrame, shingle: int) -> DataFrame:
    """Of texts (key, text): key and shingles, hashes of the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches, "text"):
            found = [np.array([xxh64_intdigest(x, SEED) for x in shingles(t, shingle)], np.uint64).tobytes() for t in as_bytes(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "shingles"])

    return texts.select("key", "text").mapInArrow(run, "key long, shingles binary")


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: one row of each group of texts that ``least`` or more of their shingles link."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    slim = materialise(sketched(rows, shingle), "near-sketches")
    ids = materialise(slim.groupBy("key", "id").agg(F.count(F.lit(1)).alias("rows")), "near-ids")
    found = groups(rows, slim, shingle, least).select(F.col("node").alias("key"), "root")
    of = ids.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"), F.col("rows"))).alias("best")
    stay = materialise(of.groupBy("root").agg(best).select(F.col("best.id").alias("_id"), F.col("best.key").alias("_key"), F.col("best.rows").alias("_rows")), "near-kept")

    whole = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_of"), F.xxhash64(text).alias("_text"))
    # a shuffle at any size: what stays grows with the documents; by the id too, so that copies of one text are dealt out
    kept = whole.join(stay.hint("shuffle_hash"), (F.col("_text") == F.col("_key")) & F.col("_of").eqNullSafe(F.col("_id")))
    if stay.filter("_rows > 1").isEmpty():
        return kept.select("_doc.*")
    again = kept.filter("_rows > 1").groupBy("_key").agg(F.first("_doc").alias("_doc"))
    return kept.filter("_rows = 1").select("_doc.*").unionByName(again.select("_doc.*"))
