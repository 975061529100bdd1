"""N-gram Jaccard join: documents whose sets of word shingles are alike enough, by a grouped prefix join.

Every distinct set is ordered by how many sets have a shingle, the rarest
first. Two sets that reach the similarity have one of their first shingles in
common (the prefix), so only prefixes are looked up. Shingles that one set
alone has come first and never match; what is left of a prefix decides.
Sets of the same size with the same prefix are one group, and groups, not
sets, meet on the shingles of their prefixes, filtered by size and by how much
can still agree behind the place where they meet. Only pairs of groups that
pass are expanded: their members are verified on whole sets. Groups are first
verified against the head of each shingle, the group that has it earliest;
after that only groups which no link connects yet are paired, so a family of
near copies costs links in proportion to its members.

The counts travel packed: a task sorts the hashed shingles of some documents
and sends each range of them on as one binary value, delta by delta in planes
of bytes, so a shingle takes some seven bytes. A range is counted by one task
and its shingles that several sets have go back to their sets, again packed.
Sets whose prefix is all their own end there.

Skew: equal sets count once, however many rows have them; a shingle that many
groups have in their prefix is dealt over several tasks; a large group is cut
into blocks and its pairs of blocks are verified apart, each giving no more
links than it has members. Shingles are known by 64 bits of a hash and sets by
128, so two different shingles of a pair count as one with a chance of 2 ** -64.
A set's key travels to each range that holds a shingle of it, so with many
ranges a shingle takes up to 16 bytes more.

Cases: null and empty texts, and texts of white space, have no shingles and
are linked with nothing; a text shorter than a shingle is one shingle; repeated
rows are linked as any equal texts; null ids are never the smallest; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_key, components, materialise, slices
from .simhash import LOWER, SEED

SHINGLE, PERCENT = 3, 90
#: Members and shingles of a block of a group, and groups of a shingle that one task compares with all others.
MEMBERS, SHINGLES, LISTED = 512, 1 << 20, 2000
#: Bytes of text that are packed together.
PIECE = 4 << 20
TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
PACKED = "part int, keys binary, sizes binary, counts binary, shingles binary, extra binary"
SETS = "key binary, n int, own int, prefix array<long>, shingles binary, grp binary"


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the hashes of its shingles, sorted, each once."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = text.translate(LOWER).split()
        if len(words) < size:
            out.append(np.array([xxh64_intdigest(b" ".join(words), SEED + 1)] if words else [], np.uint64))
            continue
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w, SEED)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - size + 1
        found = np.zeros(n, np.uint64)
        for k in range(size):
            found = (found ^ (one[k : k + n] * TIMES[k % len(TIMES)])) * TIMES[(k + 1) % len(TIMES)]
            found ^= found >> np.uint64(29)
        out.append(np.unique(found))
        if len(known) > 1 << 18:
            known.clear()
    return out


def key_of(found: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(found.tobytes(), SEED)


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, all lowest bytes first: high bytes that are zero shrink to nothing."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


def range_of(values: np.ndarray, parts: int) -> np.ndarray:
    """The range, one of ``parts``, that 64-bit hashes fall in."""
    return ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=names)


def by_shingle(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Shingles of documents (text), packed by their range: keys and sizes of the sets, and each shingle with its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            found = {key_of(s): s for s in sets_of(as_bytes(piece.column("text")).to_pylist(), size) if len(s)}
            if not found:
                continue
            keys, sizes = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16), np.array([len(s) for s in found.values()], np.uint32)
            values = np.concatenate(list(found.values()))
            order = np.argsort(values, kind="stable")
            values, of = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            cuts = np.searchsorted(range_of(values, parts), np.arange(parts + 1))
            rows = []
            for part in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[part], cuts[part + 1]
                there, nth = np.unique(of[a:b], return_inverse=True)
                steps = np.diff(values[a:b], prepend=np.uint64(0))
                rows.append((int(part), keys[there].tobytes(), planes(sizes[there]), b"", planes(steps), planes(nth.astype(np.uint32))))
            yield batch(rows)

    return docs.select("text").mapInArrow(run, PACKED)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-byte keys (rows of bytes) sorted, each once, as where they are found, and the number of each."""
    high, low = keys[:, :8].copy().view(">u8").reshape(-1), keys[:, 8:].copy().view(">u8").reshape(-1)
    order = np.lexsort((low, high))
    new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[tuple]] | None:
    """All that a task received: keys and sizes, and for each row (counts, shingles, extra, where its keys begin)."""
    keys, sizes, rows, begin = [], [], [], 0
    for b in batches:
        for row in b.to_pylist():
            keys.append(np.frombuffer(row["keys"], np.uint8).reshape(-1, 16))
            sizes.append(unplaned(row["sizes"], np.uint32))
            rows.append((row["counts"], row["shingles"], row["extra"], begin))
            begin += len(keys[-1])
    return (np.concatenate(keys), np.concatenate(sizes), rows) if keys else None


def by_set(packed: DataFrame, parts: int) -> DataFrame:
    """Shingles that two sets or more have, with their number, packed by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpacked(batches)
        if got is None:
            return
        keys, sizes, rows = got
        at, number = numbered(keys)
        values = np.concatenate([np.cumsum(unplaned(r[1], np.uint64), dtype=np.uint64) for r in rows])
        of = number[np.concatenate([unplaned(r[2], np.uint32).astype(np.int64) + r[3] for r in rows])]
        order = np.lexsort((of, values))
        values, of = values[order], of[order]
        new = np.append(True, (values[1:] != values[:-1]) | (of[1:] != of[:-1]))  # copies in other pieces count once
        values, of = values[new], of[new]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        n = np.diff(np.append(first, len(values)))
        n = np.repeat(n, n)
        values, of, n = values[n > 1], of[n > 1], n[n > 1].astype(np.uint32)
        if not len(of):
            return
        part = range_of(keys[at, :8].copy().view(">u8").reshape(-1).astype(np.uint64), parts)[of]  # grows with the number of a set
        order = np.argsort(of, kind="stable")
        values, of, n, part = values[order], of[order], n[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            there, counts = np.unique(of[a:b], return_counts=True)
            out.append((int(p), keys[at[there]].tobytes(), planes(sizes[at[there]]), planes(counts.astype(np.uint32)), planes(values[a:b]), planes(n[a:b])))
        yield batch(out)

    return packed.repartition(parts, "part").mapInArrow(run, PACKED)


def prefixed(packed: DataFrame, parts: int, percent: int) -> DataFrame:
    """Sets whose prefix holds a shingle that others have, by ``SETS``: own shingles, the rest of the prefix, shared shingles by rarity, and the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        got = unpacked(batches)
        if got is None:
            return
        keys, sizes, rows = got
        at, number = numbered(keys)
        of = np.concatenate([np.repeat(number[r[3] : r[3] + len(c)], c) for r in rows for c in [unplaned(r[0], np.uint32)]])
        values = np.concatenate([unplaned(r[1], np.uint64) for r in rows])
        order = np.lexsort((values, np.concatenate([unplaned(r[2], np.uint32) for r in rows]), of))
        values, of = values[order], of[order]
        cuts = np.searchsorted(of, np.arange(len(at) + 1))
        n = sizes[at].astype(np.int64)
        own = n - np.diff(cuts)
        length = n - (percent * n + 99) // 100 + 1
        out = []
        for k in np.flatnonzero(own < length):
            shared = values[cuts[k] : cuts[k + 1]]
            prefix = shared[: length[k] - own[k]]
            group = xxh3_128_digest(np.append(prefix, np.array([n[k], own[k]], np.uint64)).tobytes(), SEED)
            out.append((keys[at[k]].tobytes(), int(n[k]), int(own[k]), prefix.view(np.int64).tolist(), shared.tobytes(), group))
        if out:
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["key", "n", "own", "prefix", "shingles", "grp"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return packed.repartition(parts, "part").mapInArrow(run, SETS)


def met_in(groups: DataFrame, percent: int) -> DataFrame:
    """A row (shingle, class, grp, n, at) for each shingle of a group's prefix on which it can meet another one."""
    rows = groups.select("grp", "n", F.posexplode("prefix").alias("nth", "shingle"), "own").withColumn("at", F.col("own") + F.col("nth")).drop("own", "nth")
    # sizes that can reach the similarity are in the same class or in neighbouring ones
    rows = rows.withColumn("class", F.floor(F.log("n") / (math.log(100 / percent) * 1.001)) if percent < 100 else F.col("n").cast("long"))
    near = rows.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    near = near.withColumn("class", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1))).groupBy("shingle", "class").agg(F.sum("m").alias("m"), F.min("least").alias("least"))
    # the smallest that a group meets there asks least of it
    enough = (F.col("n") - F.col("at")) * (100 + percent) >= (F.col("n") + F.col("least")) * percent
    return materialise(rows.join(near.filter("m > 1"), ["shingle", "class"]).filter(enough).select("shingle", "class", "grp", "n", "at"), "prefixes")


def agreeing(percent: int) -> Column:
    """Whether groups (a, an, a_at) and (b, bn, b_at) can agree enough from the place where they meet."""
    most = F.least(F.col("an") - F.col("a_at"), F.col("bn") - F.col("b_at"))
    return most * (100 + percent) >= (F.col("an") + F.col("bn")) * percent


def as_side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("shingle", "class", F.col("grp").alias(side), F.col("n").alias(f"{side}n"), F.col("at").alias(f"{side}_at"), *more)


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def head_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (a, b) that meet and can hold similar sets, b being the group that has the shingle earliest in its class of sizes: no more than two a row."""
    heads = rows.groupBy("shingle", "class").agg(F.min(F.struct("at", "grp", "n")).alias("h")).select("shingle", "class", "h.*")
    heads = as_side(heads.withColumn("class", F.explode(F.array("class", F.col("class") + 1))), "b")
    return pairs_of(as_side(rows, "a").join(heads, ["shingle", "class"]).filter(F.col("a") != F.col("b")).filter(agreeing(percent)))


def other_pairs(rows: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (a, b) that meet, can hold similar sets and aren't connected by ``roots`` (grp, root).

    Of the groups that meet on a shingle those under its most frequent root are
    compared with the others alone, so the pairs grow with what is not yet
    connected, not with the square of all that meet.
    """
    rows = rows.join(roots, "grp")
    by_root = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    by_root = by_root.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    by_root = by_root.select("shingle", F.col("most.root").alias("most"), F.ceil((F.col("m") - F.col("most.n")) / LISTED).cast("int").alias("ways"))
    rows = materialise(rows.join(by_root, "shingle").withColumn("main", F.col("root") == F.col("most")).drop("most"), "apart")
    way = F.pmod(F.xxhash64("grp"), "ways").cast("int").alias("way")
    x = as_side(rows.filter("not main"), "a", F.col("root").alias("a_root"), F.col("class").alias("a_class"), way)
    own, below, above = F.col("class"), F.col("class") - 1, F.col("class") + 1
    y = rows.withColumn("b_class", own).withColumn("class", F.explode(F.when(F.col("main"), F.array(below, own, above)).otherwise(F.array(own, above))))
    y = as_side(y.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))), "b", F.col("root").alias("b_root"), "b_class", "main", "way")
    once = F.col("main") | (F.col("a_class") != F.col("b_class")) | (F.col("a") < F.col("b"))
    return pairs_of(x.join(y, ["shingle", "class", "way"]).filter(F.col("a_root") != F.col("b_root")).filter(once).filter(agreeing(percent)))


def verified(xs: list[dict], ys: list[dict] | None, percent: float) -> list[tuple]:
    """Links (pairs of keys) among sets, or between two lists of them, that connect all that are similar enough: of links that close a circle one is left out."""
    other = xs if ys is None else ys
    root: dict = {}

    def find(k):
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    cat = np.concatenate([np.frombuffer(s["shingles"], np.uint64) for s in other])
    lengths = np.array([len(s["shingles"]) // 8 for s in other])
    begins = np.cumsum(lengths) - lengths
    sizes = np.array([s["n"] for s in other], np.int64)
    out = []
    for nth, s in enumerate(xs):
        own = np.sort(np.frombuffer(s["shingles"], np.uint64))
        skip = nth + 1 if ys is None else 0
        if skip >= len(other):
            continue
        rest = cat[begins[skip] :]
        hits = own[np.minimum(np.searchsorted(own, rest), len(own) - 1)] == rest
        both = np.add.reduceat(hits, begins[skip:] - begins[skip], dtype=np.int64)
        for k in np.flatnonzero(100 * both >= percent * (s["n"] + sizes[skip:] - both)) + skip:
            a, b = find(s["key"]), find(other[k]["key"])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((s["key"], other[k]["key"]))
    return out


def verified_pairs(pairs: DataFrame, bundles: DataFrame, count: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between keys of the members of ``pairs`` of groups, block by block; ``bundles`` are the members and ``count`` the number of blocks of each group."""
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    both = pairs.join(count.select(F.col("grp").alias("a"), F.col("blocks").alias("a_blocks")), "a").join(count.select(F.col("grp").alias("b"), F.col("blocks").alias("b_blocks")), "b")
    both = both.withColumn("i", numbers("a_blocks")).withColumn("j", numbers("b_blocks")).filter("a <> b or i <= j").select("a", "i", "b", "j")
    same = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    both = both.join(bundles.select(F.col("grp").alias("a"), F.col("block").alias("i"), F.col("members").alias("x")), ["a", "i"])
    both = both.join(bundles.select(F.col("grp").alias("b"), F.col("block").alias("j"), F.col("members").alias("y")), ["b", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for k in range(got.num_rows):
                row = {c: got.column(c)[k].as_py() for c in ("x", "y")}
                if found := verified(row["x"], row["y"], percent):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])

    return materialise(both.select("x", F.when(~same, F.col("y")).alias("y")).mapInArrow(run, "a binary, b binary"), "join-links")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between keys of ``sets`` that connect all pairs at the similarity.

    Groups are first verified against the heads of their shingles and within
    themselves. What that connects needs no more links, so only pairs of groups
    that are still apart are verified after it.
    """
    some = F.first(F.struct("n", "own", "prefix")).alias("s")
    groups = materialise(sets.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), some).select("grp", "members", "s.*"), "join-groups")
    rows = met_in(groups, percent)
    blocks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("members") * F.col("n") / SHINGLES)).cast("int").alias("blocks")
    several = groups.filter("members > 1")
    there = rows.select("grp").unionByName(several.select("grp")).distinct()
    count = materialise(groups.join(there, "grp", "left_semi").select("grp", blocks), "join-blocks")
    block = F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block")
    bundles = sets.join(count, "grp").groupBy("grp", block).agg(F.collect_list(F.struct("key", "n", "shingles")).alias("members"))  # a block holds MEMBERS or so
    bundles = materialise(bundles, "join-members")

    first = materialise(head_pairs(rows, percent).unionByName(several.select(F.col("grp").alias("a"), F.col("grp").alias("b"))), "join-pairs")
    found = verified_pairs(first, bundles, count, percent)
    # a group has a root if all its members have it; others are apart from all
    keys = sets.select("key", "grp").join(components(found).select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    roots = keys.groupBy("grp").agg(F.min("root").alias("root"), F.max("root").alias("last")).select("grp", F.when(F.col("root") == F.col("last"), F.col("root")).otherwise(F.col("grp")).alias("root"))
    rest = materialise(other_pairs(rows, roots, percent).join(first, ["a", "b"], "left_anti"), "join-pairs")
    return found.unionByName(verified_pairs(rest, bundles, count, percent))


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: doc_id, n_shingles and component_id, the smallest id that links of similar sets reach."""
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            found = sets_of(as_bytes(piece.column("text")).to_pylist(), shingle)
            columns = [piece.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([key_of(s) if len(s) else None for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = materialise(rows.mapInArrow(sized, f"doc_id {kind}, n_shingles long, key binary"), "join-ids")
    sets = materialise(prefixed(by_set(by_shingle(rows, shingle, parts), parts), parts, percent), "join-sets")
    found = components(links(sets, percent))
    keyed = ids.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"))
    named = keyed.join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = materialise(named, "join-named")
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = materialise(named.join(smallest, "root").select("key", "rows", "component_id"), "join-components")
    out = by_key(ids.filter("key is not null"), known, "key", "rows").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(ids.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
