"""Removing repeated passages by a distributed sort of suffixes.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere
else. Sorting every suffix of a corpus would move it many times over, so the
suffixes are thinned first without losing any repeat:

1. Every window of ``span`` bytes is given to the smallest hash among the
   ``gram``-byte strings inside it, its anchor. Equal windows have equal
   anchors at equal places, so windows under an anchor that occurs once in the
   corpus are unique. Neighbouring windows under one anchor form a segment.
2. Equal segments are counted before anything is sorted; a segment found twice
   is repeated as a whole, however often it occurs.
3. For anchors with several different segments, tasks sort the suffixes that
   start at the anchor and send sorted runs, front-coded (what a suffix shares
   with the one before it is not sent), to the anchor's bucket. There a loser
   tree merges the runs: it knows how much each head shares with the last
   output and compares bytes only beyond that. The lengths of common prefixes
   that come out, and those of the texts before the anchors, tell for each
   place of a window which segments agree on it.
4. An anchor with more than ``hot`` different segments is never gathered:
   each of its windows becomes a row, and rows are counted by their hashes.

Copies of whole texts are counted before all else. A text that a thousandth
of all rows or more are copies of is cut once, with its number of copies, and
its rows, all of which are repeated from end to end, never meet in one task;
there are a thousand such texts at most, whatever the size of the corpus.

Matches never cross documents. Texts are known by 96 bits of hashes, segments
and windows by 128.

Cases: a null text is empty; texts under ``span`` bytes keep all; repeated rows
are occurrences of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, dealt, materialise, slices

SPAN, GRAM = 400, 100
#: Different segments of an anchor up to which they are sorted together.
HOT = 4000
#: Suffixes of a merge bucket, about.
BUCKET = 4000
#: A text counts as frequent if this number times its copies is all rows or more.
OFTEN = 1000
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 to the 64th."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 15)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(out)
    return have


class Hashes:
    """Hashes of any part of a text, from prefix sums."""

    def __init__(self, text: bytes, base: int):
        b = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
        up, self.down = powers(base, len(b) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)], dtype=np.uint64)])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    n = len(keys) - width + 1
    rows = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    rows[: len(keys)] = keys
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, span: int = SPAN, gram: int = GRAM, full: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor, h1, h2, start, windows, offset of the anchor in the segment) of a text's segments; only anchors unless ``full``."""
    parts = []
    for begin in range(0, max(1, len(text) - span + 1), PIECE):
        piece = text[begin : begin + PIECE + span - 1]
        if len(piece) < span:
            continue
        one = Hashes(piece, BASES[0])
        grams = one.of(slice(0, len(piece) - gram + 1), slice(gram, len(piece) + 1))
        keys = (grams & ~np.uint64((1 << 23) - 1)) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_least(keys, span - gram + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        anchor = grams[at[start]]
        if not full:
            parts.append((anchor,))
            continue
        count = np.diff(np.append(start, len(at)))
        end = start + count - 1 + span
        offset = at[start] - start
        salt = offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + count.astype(np.uint64)
        two = Hashes(piece, BASES[1])
        parts.append((anchor, one.of(start, end) + salt, two.of(start, end) + salt, start + begin, count, offset))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ()


SEGMENT = (("anchor", "long"), ("h1", "long"), ("h2", "long"), ("start", "integer"), ("count", "integer"), ("offset", "integer"))


def cut(rows: DataFrame, full: bool, span: int, gram: int) -> DataFrame:
    """Segments of rows (t1, t2, text, n): (t1, t2) naming the text, those of ``segments``, and n copies; or anchors and n alone."""
    fields = SEGMENT if full else SEGMENT[:1]
    schema = T.StructType()
    if full:
        schema.add("t1", "long").add("t2", "integer")
    for name, kind in (*fields, ("n", "long")):
        schema.add(name, kind)
    types = {"long": np.int64, "integer": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, nth = [], []
            for k, text in enumerate(as_bytes(batch.column("text")).to_pylist()):
                own = segments(text, span, gram, full)
                if own:
                    found.append(own)
                    nth.append(np.full(len(own[0]), k))
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            at = pa.array(np.concatenate(nth))
            arrays = [batch.column(n).take(at) for n in (("t1", "t2") if full else ())]
            arrays += [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(types[kind])) for c, (_, kind) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("n").take(at)], names=schema.names)

    return rows.mapInArrow(run, schema)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes what each shares with the one before it, and the rest."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        n = common(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merge front-coded runs by a loser tree: (run, place in it, suffix, length of the prefix shared with the last).

    Each head carries how much it shares with the last output. The head that
    shares more is smaller and nothing is compared; only between heads that
    share equally much are bytes compared, and only beyond that length.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    place = [0] * len(runs)
    head: list[bytes | None] = [None] * k
    share = [0] * k
    for r, (_, rest) in enumerate(runs):
        if rest:
            head[r] = rest[0]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes the one with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = common(x, y, share[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    winner = build(1) if k > 1 else 0
    while head[winner] is not None:
        out = head[winner]
        yield winner, place[winner], out, share[winner]
        shared, rest = runs[winner]
        place[winner] += 1
        if place[winner] < len(rest):
            n = shared[place[winner]]
            head[winner], share[winner] = out[:n] + rest[place[winner]], n
        else:
            head[winner] = None
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def agreeing(right_share: np.ndarray, left: list[bytes], least: np.ndarray, most: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in sorted order the smallest and largest offset of a window that another segment has too (-1: none).

    ``right_share`` is what each shares with the one before it; ``left`` the
    text before each anchor, backwards; windows of a segment have offsets
    ``least`` to ``most``. A window at offset o agrees if ``o`` bytes to the
    left and ``span - o`` to the right do.
    """
    m = len(left)
    order = sorted(range(m), key=left.__getitem__)
    left_share = np.zeros(m, np.int64)
    for a, b, k in zip(order, order[1:], range(1, m), strict=False):
        left_share[k] = common(left[a], left[b])
    where = np.array(order, np.int64)
    first, last = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    for o in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        mine = np.flatnonzero((least <= o) & (o <= most))
        if len(mine) < 2:
            continue
        right = np.cumsum(right_share < span - o)
        lefts = np.empty(m, np.int64)
        lefts[where] = np.cumsum(left_share < o)
        key = right[mine] * (m + 1) + lefts[mine]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = mine[times[inverse] > 1]
        first[hit[first[hit] < 0]] = o
        last[hit] = o
    return first, last


RUN = T.StructType().add("bucket", "long").add("t1", T.ArrayType(T.LongType())).add("t2", T.ArrayType(T.IntegerType())).add("anchor", T.ArrayType(T.LongType()))
RUN.add("at", T.ArrayType(T.IntegerType())).add("least", T.ArrayType(T.IntegerType())).add("most", T.ArrayType(T.IntegerType()))
RUN.add("shared", T.ArrayType(T.IntegerType())).add("rest", T.ArrayType(T.BinaryType())).add("left", T.ArrayType(T.BinaryType()))
COVER = "t1 long, t2 int, lo int, hi int"
#: Segments whose suffixes are sorted into one run.
RUN_ROWS = 50_000


def sorted_runs(batches: Iterator[pa.RecordBatch], span: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of texts with their wanted segments, sorted and front-coded runs of suffixes by bucket."""
    held: dict[int, list[tuple]] = {}
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for bucket, found in held.items():
            found.sort()
            shared, rest = front_coded([x[0] for x in found])
            cols = list(zip(*found, strict=True))
            rows.append({"bucket": bucket, "t1": cols[3], "t2": cols[4], "anchor": cols[2], "at": cols[5], "least": cols[6], "most": cols[7], "shared": shared, "rest": rest, "left": cols[1]})
        if rows:
            types = {"bucket": pa.int64(), "t1": pa.list_(pa.int64()), "anchor": pa.list_(pa.int64()), "rest": pa.list_(pa.binary()), "left": pa.list_(pa.binary())}
            yield pa.RecordBatch.from_arrays([pa.array([list(r[n]) if n != "bucket" else r[n] for r in rows], types.get(n, pa.list_(pa.int32()))) for n in RUN.names], names=RUN.names)

    for batch in batches:
        texts = as_bytes(batch.column("text")).to_pylist()
        for text, t1, t2, wanted in zip(texts, *(batch.column(n).to_pylist() for n in ("t1", "t2", "wanted")), strict=True):
            for w in wanted:
                at, end = w["start"] + w["offset"], w["start"] + w["count"] - 1 + span
                least = w["offset"] - w["count"] + 1
                held.setdefault(w["anchor"] % buckets, []).append((text[at:end], text[w["start"] : at][::-1], w["anchor"], t1, t2, at, least, w["offset"]))
                count += 1
            if count >= RUN_ROWS:
                yield from flush()
                held, count = {}, 0
    yield from flush()


def merged(pdf: pd.DataFrame, span: int) -> pd.DataFrame:
    """Covered ranges of the texts whose runs meet in a bucket."""
    runs = list(zip(pdf["shared"], pdf["rest"], strict=True))
    runs = [(list(s), list(r)) for s, r in runs]
    out = list(merge(runs))
    if not out:
        return pd.DataFrame({"t1": [], "t2": [], "lo": [], "hi": []}).astype({"t1": "int64", "t2": "int32", "lo": "int32", "hi": "int32"})
    base = np.concatenate([[0], np.cumsum([len(r) for _, r in runs])])
    place = np.array([base[r] + k for r, k, *_ in out])
    all_of = lambda name: [x for row in pdf[name] for x in row]
    get = lambda name, kind: np.array(all_of(name), kind)[place]
    lefts = all_of("left")
    t1, t2, at, least, most = get("t1", np.int64), get("t2", np.int64), get("at", np.int64), get("least", np.int64), get("most", np.int64)
    # copies of a text bring the same segment: one of them stands for all
    _, keep = np.unique(np.stack([t1, t2, at, least]), axis=1, return_index=True)
    keep = np.sort(keep)
    share = np.array([x[3] for x in out], np.int64)
    share = np.minimum.reduceat(share, np.concatenate([[0], keep[:-1] + 1])) if len(keep) < len(share) else share
    first, last = agreeing(share, [lefts[place[k]] for k in keep], least[keep], most[keep], span)
    hit = np.flatnonzero(last >= 0)
    own = keep[hit]
    lo, hi = at[own] - last[hit], at[own] - first[hit] + span
    return pd.DataFrame({"t1": t1[own], "t2": t2[own].astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})


def single_windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Every window of wanted segments, with its hashes."""
    for batch in batches:
        texts = as_bytes(batch.column("text")).to_pylist()
        for text, t1, t2, wanted in zip(texts, *(batch.column(n).to_pylist() for n in ("t1", "t2", "wanted")), strict=True):
            for w in wanted:
                part = text[w["start"] : w["start"] + w["count"] - 1 + span]
                places = np.arange(w["count"])
                one, two = (Hashes(part, b).of(places, places + span).view(np.int64) for b in BASES)
                n = w["count"]
                columns = [np.full(n, t1), np.full(n, t2, np.int32), (places + w["start"]).astype(np.int32), one, two]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t1", "t2", "start", "h1", "h2"])


def wanted_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (t1, t2, text, wanted) for each text with wanted segments, however many copies of it there are."""
    both = rows.join(wanted.filter(F.size("wanted") > 0), ["t1", "t2"])
    return both.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))  # where the join has put them


def covered(rows: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Ranges of texts (t1, t2, text, n: copies that the row stands for) that are covered by repeated strings: rows (t1, t2, lo, hi), overlapping ones included."""
    count = F.count(F.lit(1)).alias("rows")
    anchors = cut(rows, False, span, gram).groupBy("anchor").agg(F.sum("n").alias("n"), count).filter("n > 1").select("anchor", "rows")
    anchors = materialise(anchors, "anchors")
    found = materialise(dealt(cut(rows, True, span, gram), anchors, ["anchor"], "rows", "left_semi"), "segments")
    key = ["anchor", "h1", "h2"]
    one = F.min(F.struct("t1", "t2", "start", "count", "offset")).alias("one")
    distinct = materialise(found.groupBy(*key).agg(F.sum("n").alias("n"), count, one), "distinct-segments")
    repeated = distinct.filter("n > 1").select(*key, "rows")
    whole = dealt(found, repeated, key, "rows", "left_semi").select("t1", "t2", F.col("start").alias("lo"), (F.col("start") + F.col("count") - 1 + span).cast("int").alias("hi")).distinct()
    several = materialise(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "anchors")
    wanted = dealt(distinct, several, ["anchor"], "kinds").select("anchor", "kinds", "one.*")
    wanted = materialise(wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "kinds", "start", "count", "offset")).alias("all")), "wanted")
    buckets = int(several.agg(F.coalesce(F.sum(F.when(F.col("kinds") <= hot, F.col("kinds"))), F.lit(0))).first()[0]) // BUCKET + 1

    few, many = F.filter("all", lambda x: x.kinds <= hot), F.filter("all", lambda x: x.kinds > hot)
    texts = wanted_texts(rows, wanted.select("t1", "t2", few.alias("wanted")))
    runs = texts.mapInArrow(partial(sorted_runs, span=span, buckets=buckets), RUN)
    agreed = runs.groupBy("bucket").applyInPandas(partial(merged, span=span), COVER)
    out = whole.unionByName(agreed)

    if not several.filter(F.col("kinds") > hot).isEmpty():
        texts = wanted_texts(rows, wanted.select("t1", "t2", many.alias("wanted")))
        windows = materialise(texts.mapInArrow(partial(single_windows, span=span), "t1 long, t2 int, start int, h1 long, h2 long").distinct(), "windows")
        twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
        out = out.unionByName(windows.join(twice, ["h1", "h2"], "left_semi").select("t1", "t2", F.col("start").alias("lo"), (F.col("start") + span).cast("int").alias("hi")))
    return materialise(out, "covered")


def joined(ranges: list[dict], size: int) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one."""
    out: list[list[int]] = []
    for r in sorted((r["lo"], min(r["hi"], size)) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def with_ranges(docs: DataFrame, span: int, gram: int, hot: int = HOT) -> DataFrame:
    """Texts (doc_id, text) with their covered ranges."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})
    long = F.octet_length("text") >= span
    copies = materialise(rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(copies.filter((F.col("n") > 1) & (F.col("n") * OFTEN >= total)))  # OFTEN rows at most
    once = rows.filter(long).join(often, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    once = materialise(once, "often")
    seldom = rows.join(often, ["t1", "t2"], "left_anti")
    cut_rows = seldom.filter(long).select("t1", "t2", "text", F.lit(1).cast("long").alias("n")).unionByName(once)
    ranges = covered(cut_rows, span, gram, hot).groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    found = seldom.join(ranges, ["t1", "t2"], "left").select("doc_id", "text", "ranges")
    every = F.when(long, F.array(F.struct(F.lit(0).alias("lo"), F.octet_length("text").alias("hi"))))
    return found.unionByName(rows.join(often, ["t1", "t2"], "left_semi").select("doc_id", "text", every.alias("ranges")))


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """What is left of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for text, ranges in zip(as_bytes(batch.column("text")).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                spans = joined(ranges or [], len(text))
                edges = [0, *(x for s in spans for x in s), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(out, (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=schema.names)

    return with_ranges(docs, span, gram, hot).mapInArrow(run, schema)
