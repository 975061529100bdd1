"""Periodic runs in word sequences, found by recompression.

A run is a stretch of words with smallest period q and at least ``exponent``
times q words (and at least ``least``) that no neighbouring word extends. Of
such a stretch the grid of step (exponent - 1) * q holds a place i whose word
equals the one q places on, and how far both ways the two agree is the whole
run. So for every period the places of its grid, a harmonic number of them a
word in all, are candidates, and two longest common extensions settle each.

Extensions are answered by a run-length grammar: the sequence is rewritten in
turns by block compression (a maximal repetition of a symbol becomes one) and
pair compression (symbols are parted in two classes, and each neighbouring
pair of a first and a second class symbol becomes one), until every symbol is
there once. Equal symbols of a level stand for equal words, and what surrounds
two equal stretches differs at their borders only, so a query climbs the
levels while it agrees, one comparison each, and comes down where it differs.
All queries of a piece of the table climb together in numpy. Equal words of
different documents are different symbols, so that documents end at their own
borders and the levels are few.

Memory: pieces hold about 2 MB of text or one document, whose levels take
some 60 bytes a word.

Cases: null and empty texts, and texts of white space, have no words and no
runs; repeated rows give repeated results; an empty table gives no rows; other
columns are ignored. Ratios of length and period are compared exactly for
documents of up to 2 ** 26 words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, slices

LEAST, EXPONENT = 6, 4
#: Candidates of the grid that are looked at together.
AT_ONCE = 1 << 21
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
Change = Callable[[object, list[bytes]], list[bytes]]


@dataclass(frozen=True)
class Level:
    """A sequence of symbols and the step that made the next level of it."""

    symbols: np.ndarray
    block: bool
    up: np.ndarray  #: for each place the place of its symbol on the next level
    first: np.ndarray  #: for each place of the next level where it begins here, and the end
    opens: np.ndarray  #: whether a place begins a symbol of the next level

    def mirrored(self) -> Level:
        n, m = len(self.up), len(self.first) - 1
        first = (n - self.first)[::-1]
        opens = np.zeros(n, bool)
        opens[first[:-1]] = True
        return Level(self.symbols[::-1], self.block, (m - 1 - self.up)[::-1], first, opens)


def made(symbols: np.ndarray, opens: np.ndarray, block: bool) -> Level:
    first = np.append(np.flatnonzero(opens), len(symbols)).astype(np.int32)
    return Level(symbols, block, (np.cumsum(opens) - 1).astype(np.int32), first, opens)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    found, out = np.unique(keys, return_inverse=True)
    return out.astype(np.int32), len(found)


def recompressed(symbols: np.ndarray) -> list[Level]:
    """The levels of a sequence; the last one only says that no symbol is there twice."""
    symbols, kinds = numbered(symbols)
    levels: list[Level] = []
    while kinds < len(symbols):
        opens = np.ones(len(symbols), bool)
        opens[1:] = symbols[1:] != symbols[:-1]
        if not opens.all():
            levels.append(made(symbols, opens, True))
            first = levels[-1].first
            symbols, kinds = numbered(symbols[first[:-1]].astype(np.int64) * (len(opens) + 1) + np.diff(first))
            continue
        # two classes of symbols, drawn anew for each level, so that a quarter of all neighbours is expected to join
        drawn = (np.arange(kinds, dtype=np.uint64) + np.uint64(1 + len(levels))) * np.uint64(0x9E3779B97F4A7C15 ^ (len(levels) << 17 | 1))
        side = ((drawn ^ (drawn >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)[symbols]
        joins = max(side[:-1] & ~side[1:], ~side[:-1] & side[1:], key=np.count_nonzero)
        opens[1:] = ~joins
        levels.append(made(symbols, opens, False))
        first = levels[-1].first
        two = np.diff(first) == 2
        second = np.where(two, symbols[np.minimum(first[:-1] + 1, len(symbols) - 1)].astype(np.int64) + 1, 0)
        symbols, kinds = numbered(symbols[first[:-1]].astype(np.int64) * (kinds + 1) + second)
    n = len(symbols)
    return [*levels, Level(symbols, True, np.arange(n), np.arange(n + 1), np.ones(n, bool))]


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols agree from places i and j on (i < j); the sequence must end in a symbol of its own."""
    p, q = i.astype(np.int64), j.astype(np.int64)
    stop = np.full(len(p), len(levels) - 1)
    going = np.arange(len(p))
    for t, level in enumerate(levels[:-1]):
        if not len(going):
            break
        a, b = p[going], q[going]
        inside = ~(level.opens[a] & level.opens[b])
        same = level.symbols[a] == level.symbols[b]
        step = np.where(inside & same, np.minimum(level.first[level.up[a] + 1] - a, level.first[level.up[b] + 1] - b), 0)
        a, b = a + step, b + step
        p[going], q[going] = a, b
        on = level.opens[a] & level.opens[b]  # where the two differed, or blocks ended at different places, they are not
        stop[going[~on]] = t
        going = going[on]
        p[going], q[going] = level.up[a[on]], level.up[b[on]]
    order = np.argsort(-stop, kind="stable")
    begins = np.searchsorted(-stop[order], -np.arange(len(levels)), "right")  # queries that are on level t or above
    for t in range(len(levels) - 1, 0, -1):
        down, level = order[: begins[t]], levels[t - 1]
        if not len(down):
            continue
        a, b = level.first[p[down]].astype(np.int64), level.first[q[down]].astype(np.int64)
        same = level.symbols[a] == level.symbols[b]
        step = np.minimum(level.first[p[down] + 1] - a, level.first[q[down] + 1] - b) if level.block else 1
        p[down], q[down] = a + same * step, b + same * step
    return p - i


def grid(starts: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (place, period) of documents that begin at ``starts``: for each period every (exponent - 1) * period places."""
    periods = np.where(sizes >= least, sizes // exponent, 0)
    of = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (exponent - 1) * q
    n = -(-(sizes[of] - q) // step)
    to = np.cumsum(n)
    begin = 0
    while begin < len(q):
        end = max(begin + 1, int(np.searchsorted(to, (to[begin - 1] if begin else 0) + AT_ONCE, "right")))
        m = n[begin:end]
        nth = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(starts[of[begin:end]], m) + nth * np.repeat(step[begin:end], m), np.repeat(q[begin:end], m)
        begin = end


def runs(symbols: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """For each sequence of integers its runs, rows (start, length, period) by start and period."""
    sizes = np.array([len(s) for s in symbols], np.int64)
    none = np.zeros((0, 3), np.int64)
    if not len(sizes) or exponent < 2:
        return [none for _ in sizes]
    # symbols of different sequences differ, and a symbol of its own stands before, between and behind them
    kinds = np.array([int(s.max()) + 2 if len(s) else 1 for s in symbols], np.int64)
    base = np.cumsum(kinds) - kinds
    line = np.concatenate([x for s, b in zip(symbols, base, strict=True) for x in ([b], s + b + 1)] + [[int(kinds.sum())]]).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    found = []
    for i, q in grid(starts, sizes, least, exponent):
        # a run goes on for three words at least besides the two that are compared
        near = (line[i] == line[i + q]) & ((line[i + 1] == line[np.minimum(i + q + 1, len(line) - 1)]) | (line[i - 1] == line[i + q - 1]))
        found.append(np.stack([i[near], q[near]]))
    i, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if not len(i):
        return [none for _ in sizes]
    levels = recompressed(line)
    ahead = extensions(levels, i, i + q)
    n = len(line)
    back = extensions([x.mirrored() for x in levels], n - (i + q), n - i)  # places i + q - 1 and i - 1, mirrored
    start, end = i - back, i + q + ahead
    good = end - start >= np.maximum(least, exponent * q)
    rows = np.unique(np.stack([start[good], end[good], q[good]], axis=1), axis=0)
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows  # the smallest period of a stretch
    of = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = np.stack([rows[:, 0] - starts[of], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)[np.lexsort((rows[:, 2], rows[:, 0]))]
    return np.split(rows, np.searchsorted(np.sort(of), np.arange(1, len(sizes))))


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as integers, equal ones alike."""
    known = dict.fromkeys(words)
    known = dict(zip(known, range(len(known)), strict=True))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def without_repeats(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """Words outside of all runs, and the first period of each."""
    if not len(found):
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, change: Change | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: doc_id, n_words, runs (start, length, period by start and period) and collapsed, the words that no run repeats.

    ``change`` may give other words for an id and its words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"]]).add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [t.split() for t in as_bytes(batch.column("text")).to_pylist()]
            if change is not None:
                words = [change(k, w) for k, w in zip(batch.column("doc_id").to_pylist(), words, strict=True)]
            found = runs([numbers(w) for w in words], least, exponent)
            flat = np.concatenate(found)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), parts)
            texts = [b" ".join(without_repeats(w, f)) for w, f in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def tail_repeated(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Words of every tenth document (by crc32 of its id) with a tail that repeats; those of a null id stay."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def longest(found: Column) -> Column:
    """Of runs the one of greatest length by period, then of smallest start and period; null if there is none."""
    return F.array_min(F.transform(found, lambda r: F.struct((-r.length / r.period).alias("ratio"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))


def digests(rows: DataFrame) -> DataFrame:
    """Results of ``periodic_runs`` as numbers and digests."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    best = rows.withColumns({"best": longest(F.col("runs")), "listed": F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")})
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
