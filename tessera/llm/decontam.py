"""Benchmark decontamination: BM25 with block-max WAND, then a check of question and answer.

A benchmark item is looked for as a whole and, if it has several sentences and
five words or more before the last one, by its question alone: the last
sentence is the answer, the rest the question. It counts as leaked if a passage
holds at least ``overlap`` of the five-word shingles of the whole item or of
its question and, where there is an answer, at least ``overlap`` of the
answer's too: a question with another answer is no leak. The overlaps of the
whole, the question and the answer in the best such passage are reported.

Passages are windows of a document whose length follows from the item's length
alone: ``2 * STRIDE`` words, or so many times two as it takes to hold the item
and a quarter more twice, starting every half of that. Items of any length are
judged as a whole.

What is looked for forms inverted indexes, one for each length of window: a
posting holds what a term adds to the BM25 score, divided by the score that
must be reached. Every passage is a query for all above the bar. Upper bounds
go first, from coarse to fine, as in WAND: the sum of the largest posting of
each term; then, for passages that could still reach the bar, the sum of the
largest postings inside each block; only blocks that could reach it have their
postings added up. The bar follows from ``overlap``: a passage that holds so
many shingles can lack at most as many words as shingles are missing, so it
scores at least the full score less the heaviest words, that many of them.
Retrieval therefore loses nothing that the check would confirm, whatever other
items are in the index.

Items are indexed in groups of ``group`` words, or one longer item, so that
what is broadcast is bounded; each group is one pass over the documents.
Shingles are compared by 64 bits of a hash.

Cases: null and empty texts and items match nothing; an item of under five
words is one shingle; repeated items are items of their own; a null id of an
item is -1; an empty benchmark or table gives no hits; other columns of
documents may have any name. Words are lower-cased, and punctuation (ASCII)
separates them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plus, slices

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Words of the items that are indexed together.
GROUP = 500_000
#: Words by which passages advance, at least.
STRIDE = 64
#: Blocks of postings, at most.
BLOCKS = 32
#: What rounding may take from a score.
SLACK = 1e-3
ASCII = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
HIT = (("item_id", "long"), ("overlap", "double"), ("question_overlap", "double"), ("answer_overlap", "double"))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode().translate(ASCII).split()


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    return (text, "") if len(parts) < 2 else (text[: text.rindex(parts[-1])], parts[-1])


def stride_of(n: int) -> int:
    """Words by which passages advance for an item of ``n`` words."""
    stride = STRIDE
    while 4 * stride < 5 * n:
        stride *= 2
    return stride


def shingles(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` word ids; of a shorter list, of all of it."""
    n = min(n, len(ids))
    if not n:
        return np.zeros(0, np.uint64)
    word = (ids + 1).astype(np.uint64)
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def share(of: np.ndarray, inside: np.ndarray) -> float:
    return len(np.intersect1d(of, inside, assume_unique=True)) / len(of) if len(of) else 0.0


@dataclass
class Item:
    """Shingles of a whole item, of its question and of its answer."""

    row: int  # of the item among those indexed
    n: int  # words of a shingle
    n_answer: int
    whole: np.ndarray
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Part:
    """An inverted index of what is looked for in windows of one length."""

    stride: int
    item: np.ndarray  # of each entry
    local: np.ndarray  # term of this part by term of the index, -1 if it has none
    starts: np.ndarray  # of postings by term
    entries: np.ndarray  # of postings, ascending within a term
    impacts: np.ndarray
    block: int  # entries of a block
    most: np.ndarray  # largest impact of a term
    block_most: np.ndarray  # largest impact by term and block


@dataclass
class Index:
    ids: list[int]
    terms: dict[bytes, int]
    items: list[Item]
    parts: list[Part]


def inverted(stride: int, entries: list[tuple[int, np.ndarray]], terms: int, overlap: float) -> Part:
    """The index of entries (item, word ids)."""
    n = len(entries)
    df = Counter(t for _, ids in entries for t in set(ids.tolist()))
    local = np.full(terms, -1, np.int32)
    local[list(df)] = np.arange(len(df))
    mean = sum(len(ids) for _, ids in entries) / n
    postings: list[list[tuple[int, float]]] = [[] for _ in df]
    for nth, (_, ids) in enumerate(entries):
        words = ids.tolist()
        scale = K1 * (1 - B + B * len(words) / mean)
        own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + scale) for w, tf in Counter(words).items()}
        times = Counter(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) > SHINGLE else Counter([tuple(words)])  # noqa: B905
        missing = math.floor((1 - overlap) * len(times) + 1e-9)
        lost = sum(c for _, c in times.most_common(missing))
        bar = sum(own.values()) - sum(sorted(own.values(), reverse=True)[:lost])
        for w, x in own.items():
            postings[local[w]].append((nth, x / max(bar, 1e-9)))
    starts = np.concatenate([[0], np.cumsum([len(p) for p in postings])])
    at = np.array([i for p in postings for i, _ in p], np.int64)
    impacts = np.array([x for p in postings for _, x in p])
    block = max(8, -(-n // BLOCKS))
    block_most = np.zeros((len(df), -(-n // block)))
    np.maximum.at(block_most, (np.repeat(np.arange(len(df)), np.diff(starts)), at // block), impacts)
    return Part(stride, np.array([i for i, _ in entries]), local, starts, at, impacts, block, block_most.max(1), block_most)


def build(items: list[tuple[int, str]], overlap: float = OVERLAP) -> Index | None:
    """The index of items (id, text); None if no item has a word."""
    terms: dict[bytes, int] = {}
    ids_of = lambda words: np.array([terms.setdefault(w, len(terms)) for w in words], np.int64)
    found: list[Item] = []
    entries: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row, (_, text) in enumerate(items):
        ids = ids_of(words_of(text))
        if not len(ids):
            continue
        question, answer = map(ids_of, map(words_of, halves(text)))
        looked_for = entries.setdefault(stride_of(len(ids)), [])
        looked_for.append((len(found), ids))
        alone = len(answer) > 0 and len(question) >= SHINGLE
        if alone:
            looked_for.append((len(found), question))
        found.append(Item(row, min(SHINGLE, len(ids)), min(SHINGLE, len(answer)), shingles(ids), shingles(question[: len(question) * alone]), shingles(answer)))
    if not found:
        return None
    return Index([i for i, _ in items], terms, found, [inverted(stride, own, len(terms), overlap) for stride, own in sorted(entries.items())])


def candidates(part: Part, ids: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int, int]]:
    """(document, passage, item) of every entry that a passage scores above its bar; ids are the words of the documents behind each other."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # passages of a document are numbered in a row; passage k holds words k * stride to (k + 2) * stride
    counts = np.maximum(1, -(-lengths // part.stride))
    first = np.cumsum(counts) - counts
    known = np.flatnonzero(ids >= 0)
    term = part.local[ids[known]].astype(np.int64)
    known, term = known[term >= 0], term[term >= 0]
    doc, step = doc[known], place[known] // part.stride
    passage = first[doc] + step
    v = len(part.most)
    codes = np.unique(np.concatenate([passage * v + term, (passage - 1)[step > 0] * v + term[step > 0]]))
    passage, term = codes // v, codes % v
    bar = 1 - SLACK
    stays = (np.bincount(passage, part.most[term], int(counts.sum())) >= bar)[passage]
    passage, term = passage[stays], term[stays]
    found: set[tuple[int, int, int]] = set()
    if not len(passage):
        return found
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    ends = np.append(starts[1:], len(passage))
    for a in range(0, len(starts), 2048):  # bounds memory
        lo, hi = starts[a], ends[min(a + 2048, len(starts)) - 1]
        bounds = np.add.reduceat(part.block_most[term[lo:hi]], starts[a : a + 2048] - lo, axis=0)
        for k, b in zip(*np.nonzero(bounds >= bar), strict=True):
            own = term[starts[a + k] : ends[a + k]]
            own = own[part.block_most[own, b] > 0]
            at = np.concatenate([np.arange(part.starts[t], part.starts[t + 1]) for t in own])
            at = at[part.entries[at] // part.block == b]
            scores = np.bincount(part.entries[at] - b * part.block, part.impacts[at])
            p = int(passage[starts[a + k]])
            d = int(np.searchsorted(first, p, "right")) - 1
            found.update((d, p - int(first[d]), int(part.item[b * part.block + x])) for x in np.flatnonzero(scores >= bar))
    return found


def hits(index: Index, texts: list[str | None], overlap: float = OVERLAP) -> list[dict[int, tuple[float, float, float]]]:
    """For each text the leaked items (rows of the index), with the overlaps of whole, question and answer."""
    docs = [words_of(t) if t else [] for t in texts]
    lengths = np.array([len(w) for w in docs], np.int64)
    get = index.terms.get
    ids = np.fromiter((get(w, -1) for words in docs for w in words), np.int64, int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    best: list[dict[int, tuple[float, float, float]]] = [{} for _ in docs]
    for part in index.parts:
        seen: dict[tuple[int, int, int], np.ndarray] = {}

        def passage(d: int, p: int, n: int, part=part, seen=seen) -> np.ndarray:
            if (d, p, n) not in seen:
                a = int(begin[d]) + p * part.stride
                window = ids[a : min(a + 2 * part.stride, int(begin[d] + lengths[d]))]
                seen[d, p, n] = shingles(window, n) if len(window) >= n > 0 else np.zeros(0, np.uint64)
            return seen[d, p, n]

        for d, p, i in sorted(candidates(part, ids, lengths)):
            item = index.items[i]
            whole, question = share(item.whole, passage(d, p, item.n)), share(item.question, passage(d, p, SHINGLE))
            if max(whole, question) < overlap:
                continue
            got = whole, question, share(item.answer, passage(d, p, item.n_answer))
            if not item.n_answer or got[2] >= overlap:
                best[d][item.row] = max(best[d].get(item.row, got), got)
    return best


def indexes(benchmark: DataFrame, overlap: float, group: int) -> Iterator[Index]:
    """Indexes of the benchmark, of items of ``group`` words each or of one longer item; the driver holds one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text"))
    held: list[tuple[int, str]] = []
    words = 0
    for row in items.filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(row.text))
        if held and words + n > group:
            yield from filter(None, [build(held, overlap)])
            held, words = [], 0
        held.append((row.item_id, row.text))
        words += n
    yield from filter(None, [build(held, overlap)])


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, group: int = GROUP) -> DataFrame:
    """Leaked items: rows (doc_id, item_id, overlap, question_overlap, answer_overlap), one per document row and item."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = plus(T.StructType([docs.schema["doc_id"]]), *HIT)
    out = None
    for index in indexes(benchmark, overlap, group):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                index = shared.value
                found = [(k, index.ids[i], *x) for k, own in enumerate(hits(index, batch.column("text").to_pylist(), overlap)) for i, x in sorted(own.items())]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])],
                    names=schema.names,
                )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, group: int = GROUP) -> DataFrame:
    """``docs`` without those that hold a benchmark item; one pass, nothing is shuffled."""
    for index in indexes(benchmark, overlap, group):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found = hits(shared.value, batch.column("text").to_pylist(), overlap)
                yield batch.filter(pa.array([not x for x in found]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
