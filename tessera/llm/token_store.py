"""Token ids written as Re-Pair compressed shards, with random access.

Documents are dealt by range of their id, sorted, tokenized and cut into
shards. In a shard, frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round; a shard keeps its rules, the expansion length
of every rule and where each document's symbols start, so a document, or a
range of its ids, is decoded without the rest.

Cases: a null or empty text is the end id alone; rows that repeat a doc_id are
separate documents in the order of their lengths, then texts; null ids come first; an empty
table gives no shard; other columns are ignored.

One shard, as bytes (little-endian)::

    6 s   magic b"TRP2\\n\\0"          2 B  bits of a symbol (16 or more)
    4 B   number of documents         4 B  first nonterminal (ids are below it)
    4 B   number of rules             4 B  number of symbols
    u4[rules, 2]  the pair that each rule stands for
    u4[rules]     ids that each rule expands to
    u4[docs + 1]  first symbol of each document
    u4[docs]      ids of each document
    u2[symbols]   the lower 16 bits of the symbols
    u1[symbols / 8, rounded up]  for each higher bit, from the lowest, that bit of all symbols
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, flat, materialise, slices, small
from .repeats import BASES, Hashes

MAGIC = b"TRP2\n\0"
HEAD = struct.Struct("<6sHIIII")
#: Bits of the hash by which pairs are counted.
BIN_BITS = 20
#: Ids of a shard, about.
SHARD_IDS = 2_000_000
#: A rule takes twelve bytes and each pair it replaces saves two, so it pays from so many on.
LEAST = 7
#: What the bar for the number of a pair falls by from round to round.
DOWN = 4
#: Words whose ids a worker remembers; each takes about 40 bytes.
REMEMBERED = 1_000_000
#: Bytes of a word up to which its ids are remembered, and bytes of a text whose words are hashed at once.
LONG, PIECE = 4096, 1 << 17
#: Words that the library's model is given at once.
AT_ONCE = 16
#: What a byte is between words: 1 for a space or newline, 2 for other ASCII white space.
GAP = np.zeros(256, np.uint8)
GAP[[32, 10]] = 1
GAP[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
#: White space outside ASCII: the bytes of a character as one number, by how many there are; and the bytes it can begin with.
_WIDE = [chr(c).encode() for c in range(128, 0xD800) if chr(c).isspace()]
WIDE_SPACE = {n: np.array([int.from_bytes(w, "big") for w in _WIDE if len(w) == n]) for n in (2, 3)}
LEAD = np.zeros(256, bool)
LEAD[[w[0] for w in _WIDE]] = True
#: Marks: ASCII punctuation other than the apostrophe, before which contractions are split.
MARKS = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"))
#: A word of Latin letters, with or without marks behind it, after a space or newline.
LATIN = re.compile(f"[ \n][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[{MARKS}]*").fullmatch
#: Byte-level BPE writes the bytes that are not printable in Latin-1 as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
BYTE_CHARS = "".join(chr(b) if b in _PLAIN else chr(256 + _OTHER.index(b)) for b in range(256))
SPACE, NEWLINE = BYTE_CHARS[32], BYTE_CHARS[10]
#: The bytes of the letters above as a vocabulary writes them.
_LETTERS = "A-Za-z" + re.escape(BYTE_CHARS[0xC3] + BYTE_CHARS[0x80:0xC0])
#: A token of all these characters that reaches over the end of a word, or from letters into marks.
JOINT = re.compile(f"(?=[{_LETTERS}{MARKS}{SPACE}{NEWLINE}]+$).*(?:[{_LETTERS}][{MARKS}]|[{_LETTERS}{MARKS}][{SPACE}{NEWLINE}]|{NEWLINE}[{_LETTERS}])").match
#: Shards in a block of the two-level prefix sum.
SHARDS_IN_BLOCK = 4096


class Words:
    """Ids of words, found by 128 bits of a hash: a sorted table, and a small one of what is new."""

    def __init__(self) -> None:
        self.main = self.recent = (*np.zeros((2, 0), np.uint64), *np.zeros((2, 0), np.int64))  # both hashes, where the ids begin, how many
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def __len__(self) -> int:
        return len(self.main[0]) + len(self.recent[0])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of words (by ascending h1) begin, -1 for unknown words, and how many there are."""
        begin, n = np.full(len(h1), -1), np.zeros(len(h1), np.int64)
        for t1, t2, t_begin, t_n in (self.main, self.recent):
            if len(t1):
                at = np.minimum(np.searchsorted(t1, h1), len(t1) - 1)
                hit = np.flatnonzero((t1[at] == h1) & (t2[at] == h2))
                begin[hit], n[hit] = t_begin[at[hit]], t_n[at[hit]]
        return begin, n

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Put ids of new words (by ascending h1) into the pool, where they stay if there is room for the words; where they begin."""
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end - len(self.pool), len(self.pool) // 2), np.uint32)])
        self.pool[self.used : end] = ids
        begin = self.used + np.cumsum(n) - n
        if len(self) + len(h1) <= REMEMBERED:
            self.used = end
            self.recent = self._merged(self.recent, (h1, h2, begin, n))
            if len(self.recent[0]) > len(self.main[0]) // 4:
                self.main, self.recent = self._merged(self.main, self.recent), tuple(x[:0] for x in self.main)
        return begin

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))


class Encoder:
    """Texts to ids by a ``tokenizers`` file of a byte-level BPE, remembering the ids of words.

    In a byte-level BPE a token never reaches over a single space or newline
    between words, so texts with no other white space are put together from
    the ids of their words, which stand with the space or newline before them.
    Any other text goes through the library whole, as does one with a very
    long word, or one that holds the content of an added token of the file,
    such as <|endoftext|>, which the library finds before it looks at words.
    New words of Latin letters, with or without marks, go straight to the
    library's BPE model, several at once, if no token of the vocabulary could
    join them; other new words go through all of the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.size = self.library.get_vocab_size()
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.begins = np.zeros(self.size, bool)  # tokens with which a word begins
        self.joinable = True
        for token, nth in self.library.get_vocab(with_added_tokens=False).items():
            self.begins[nth] = token[:1] in (SPACE, NEWLINE)
            self.joinable = self.joinable and not JOINT(token)
        self.words = Words()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that the BPE model can take at once."""
        ids = array("I")
        for a in range(0, len(words), AT_ONCE):
            text = charmap_decode("".join(words[a : a + AT_ONCE]).encode(), "strict", BYTE_CHARS)[0]
            ids.extend([t.id for t in self.model.tokenize(text)])
        at = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, np.uint32)])).tolist() if ids else []
        raw = ids.tobytes()
        return (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)]))  # noqa: B905

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the space or newline before it if there is one."""
        fit = list(map(LATIN, words)) if self.joinable else [None] * len(words)
        plain = self._joined([w for w, f in zip(words, fit, strict=True) if f])
        other = iter(self._whole([w for w, f in zip(words, fit, strict=True) if not f]))
        return [next(plain) if f else next(other) for f in fit]

    def _odd(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Which texts can't be put together from words."""
        some = np.flatnonzero(np.diff(offsets))
        at = [np.flatnonzero(gap == 2), np.flatnonzero(gap[1:] & gap[:-1])]
        at += [x[gap[x] > 0] for x in (offsets[some], offsets[some + 1] - 1)]  # at either end
        gaps = np.concatenate([[0], np.flatnonzero(gap), [len(data)]])
        at.append(gaps[:-1][np.diff(gaps) > LONG])
        lead = np.flatnonzero(LEAD[data[:-1]])
        two = (data[lead].astype(np.int64) << 8) | data[lead + 1]
        three = (two << 8) | data[np.minimum(lead + 2, len(data) - 1)]
        at.append(lead[np.isin(two, WIDE_SPACE[2]) | np.isin(three, WIDE_SPACE[3])])
        raw = data.tobytes()
        for found in self.added:
            k = raw.find(found)
            while k >= 0:
                at.append([k])
                k = raw.find(found, k + 1)
        odd = np.zeros(len(offsets), bool)
        odd[np.searchsorted(offsets, np.concatenate(at).astype(np.int64), "right") - 1] = True
        return odd[:-1]

    def _put_together(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, behind each other, and how many each has."""
        mark = gap > 0
        mark[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(mark)
        end = np.append(start[1:], len(data))
        h = np.empty((2, len(start)), np.uint64)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + PIECE, "right")))
            piece = data[start[a] : end[b - 1]]
            for k in range(2):
                h[k, a:b] = Hashes(piece, BASES[k]).of(start[a:b] - start[a], end[a:b] - start[a])
            a = b
        order = np.argsort(h[0])
        h1, h2 = h[0][order], h[1][order]
        first = np.flatnonzero(np.append(True, h1[1:] != h1[:-1])[: len(order)])
        times = np.diff(np.append(first, len(order)))
        if (np.repeat(h2[first], times) != h2).any():
            raise ValueError("two words share a hash")  # 64 bits; the other 64 tell them apart
        h1, h2 = h1[first], h2[first]
        begin, n = self.words.find(h1, h2)
        new = np.flatnonzero(begin < 0)
        if len(new):
            raw = data.tobytes()
            where = order[first[new]]
            learned = self._learn([raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            n[new] = [len(x) // 4 for x in learned]
            begin[new] = self.words.add(h1[new], h2[new], np.frombuffer(b"".join(learned), np.uint32), n[new])
        nth = np.empty(len(order), np.int64)
        nth[order] = np.repeat(np.arange(len(first)), times)
        begin, n = begin[nth], n[nth]
        to = np.cumsum(n)
        ids = self.words.pool[np.repeat(begin - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
        words_before = np.searchsorted(start, offsets)
        return ids, np.diff(np.append(0, to)[words_before])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, of a binary column without nulls, as bytes of unsigned 32-bit integers."""
        data, offsets = flat(texts)
        gap = GAP[data]
        odd = self._odd(data, offsets, gap)
        out: list = [None] * len(texts)
        if odd.any():
            data, offsets = flat(texts.filter(pa.array(~odd)))
            gap = GAP[data]
        ids, n = self._put_together(data, offsets, gap)
        raw = ids.tobytes()
        to = (4 * np.cumsum(n)).tolist()
        for k, a, b in zip(np.flatnonzero(~odd).tolist(), [0, *to], to):  # noqa: B905
            out[k] = raw[a:b]
        rest = np.flatnonzero(odd).tolist()
        for k, x in zip(rest, self._whole([texts[k].as_py().decode() for k in rest]), strict=True):
            out[k] = x
        return out


def grammar(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over the ids of a shard, of which those at ``ends`` end a document: (symbols, rules, where documents end).

    Each round replaces, from left to right, all pairs of neighbours that occur
    as often as a bar says. The bar starts at the number of the most frequent
    pair and falls by ``DOWN`` each round down to ``least``, and rounds go on
    until no pair occurs so often. Pairs are counted in hashed bins first, and
    exactly where a bin is full enough. Of a pair that overlaps itself or
    others, what is left must still reach ``least``. The end id of a document
    stays a symbol of its own, so no pair reaches over it.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    symbol, bar, fresh = first, 0, 0
    while len(seq) > 1:
        if fresh:  # at the last bar only a pair with a symbol of the last round can be frequent
            new = np.flatnonzero(seq >= fresh)
            at = np.unique(np.concatenate([new - 1, new]))
            at = at[(at >= 0) & (at < len(seq) - 1)]
            shut = np.zeros(len(seq), bool)
            shut[ends] = shut[ends[ends > 0] - 1] = True
            at = at[~shut[at]]
        else:
            bins = (((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(32 - BIN_BITS)).astype(np.intp)
            bins[ends[ends < len(bins)]] = bins[ends[ends > 0] - 1] = 1 << BIN_BITS  # pairs with an end id
            counts = np.bincount(bins, minlength=(1 << BIN_BITS) + 1)
            counts[-1] = 0
            bar = max(least, bar // DOWN if bar else int(counts.max()) // 2)
            at = np.flatnonzero((counts >= bar)[bins])
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        times = np.diff(np.append(begin, len(key)))
        often = times >= bar
        nth = np.empty(len(at), np.int64)
        nth[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), times)
        pairs = key[begin[often]]
        at, nth = at[nth >= 0], nth[nth >= 0]
        head = np.ones(len(at), bool)  # of overlapping pairs every second one is taken
        head[1:] = np.diff(at) != 1
        place = np.arange(len(at))
        take = (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
        at, nth = at[take], nth[take]
        pays = np.bincount(nth, minlength=len(pairs)) >= least
        at, nth, pairs = at[pays[nth]], (np.cumsum(pays) - 1)[nth[pays[nth]]], pairs[pays]
        if len(pairs):
            seq[at] = nth.astype(np.uint32) + np.uint32(symbol)
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            seq = seq[keep]
            ends = ends - np.searchsorted(at + 1, ends)
            rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype("<u4"))
        elif bar == least and not fresh:
            break
        fresh = symbol if bar == least and len(pairs) else 0  # the last look is at all pairs again
        symbol += len(pairs)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), "<u4"), ends


def pack(parts: list[bytes], first: int) -> bytes:
    """One shard of documents given as bytes of unsigned 32-bit ids, end ids included."""
    lengths = np.array([len(x) // 4 for x in parts], "<u4")
    ids = np.frombuffer(b"".join(parts), "<u4")
    seq, rules, ends = grammar(ids, np.cumsum(lengths, dtype=np.int64) - 1, first)
    spans = np.ones(first + len(rules), "<u4")
    for i, (a, b) in enumerate(rules.tolist(), first):
        spans[i] = spans[a] + spans[b]
    starts = np.concatenate([[0], ends + 1]).astype("<u4")
    bits = max(16, (first + len(rules) - 1).bit_length())
    head = HEAD.pack(MAGIC, bits, len(parts), first, len(rules), len(seq))
    high = [np.packbits((seq >> np.uint32(k)).astype(np.uint8) & np.uint8(1)).tobytes() for k in range(16, bits)]
    return b"".join([head, rules.tobytes(), spans[first:].tobytes(), starts.tobytes(), lengths.tobytes(), seq.astype("<u2").tobytes(), *high])


class Shard:
    """A shard's bytes, opened for reading."""

    def __init__(self, blob: bytes):
        magic, bits, self.docs, self.first, rules, symbols = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, n, at)
            at += found.nbytes
            return found

        self.rules = part("<u4", 2 * rules).reshape(-1, 2)
        self.spans = part("<u4", rules)
        self.starts = part("<u4", self.docs + 1)
        self.lengths = part("<u4", self.docs)
        self.symbols = part("<u2", symbols).astype(np.uint32)
        for k in range(16, bits):
            high = np.unpackbits(part("u1", -(-symbols // 8)), count=symbols)
            self.symbols |= high.astype(np.uint32) << np.uint32(k)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol expands to, behind each other, and where each begins."""
        if self._flat is None:
            texts = []
            for a, b in self.rules.tolist():
                left, right = ([x] if x < self.first else texts[x - self.first] for x in (a, b))
                texts.append(left + right)
            flat = np.concatenate([np.arange(self.first, dtype="<u4"), np.array(list(chain.from_iterable(texts)), "<u4")])
            begins = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.spans, dtype=np.int64) - self.spans])
            self._flat = flat, begins
        return self._flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begins = self._expansions()
        spans = np.ones(self.first + len(self.spans), np.int64)
        spans[self.first :] = self.spans
        n = spans[symbols]
        to = np.cumsum(n)
        return flat[np.repeat(begins[symbols] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]

    def all(self) -> np.ndarray:
        """The ids of all documents."""
        return self._expand(self.symbols)

    def doc(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id last."""
        return self._expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def window(self, k: int, begin: int, end: int) -> np.ndarray:
        """Ids begin to end (exclusive) of the k-th document; only symbols that touch them are expanded."""
        symbols = self.symbols[self.starts[k] : self.starts[k + 1]]
        spans = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        spans[rule] = self.spans[symbols[rule] - self.first]
        to = np.cumsum(spans)
        a, b = np.searchsorted(to, begin, "right"), np.searchsorted(to, end, "left") + 1
        skipped = int(to[a - 1]) if a else 0
        return self._expand(symbols[a:b])[begin - skipped : end - skipped]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenize ``docs`` and write them as shards, in ascending order of ids.

    Returns the written table: part and nth (together the order of shards),
    doc_ids, n_ids (ids in the shard) and shard (its bytes). The table lies in
    the shared folder and is committed by Spark's writer, so tasks can be
    repeated. A task holds one shard's ids at a time.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id", F.length("text")).sortWithinPartitions("id", F.length("text"), "text")
    out = T.StructType().add("part", "integer").add("nth", "integer").add("doc_ids", T.ArrayType(id_type)).add("n_ids", "long").add("shard", "binary")
    encoders: dict[str, Encoder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessera.llm import token_store

        task, nth = TaskContext.get().partitionId(), 0
        kept = token_store.__dict__.setdefault("_encoders", encoders)
        encoder = kept.get(tokenizer) or kept.setdefault(tokenizer, Encoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        parts: list[bytes] = []
        ids: list[pa.Array] = []
        held = 0

        def shard() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([nth], pa.int32()), listed, pa.array([held], pa.int64()), pa.array([pack(parts, encoder.size)], pa.binary())],
                names=["part", "nth", "doc_ids", "n_ids", "shard"],
            )

        for batch in slices(batches, "text"):
            keys = batch.column("id")
            from_row = 0
            for i, x in enumerate(encoder.encode(as_bytes(batch.column("text")))):
                parts.append(x + end)
                held += len(x) // 4 + 1
                if held >= shard_ids:
                    ids.append(keys.slice(from_row, i + 1 - from_row))
                    from_row = i + 1
                    yield shard()
                    parts, ids, held, nth = [], [], 0, nth + 1
            if from_row < batch.num_rows:
                ids.append(keys.slice(from_row))
        if parts:
            yield shard()

    return materialise(rows.mapInArrow(run, out), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, stored_bytes (of its shard, per document)."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    sums = shards.select("part", "nth", "n_ids").withColumn("block", F.floor(F.col("part") / SHARDS_IN_BLOCK))
    inside = Window.partitionBy("block").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("block").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = sums.join(small(blocks), "block").select("part", "nth", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    out = T.StructType().add("part", "integer").add("nth", "integer").add("doc_id", id_type).add("inside", "long").add("n_tokens", "long").add("ids_crc32", "long").add("stored_bytes", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                blob = batch.column("shard")[row].as_py()
                opened = Shard(blob)
                ids = opened.all().astype("<u4")
                to = np.cumsum(opened.lengths, dtype=np.int64)
                start = to - opened.lengths
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), to.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("part")[row].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column("nth")[row].as_py(), np.int32)),
                        batch.column("doc_ids").slice(row, 1).flatten(),
                        pa.array(start),
                        pa.array(opened.lengths.astype(np.int64)),
                        pa.array(crcs, pa.int64()),
                        pa.array(np.full(n, len(blob) // n, np.int64)),
                    ],
                    names=out.names,
                )

    found = shards.select("part", "nth", "doc_ids", "shard").mapInArrow(run, out)
    return found.join(small(bases), ["part", "nth"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "stored_bytes")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as shards and return what reading them back gives, a row per document."""
    return read_shards(write_shards(docs, tokenizer, end_id))
