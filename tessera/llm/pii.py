"""Personal data: patterns first, then a linear-chain conditional random field.

The field labels words with O or with the begin and inside of a kind. Its
features are word shapes: the shape of a word in full and with runs written
once, those of its neighbours, how many digits and which marks it has. Only
words that hold a digit, ``@`` or ``+`` may carry a label other than O; all
other words are fixed to O, which cuts a text into short chains that are
decoded by Viterbi in numpy, many at a time.

It is trained from a small labelled table that is written by hand and knows
nothing of the patterns: lines with tags around personal data. Another table
may take its place; at most ``LINES`` lines of it count. What the field finds
beyond the patterns, such as a phone number without its country code, a host
without a dot, an address of the newer kind, or a number that the patterns
lose as it runs into the next, is added if it touches no base span and is
plausible: 7 to 15 digits of a phone number, a card's checksum, something on
either side of an ``@``.

Cases: a null text is empty and has no spans; with an empty labelled table
nothing is added; repeated rows get equal spans; an empty table gives no rows;
other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .pii_table import LABELLED

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *("crf_" + k for k in BASE))
#: The patterns of the contract, with starts where a match can begin.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MARKED = re.compile(r"[0-9@+]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = ("O", *(f"{p}-{k}" for k in BASE for p in "BI"))
TAG = re.compile("<(/?)(" + "|".join(BASE) + ")>")
#: Lines of the labelled table that count.
LINES = 10_000
BUCKETS = 1 << 13
STEPS, STEP, DECAY = 150, 0.3, 0.02


def luhn(digits: str) -> bool:
    total = 0
    for nth, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if nth % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in text) <= 15


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, ordered by start, then kind as listed."""
    if not MARKED.search(text):
        return []
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:  # a local part is the whole run before an @, as far as the last match allows
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if is_phone(m[0])]
    return [(s, e, BASE[k]) for s, k, e in sorted(out)]


def shape(word: str) -> str:
    """Letters as x or X, digits as d, runs written once; long shapes are cut."""
    kinds = ["d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64]]
    return "".join(c for k, c in enumerate(kinds) if not k or c != kinds[k - 1])[:16]


@dataclass
class Chain:
    """Words in a row that may be personal data: their spans, and the shapes before and after."""

    spans: list[tuple[int, int]]
    words: list[str]
    before: str
    after: str


def chains(text: str) -> list[Chain]:
    """Maximal runs of words, within a line, that hold a digit, ``@`` or ``+``."""
    out: list[Chain] = []
    start = 0
    for line in text.split("\n"):
        if MARKED.search(line):
            run: list[tuple[int, int, str]] = []
            before = last = ""
            for m in WORD.finditer(line):
                if MARKED.search(m[0]):
                    if not run:
                        before = last
                    run.append((start + m.start(), start + m.end(), m[0]))
                elif run:
                    out.append(Chain([x[:2] for x in run], [x[2] for x in run], before, m[0]))
                    run = []
                last = m[0]
            if run:
                out.append(Chain([x[:2] for x in run], [x[2] for x in run], before, ""))
        start += len(line) + 1
    return out


def bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % BUCKETS


def full_shape(word: str) -> str:
    """Letters as x or X, digits as d, one for one; long words are cut."""
    return "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:24])


def features(chain: Chain, begin: int = 0, end: int | None = None) -> list[list[int]]:
    """Weights' places for each word of a chain, or for those from ``begin`` to ``end``."""
    n = len(chain.words)
    end = n if end is None else end
    words = chain.words[begin:end]
    shapes = [shape(w) for w in words]
    a, b = max(begin - 1, 0), min(end + 1, n)
    full = [full_shape(w.rstrip(".,;:!?")) for w in chain.words[a:b]]
    sides = [shape(chain.before)[:2] and "w"] * (begin == 0) + full + [shape(chain.after)[:2] and "w"] * (end == n)
    full = full[begin - a : begin - a + len(words)]
    out = []
    for k, word in enumerate(words):
        digits = sum("0" <= c <= "9" for c in word)
        names = (
            f"s{shapes[k]}", f"f{full[k]}", f"p{sides[k]}", f"n{sides[k + 2]}", f"sn{full[k]}|{sides[k + 2]}", f"ps{sides[k]}|{full[k]}",
            f"d{min(digits, 20)}", f"a{'@' in word}{word[:1] == '+'}{word.count('.')}{min(word.count(':'), 2)}", f"l{min(len(word), 30) // 3}",
        )
        out.append([bucket(n) for n in names])
    return out


N_FEATURES = 9
#: Words of a chain up to which it is decoded beside others, and words, with those that pad, decoded together.
PIECE, CELLS = 8192, 1 << 16


@dataclass
class Field:
    """Weights of the features by label, of neighbouring labels (the last row: before the first word)."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of chains given as (chain, word, feature), padded."""
        n, longest, _ = x.shape
        score = self.emit[x].sum(2)
        best = score[:, 0] + self.move[-1]
        back = np.zeros((n, longest, len(LABELS)), np.int8)
        ends = np.where((lengths == 1)[:, None], best, 0)
        for k in range(1, longest):
            step = best[:, :, None] + self.move[:-1]
            back[:, k] = step.argmax(1)
            best = step.max(1) + score[:, k]
            ends = np.where((lengths == k + 1)[:, None], best, ends)
        out = np.zeros((n, longest), np.int8)
        at = ends.argmax(1)
        for k in range(longest - 1, -1, -1):
            here = k < lengths
            out[here, k] = at[here]
            inner = here & (k > 0)
            at = np.where(inner, back[np.arange(n), k, at], at)
        return out


    def viterbi_long(self, chain: Chain) -> np.ndarray:
        """Best labels of one chain of any length: words come in pieces, and the forward scores of one piece begin the next."""
        n = len(chain.words)
        back = np.zeros((n, len(LABELS)), np.int8)
        best = None
        for a in range(0, n, PIECE):
            score = self.emit[np.array(features(chain, a, min(a + PIECE, n)), np.int64)].sum(1)
            for k, own in enumerate(score, a):
                if best is None:
                    best = own + self.move[-1]
                    continue
                step = best[:, None] + self.move[:-1]
                back[k] = step.argmax(0)
                best = step.max(0) + own
        out = np.zeros(n, np.int8)
        at = int(best.argmax())
        for k in range(n - 1, -1, -1):
            out[k] = at
            at = back[k, at]
        return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> Field:
    """A field by gradient steps on the likelihood of labelled chains (forward-backward over all of them at once)."""
    labels = len(LABELS)
    emit, move = np.zeros((BUCKETS, labels)), np.zeros((labels + 1, labels))
    seen = [np.zeros_like(emit), np.zeros_like(move)]
    n, longest, _ = x.shape
    if not n:
        return Field(emit, move)
    inside = np.arange(longest)[None, :] < lengths[:, None]
    truth = np.zeros((n, longest, labels))
    truth[np.nonzero(inside)[0], np.nonzero(inside)[1], y[inside]] = 1
    for _ in range(STEPS):
        score = emit[x].sum(2)
        alpha, beta = np.zeros((n, longest, labels)), np.zeros((n, longest, labels))
        alpha[:, 0] = score[:, 0] + move[-1]
        for k in range(1, longest):
            new = log_sum(alpha[:, k - 1, :, None] + move[:-1], 1) + score[:, k]
            alpha[:, k] = np.where(inside[:, k, None], new, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = log_sum(move[:-1] + (score[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(inside[:, k + 1, None], new, beta[:, k + 1] * 0)
        z = log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
        diff = (truth * inside[:, :, None] - p) / n
        grad_emit, grad_move = np.zeros_like(emit), np.zeros_like(move)
        for f in range(x.shape[2]):
            np.add.at(grad_emit, x[:, :, f][inside], diff[inside])
        grad_move[-1] = diff[:, 0].sum(0)
        for k in range(1, longest):
            on = inside[:, k]
            joint = np.exp(alpha[on, k - 1, :, None] + move[:-1] + (score[on, k] + beta[on, k])[:, None, :] - z[on, None, None])
            grad_move[:-1] += (np.einsum("ni,nj->ij", truth[on, k - 1], truth[on, k]) - joint.sum(0)) / n
        for w, g, s in ((emit, grad_emit - DECAY * emit / n, seen[0]), (move, grad_move - DECAY * move / n, seen[1])):
            s += g * g
            w += STEP * g / (np.sqrt(s) + 1e-8)
    return Field(emit, move)


def padded(found: list[Chain]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c.words) for c in found], np.int64)
    x = np.zeros((len(found), int(lengths.max(initial=1)), N_FEATURES), np.int64)
    for k, c in enumerate(found):
        x[k, : lengths[k]] = features(c)
    return x, lengths


def labelled(line: str) -> list[tuple[Chain, list[int]]]:
    """Chains of a line of the labelled table with their labels."""
    text, spans, opened = "", [], 0
    at = 0
    for m in TAG.finditer(line):
        text += line[at : m.start()]
        at = m.end()
        if m[1]:
            spans.append((opened, len(text), m[2]))
        else:
            opened = len(text)
    text += line[at:]
    out = []
    for c in chains(text):
        y = []
        for a, b in c.spans:
            over = next((s for s in spans if s[0] < b and s[1] > a), None)
            y.append(0 if over is None else 1 + 2 * BASE.index(over[2]) + (a > over[0]))
        out.append((c, y))
    return out


def train(lines: Sequence[str]) -> Field:
    """The field, from lines with tags."""
    found = [x for line in lines for x in labelled(line)]
    x, lengths = padded([c for c, _ in found])
    y = np.zeros(x.shape[:2], np.int64)
    for k, (_, own) in enumerate(found):
        y[k, : len(own)] = own
    return fit(x, y, lengths)


def decode(field: Field, found: list[Chain]) -> list[np.ndarray]:
    """Labels of each chain; chains of like length go through Viterbi together, ``CELLS`` padded words at most, and one of over ``PIECE`` words alone."""
    out: list = [None] * len(found)
    order = sorted(range(len(found)), key=lambda k: len(found[k].words))
    a = 0
    while a < len(order):
        if len(found[order[a]].words) > PIECE:
            out[order[a]] = field.viterbi_long(found[order[a]])
            a += 1
            continue
        b = a + 1
        while b < len(order) and len(found[order[b]].words) <= PIECE and (b + 1 - a) * len(found[order[b]].words) <= CELLS:
            b += 1
        x, lengths = padded([found[k] for k in order[a:b]])
        for k, y, n in zip(order[a:b], field.viterbi(x, lengths), lengths, strict=True):
            out[k] = y[:n]
        a = b
    return out


#: What the field finds must be plausible.
CHECKS = {
    "email": lambda t: re.fullmatch(r"[^@\s]+@[^@\s]+", t) is not None,
    "ip": lambda t: re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", t) is not None and is_ip(t) or re.fullmatch(r"(?=.*:.*:)[0-9a-fA-F:]{3,39}", t) is not None,
    "card": lambda t: 13 <= sum("0" <= c <= "9" for c in t) <= 19 and luhn(re.sub(r"[^0-9]", "", t)),
    "phone": lambda t: 7 <= sum("0" <= c <= "9" for c in t) <= 15,
}


def added(text: str, base: list[tuple[int, int, str]], found: list[Chain], labels: list[np.ndarray]) -> list[tuple[int, int, str]]:
    """Spans that the field adds: begun and continued by labels of one kind, apart from base spans, and checked."""
    out = []
    starts = [s for s, *_ in base]
    reach = np.maximum.accumulate([e for _, e, _ in base]) if base else []
    for c, y in zip(found, labels, strict=True):
        k = 0
        while k < len(y):
            if y[k] == 0:
                k += 1
                continue
            kind, first = BASE[(y[k] - 1) // 2], k
            k += 1
            while k < len(y) and y[k] == 2 + 2 * BASE.index(kind):
                k += 1
            a, b = c.spans[first][0], c.spans[k - 1][1]
            while b > a and text[b - 1] in ".,;:!?":
                b -= 1
            nth = bisect_right(starts, b - 1)
            if (nth == 0 or reach[nth - 1] <= a) and b > a and CHECKS[kind](text[a:b]):
                out.append((a, b, "crf_" + kind))
    return out


def find(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    each = [chains(t) for t in texts]
    labels = decode(field, [c for cs in each for c in cs])
    out, at = [], 0
    for t, b, cs in zip(texts, base, each, strict=True):
        more = added(t, b, cs, labels[at : at + len(cs)])
        at += len(cs)
        out.append((b, sorted(b + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else b))
    return out


def label(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Personal data by document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; ``table`` holds labelled lines (line)."""
    lines = LABELLED if table is None else [r.line for r in table.filter("line is not null").orderBy("line").limit(LINES).collect()]
    field = docs.sparkSession.sparkContext.broadcast(train(lines))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"]])
    for k in BASE:
        schema.add(f"n_{k}", "long")
    schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = find(field.value, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in BASE]
            digests = pa.array([hashlib.sha256(label(b).encode()).hexdigest() for b, _ in found], pa.string())
            more = pa.array([len(a) - len(b) for b, a in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([label(a) for _, a in found], pa.string()), more], names=schema.names)

    return rows.mapInArrow(run, schema)
