"""Spelling variants: words that one edit parts, and the form that each variant stands for.

The vocabulary is taken as an acceptor, a minimised automaton, and composed
with a transducer of exactly one edit and with itself again: a state of the
composition is a pair of states of the acceptor and whether the edit is spent.
Before the edit both sides have read the same, so the pair is one state; after
it the two must accept the same rest. Accepted pairs are enumerated from the
initial states that a shared beginning of ``EDGE`` code points leads to, each
by one task; pairs that differ before have their end in common and are found
by the acceptor of the reversed words in the same way. So every pair is found
in exactly one place.

An initial state with more than ``MOST`` words is divided: the pairs that
spend the edit at its next ``STEP`` code points are joined by what the edit
leaves, of which no more words can meet than there are letters, and the others
start from states that lie ``STEP`` code points further on. This goes on until
every initial state is small enough, so no beginning makes a task large.

Each variant points to its most frequent neighbour if that has ``RATIO`` times
its occurrences; roots follow these pointers by pointer jumping.

Cases: null and empty texts have no words; a null id counts as an empty one
where runs are altered; repeated rows count as often as they are there; words
that tie are ordered by code point; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Letters of a word, as a class of a pattern.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST, OFTEN, RATIO = 7, 2, 10
#: Code points of the beginning that makes an initial state, words up to which one task takes it, and code points by which larger ones go on.
EDGE, MOST, STEP = 3, 20_000, 4
#: Words that a task is given on average.
SHARE = 8_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "a string, a_n long, b string, b_n long"


def thinned(doc_id: Column, word: Column, every: int = 31) -> Column:
    """The word, or if ``every`` divides the crc32 of ``<doc_id>:<word>`` the word without the code point that it names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    k = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.length(word)))
    return F.when(h % every == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of ``least`` code points or more, A-Z lower-cased, that occur ``often`` times; counts are added before the shuffle."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    word = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    rows = rows.select("id", word.alias("word"))
    if every is not None:
        rows = rows.select(thinned(F.col("id"), F.col("word"), every).alias("word")).filter(F.length("word") >= least)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


class Acceptor:
    """The minimised automaton of sorted words: edges and finality by state; state 0 is the start."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # states of the last word that may still change
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth:
                above, c, state = path.pop()
                same = known.setdefault((self.final[state], *self.edges[state].items()), state)
                self.edges[above][c] = same

        for word in words:
            shared = 0
            for x, y in zip(word, last):  # noqa: B905
                if x != y:
                    break
                shared += 1
            settle(shared)
            state = path[-1][2] if path else 0
            for c in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[state][c] = len(self.edges) - 1
                path.append((state, c, len(self.edges) - 1))
                state = path[-1][2]
            self.final[state] = True
            last = word
        settle(0)
        self._met: dict[tuple[int, int], list[str]] = {}
        self._spent: dict[int, list[tuple[str, str]]] = {}

    def met(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        key = (p, q) if p <= q else (q, p)
        todo = [key]
        while todo:  # depth first, without recursion: words may be long
            x = todo[-1]
            if x in self._met:
                todo.pop()
                continue
            a, b = self.edges[x[0]], self.edges[x[1]]
            next_ = [(c, (a[c], b[c]) if a[c] <= b[c] else (b[c], a[c])) for c in a if c in b]
            open_ = [k for _, k in next_ if k not in self._met]
            if open_:
                todo += open_
                continue
            found = [""] if self.final[x[0]] and self.final[x[1]] else []
            for c, k in next_:
                found += [c + rest for rest in self._met[k]]
            self._met[x] = found
            todo.pop()
        return self._met[key]

    def spent(self, q: int) -> list[tuple[str, str]]:
        """Pairs of rests from a state whose first code points are the edit: both differ there, or the first has one more."""
        if q not in self._spent:
            edges = sorted(self.edges[q].items())
            out = []
            for nth, (a, to) in enumerate(edges):
                for b, other in edges[nth + 1 :]:
                    out += [(a + rest, b + rest) for rest in self.met(to, other)]
                out += [(a + rest, rest) for rest in self.met(to, q) if not rest.startswith(a)]
            self._spent[q] = out
        return self._spent[q]

    def pairs(self, beginning: str) -> Iterator[tuple[str, str]]:
        """Pairs of words one edit apart that begin alike, the edit behind the beginning."""
        state = 0
        for c in beginning:
            state = self.edges[state].get(c, -1)
            if state < 0:
                return
        todo = [(beginning, state)]
        while todo:
            read, state = todo.pop()
            for a, b in self.spent(state):
                yield read + a, read + b
            todo += [(read + c, to) for c, to in self.edges[state].items()]


def composed(part: pd.DataFrame) -> pd.DataFrame:
    """Pairs of the words of one task: columns side, beginning, word, n; reversed words are on side 1."""
    out = []
    for side, rows in part.groupby("side"):
        n = dict(zip(rows["word"], rows["n"], strict=True))
        machine = Acceptor(sorted(n))
        for beginning in sorted(set(rows["beginning"])):
            for a, b in machine.pairs(beginning):
                if not side:
                    out.append((a, n[a], b, n[b]))
                elif a[-EDGE:] != b[-EDGE:]:  # pairs that begin alike are found on the other side
                    out.append((a[::-1], n[a], b[::-1], n[b]))
    return pd.DataFrame(out, columns=["a", "a_n", "b", "b_n"])


def next_edits(rows: DataFrame, step: int) -> DataFrame:
    """Pairs of ``rows`` (side, beginning, word, n) that spend the edit within ``step`` code points behind their beginning."""
    depth, length = F.length("beginning"), F.length("word")
    k = F.explode(F.sequence(depth, F.least(depth + step - 1, length)))
    each = rows.select("side", "word", "n", k.alias("k"))
    cut = F.concat(F.substring("word", F.lit(1), F.col("k")), F.substring("word", F.col("k") + 2, F.length("word")))
    kinds = F.array(F.struct(F.col("word").alias("rest"), F.lit(False).alias("cut")), F.struct(cut.alias("rest"), F.lit(True).alias("cut")))
    each = each.select("side", "word", "n", "k", F.explode(kinds).alias("r")).select("side", "word", "n", "k", "r.*").filter("not cut or length(rest) < length(word)")
    x = each.filter("cut").select("side", "k", "rest", F.col("word").alias("a"), F.col("n").alias("a_n"))
    y = each.select("side", "k", "rest", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("cut").alias("b_cut"))
    code = lambda c: F.substring(c, F.col("k") + 1, F.lit(1))
    met = x.join(y, ["side", "k", "rest"]).filter(code(F.col("a")) != code(F.col("b"))).filter("not b_cut or a < b")
    begin = lambda c: F.right(c, F.lit(EDGE))  # noqa: E731  (words are reversed there)
    met = met.filter((F.col("side") == 0) | (begin(F.col("a")) != begin(F.col("b"))))
    there = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c)
    return met.select(there("a"), "a_n", there("b"), "b_n")


def near_pairs(words: DataFrame, most: int = MOST, share: int = SHARE) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words (word, n) that exactly one edit parts, each once."""
    total = words.count()
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word"))))
    rows = words.filter(F.length("word") >= 2 * EDGE).select("n", sides.alias("s")).select("s.side", F.substring("s.word", 1, EDGE).alias("beginning"), "s.word", "n")
    parts, out = max(1, -(-2 * total // share)), []
    while True:
        large = rows.groupBy("side", "beginning").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most).drop("m")
        large = materialise(large, "large-states")
        if large.isEmpty():
            break
        hot = materialise(rows.join(large, ["side", "beginning"], "left_semi"), "large-state-words")
        out.append(next_edits(hot, STEP))
        rest = rows.join(large, ["side", "beginning"], "left_anti")
        further = hot.filter(F.length("word") >= F.length("beginning") + STEP).withColumn("beginning", F.substring("word", F.lit(1), F.length("beginning") + STEP))
        rows = materialise(rest.unionByName(further), "states")
    part = F.pmod(F.xxhash64("side", "beginning"), F.lit(parts))
    found = rows.groupBy(part.alias("part")).applyInPandas(lambda p: composed(p), NEAR)
    for more in out:
        found = found.unionByName(more)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """For words with a form (word, form) where following forms ends: (word, root); forms are ever more frequent, so they end."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialise(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = RATIO, most: int = MOST, share: int = SHARE) -> DataFrame:
    """Words (word, n) with n_near (words one edit away), form (the most frequent of these if it has ``ratio`` times the occurrences), form_n and root."""
    words = materialise(words, "vocabulary")
    pairs = materialise(near_pairs(words, most, share), "near-words")
    both = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{y}_n").alias("form_n"), F.col(y).alias("form")) for x, y in ("ab", "ba")]))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    near = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, "word", "left").withColumn("ok", -F.col("best.less") >= ratio * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("best.form")).alias("form"), F.when(F.col("ok"), -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
