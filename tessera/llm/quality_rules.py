"""Quality rules with thresholds that follow each language and source.

A pass over whole texts counts words, symbols, repeated lines and repeated
windows of words. Each count, as a ratio, goes into a quantile sketch per
language and source: values fall into buckets whose bounds grow by a fixed
factor, so sketches merge by adding counts and a quantile is known to that
factor. Fences follow from the quartiles (the upper one plus a multiple of
their distance, the lower one minus it), are joined back to the documents and
take the place of fixed cutoffs.

Quartiles of a group are shrunk towards those of all documents, as if
``prior`` more documents lay there, so a small group follows the others and a
large one itself.

Cases: a null text counts as empty and fails the base rules (no words); null
languages and sources are groups of their own; ties and repeated rows are
judged alike; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, flat, materialise, plus, slices, small, summed

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Growth of the buckets of a sketch, and the size of values that share bucket 0.
GROWTH, UNIT = 1.05, 1e-3
#: A fence stands so many quartile distances from its quartile.
REACH = 6.0
#: Documents that the quartiles of all documents count for in each group.
PRIOR = 50
#: Ratios that are judged: (name, numerator, denominator, least distance of quartiles, with a lower fence).
RATIOS = (
    ("word_length", "word_chars", "n_words", 0.5, True),
    ("symbols", "n_symbols", "n_words", 0.05, False),
    ("dup_lines", "n_dup_lines", "n_lines", 0.1, False),
    ("repeats", "n_repeat_words", "n_words", 0.05, False),
)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
#: A byte that begins a character which belongs to a word.
IN_WORD = ~SPACE
IN_WORD[0x80:0xC0] = False
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text its words that stand in a window which the text holds twice or more."""
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    out = np.zeros(len(words), np.int64)
    if total < WINDOW:
        return out
    h = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, total).view(np.uint64)
    text = np.repeat(np.arange(len(words)), lengths)
    n = total - WINDOW + 1
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        key ^= key >> np.uint64(29)
    inside = text[:n] == text[WINDOW - 1 :]
    key = key * np.uint64(0xBF58476D1CE4E5B9) + text[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(inside)
    key = key[at]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(text, np.cumsum(edge[:-1]) > 0, len(words)).astype(np.int64)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of whole texts (a binary column)."""
    data, offsets = flat(texts)
    listed = texts.to_pylist()
    words = [x.split() for x in listed]
    dup, lines = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
    for i, x in enumerate(listed):
        found = [y for y in x.split(b"\n") if y and not y.isspace()]
        lines[i], dup[i] = len(found), len(found) - len(set(found))
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": summed(IN_WORD[data], offsets),
        "n_symbols": summed(IS_SYMBOL[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
    }


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text."""
    schema = plus(docs.schema, *((name, "long") for name in COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = counts(as_bytes(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[n]) for n in COUNTS)], names=schema.names)

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    """The rules that hold everywhere: under 20 words, or over 30 % of words in repeated windows."""
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


def bucket(value: Column) -> Column:
    """The bucket of a sketch into which a value that is not negative falls."""
    return F.floor(F.log(1 + value / F.lit(UNIT)) / F.lit(float(np.log(GROWTH)))).cast("int")


def middle(at: Column) -> Column:
    """A value that stands for a bucket."""
    return (F.pow(F.lit(GROWTH), at + 0.5) - 1) * F.lit(UNIT)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of every ratio by ``keys``: rows (keys, rule, bucket, n)."""
    return rows.groupBy(*keys, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """From sketches to (keys, rule, size, low, high): the quartiles and how many values they stand on."""
    by = Window.partitionBy(*keys, "rule")
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("size", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("size") * F.lit(q)), F.col("bucket")))
    return ranked.groupBy(*keys, "rule").agg(F.max("size").alias("size"), middle(at(0.25)).alias("low"), middle(at(0.75)).alias("high"))


def fences(counted: DataFrame, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """Fences by language and source: rows (lang, source, and for each ratio lo_ and hi_)."""
    pairs = [F.struct(F.lit(name).alias("rule"), bucket(F.try_divide(F.col(a), F.col(b))).alias("bucket")) for name, a, b, *_ in RATIOS]
    long = counted.filter(~base_failed()).select("lang", "source", F.explode(F.array(*pairs)).alias("x")).select("lang", "source", "x.*")
    # a ratio without a value, as that of lines of a text without lines, is not in its sketch
    by_group = materialise(sketches(long.filter("bucket is not null"), ["lang", "source"]), "sketches")
    merged = by_group.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    every = quartiles(merged, []).select("rule", F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    own = quartiles(by_group, ["lang", "source"]).join(F.broadcast(every), "rule")  # one row per rule
    shrunk = lambda q: (F.col(q) * F.col("size") + F.col(f"all_{q}") * prior) / (F.col("size") + prior)
    own = own.withColumns({"low": shrunk("low"), "high": shrunk("high")})
    out = []
    for name, _, _, distance, lower in RATIOS:
        apart = F.greatest(F.col("high") - F.col("low"), F.lit(distance)) * F.lit(reach)
        of = F.col("rule") == name
        out.append(F.max(F.when(of, F.col("high") + apart)).alias(f"hi_{name}"))
        # the lower fence never falls under a quarter of the quartile
        out.append(F.max(F.when(of & F.lit(lower), F.col("low") - F.least(apart, F.col("low") * 0.75))).alias(f"lo_{name}"))
    return own.groupBy("lang", "source").agg(*out)


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Counted documents (lang, source, the counts, others) with base_failed, failed_rules (names of the ratios beyond a fence) and kept."""
    names = [f"{side}_{r[0]}" for r in RATIOS for side in ("hi", "lo")]
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names)
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = []
    for name, a, b, _, _ in RATIOS:
        value = F.try_divide(F.col(a), F.col(b))
        broken.append(F.when((value > F.col(f"hi_{name}")) | (value < F.col(f"lo_{name}")), F.lit(name)))
    joined = joined.withColumn("failed_rules", F.array_compact(F.array(*broken))).withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", "_source", *names)


def quality_rules(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The verdict on each document: doc_id, the counts, base_failed, kept, failed_rules."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = materialise(with_counts(rows).drop("text"), "counts")
    limits = small(materialise(fences(counted, reach), "fences"))
    return judged(counted, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def kept(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The rows of ``docs`` that are kept.

    Fences and verdicts each take a pass over the texts; nothing but sketches
    is shuffled or written, so counting twice takes the place of writing or
    shuffling every text once more.
    """
    slim = with_counts(docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))).drop("text")
    limits = small(materialise(fences(slim, reach), "fences"))
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column has a name that is used here
    at = {n: names[docs.columns.index(n)] for n in ("lang", "source", "text")}
    rows = with_counts(docs.toDF(*names).withColumns({n: F.col(at[n]).cast("string") for n in ("lang", "source")}), at["text"])
    return judged(rows, limits).filter("kept").select(*names).toDF(*docs.columns)
