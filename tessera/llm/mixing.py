"""Mixing sources to target weights, with DataFrame functions alone.

Every document draws an exponential key divided by its quality weight
(Efraimidis-Spirakis): sorting a source by key is weighted sampling without
replacement. A source gives whole epochs first; what is left of its target is
filled by the documents with the smallest keys, as far as the prefix sum of
their sizes fits.

No source is ever sorted as a whole. The logarithm of the key becomes a number
of 60 bits, and the place where a source's budget ends is found digit by digit,
12 bits at a time: sizes are summed per source and digit, prefix sums over the
digits tell in which one the budget ends, and the next step looks at that one
alone, until few enough documents are left to be sorted. So a source with a
third of all rows costs a few partial aggregates, however its keys lie.

The key depends on the seed, the id and the text. Rows with the same id and
text are equal to the mix and draw one key; if the budget ends among them,
some of them are taken: they are numbered in lots of about ``LOT`` rows. Which
rows of equal ones these are is open, how many is not, so reruns agree.

Cases: null and empty texts have size 0; a null source is a source of its own,
sorted last; null and repeated ids are rows like any other; an empty table
gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, small, word_count

#: Bits of a digit and of the whole number.
DIGIT, BITS = 12, 60
#: Documents of a source that are sorted in one task.
LOT = 20_000
#: Characters that lower a document's weight.
SYMBOLS = "#*$%&|<>"


def default_quality(text: Column, size: Column) -> Column:
    """Weight of a document: the share of its words among words and symbol characters, between 0 and 1."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return (size + 1) / (size + 1 + symbols)


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with running totals, each row's own value included, in an order over all of them: sorted in parts, with a total per part."""
    rows = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows, "parts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(small(parts), "_part")
    rows = rows.withColumns({n: F.sum(c).over(inside) + F.col(f"_base_{n}") for n, c in sums.items()})
    return rows.drop("_part", *[f"_base_{n}" for n in sums])


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of all sizes by ``weights``, none above ``most`` times its size.

    Capping and resharing by weight until none is above its cap settles where
    every source gets min(cap, weight x level). In the order of cap / weight
    all sources up to some place are capped, and the level of a place follows
    from running totals; the first source that its cap does not bind sets it.
    """
    rows = running(sizes, [F.col("source").isNull(), F.col("source")], nth=F.lit(1))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = materialise(running(rows, [F.col("cap") / F.col("weight"), F.col("nth")], caps=F.col("cap"), weights=F.col("weight")), "levels")
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    goal, weight = float(total["size"] or 0) * share, total["weight"] or 0.0
    level = (F.lit(goal) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - F.col("weights") + F.col("weight"))
    free = rows.filter(F.col("weight") * level <= F.col("cap"))
    free = free.agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("nth"), level.alias("level"))).alias("x")).first()["x"]
    target = F.col("cap") if free is None else F.least("cap", F.col("weight") * F.lit(free["level"]))
    return rows.select("source", "source_size", target.alias("target"))


def drawn(docs: DataFrame, quality: Column | None, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows (doc: the whole row, id, source, size, place): place is the logarithm of the key as a number of ``BITS`` bits."""
    text = F.col(text_col).cast("string")
    weight = (quality if quality is not None else F.lit(None)).cast("double")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 12)
    rows = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text"),
        word_count(text).alias("size"), weight.alias("weight"), draw.alias("draw"),
    )
    weight = F.col("weight") if quality is not None else default_quality(F.col("text"), F.col("size"))
    # 52 bits, centred between grid points so that neither 0 nor 1 comes out
    key = -F.log((F.col("draw") + 0.5) / F.lit(float(1 << 52))) / F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1e-9))
    place = F.floor((F.log(key) + 128) / 256 * float(1 << BITS))
    place = F.greatest(F.least(place, F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")
    return rows.select("doc", "id", "source", "size", place.alias("place"))


def of_source(rows: DataFrame, more: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with columns by source, broadcast if there are few sources; a null source is one like any other."""
    more = more.withColumnRenamed("source", "_of")
    return rows.join(F.broadcast(more) if few else more, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def cuts(rows: DataFrame, words: DataFrame, budgets: DataFrame, few: bool, lot: int) -> DataFrame:
    """Where the budgets (source, rest) end: (source, last, edge, edge_rows, edge_taken).

    Rows are (source, size, place), and ``words`` their sizes by the first
    digit (source, digit, words, n). Places up to ``last`` fit; of the
    ``edge_rows`` at the next place, ``edge``, so many fit as ``edge_taken`` says.
    """
    shift = BITS - DIGIT
    state = budgets.filter("rest > 0").withColumn("before", F.lit(0).cast("long"))
    while True:
        earlier = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        found = of_source(words.withColumn("sum", F.coalesce(F.sum("words").over(earlier), F.lit(0))), state, few)
        found = found.withColumn("before", F.col("before") + F.col("sum")).filter("before < rest")
        # the last digit that begins below the budget is the one in which it ends
        found = found.groupBy("source").agg(F.max(F.struct("digit", "before", "rest", "n")).alias("x")).select("source", "x.*")
        state = materialise(found, "mix-digits")
        if shift == 0 or state.filter(F.col("n") > lot).isEmpty():
            break
        inside = of_source(rows, state.select("source", "digit"), few).filter(F.shiftright("place", shift) == F.col("digit"))
        shift -= DIGIT
        words = by_digit(inside, shift)
        state = state.select("source", "rest", "before")
    inside = of_source(rows, state.select("source", "digit"), few).filter(F.shiftright("place", shift) == F.col("digit"))
    each = inside.groupBy("source", "place").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    each = of_source(each, state.select("source", "before", "rest"), few)
    ahead = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("words").over(ahead), F.lit(0))
    # a document is in if at least half of it fits, so a source misses its target by half a document at most
    fits = F.when(F.col("words") == 0, F.col("n")).otherwise(F.floor(room / (F.col("words") / F.col("n")) + 0.5))
    each = each.withColumn("taken", F.greatest(F.least(fits, F.col("n")), F.lit(0)))
    first_out = F.min(F.when(F.col("taken") < F.col("n"), F.struct("place", "n", "taken"))).alias("e")
    ends = each.groupBy("source").agg(first_out, F.max("place").alias("top"))
    last = F.when(F.col("e").isNull(), F.col("top")).otherwise(F.col("e.place") - 1)
    return ends.select("source", last.alias("last"), F.col("e.place").alias("edge"), F.col("e.n").alias("edge_rows"), F.col("e.taken").alias("edge_taken"))


def by_digit(rows: DataFrame, shift: int) -> DataFrame:
    digits = rows.groupBy("source", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    return materialise(digits, "mix-words")


def plan(rows: DataFrame, weights: Sequence[float], share: float, most: float, lot: int) -> tuple[DataFrame, bool]:
    """What each source gives, from rows (source, size, place): source, source_size, target, epochs, and the columns of ``cuts``; and whether sources are few."""
    words = by_digit(rows, BITS - DIGIT)
    goals = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = materialise(goals, "mix-goals")
    few = goals.count() <= BROADCAST_ROWS
    ends = cuts(rows, words, goals.select("source", "rest"), few, lot)
    return materialise(of_source(goals, ends, few, "left").drop("rest"), "mix-plan"), few


def times(rows: DataFrame, planned: DataFrame, few: bool, lot: int) -> DataFrame:
    """Rows (source, place, ...) with source_size, target and ``times``, how often the mix takes each."""
    joined = of_source(rows, planned, few, "left")
    taken = joined.withColumn("times", F.col("epochs") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0))
    keep = [*rows.columns, "source_size", "target", "times"]
    if planned.filter("edge_taken > 0").isEmpty():
        return taken.select(*keep)
    on_edge = F.coalesce((F.col("place") == F.col("edge")) & (F.col("edge_taken") > 0), F.lit(False))
    # equal rows at which a budget ends: numbered in lots, whole lots first
    edge = taken.filter(on_edge).withColumn("row", F.monotonically_increasing_id())
    edge = edge.withColumn("lot", F.pmod(F.xxhash64("row"), F.floor(F.col("edge_rows") / lot) + 1))
    edge = materialise(edge, "mix-edge")  # which also makes the numbers last
    earlier = Window.partitionBy("source").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = edge.groupBy("source", "lot").agg(F.count(F.lit(1)).alias("n"))
    lots = lots.select(F.col("source").alias("_of"), F.col("lot").alias("_lot"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    edge = edge.join(lots, F.col("source").eqNullSafe(F.col("_of")) & (F.col("lot") == F.col("_lot")))
    nth = F.col("earlier") + F.row_number().over(Window.partitionBy("source", "lot").orderBy("row"))
    edge = edge.withColumn("times", F.col("epochs") + F.when(nth <= F.col("edge_taken"), 1).otherwise(0))
    return taken.filter(~on_edge).select(*keep).unionByName(edge.select(*keep))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lot: int = LOT,
) -> DataFrame:
    """How often each document enters the mix.

    Returns doc_id, size, source_size, target (of its source), times (copies
    the mix takes) and taken (words: times x size), a row per row of ``docs``.
    """
    rows = materialise(drawn(docs, quality, seed, id_col, text_col, source_col).drop("doc"), "mix")
    found = times(rows, *plan(rows, weights, share, most, lot), lot)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: str = "mix", lot: int = LOT) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Texts aren't shuffled, but for equal ones at which a budget ends."""
    rows = drawn(docs, quality, seed, "doc_id", "text", "source")
    slim = materialise(rows.drop("doc"), "mix")
    found = times(rows, *plan(slim, weights, share, most, lot), lot).filter("times > 0")
    return found.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc.*")
