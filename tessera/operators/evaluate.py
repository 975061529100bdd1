"""Metrics of detected against expected findings, sample by sample.

expected: (sample_id, category, required, forbidden, layers, documentation);
observed: (sample_id, detected, layers_seen, documented). Lists are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked

METRICS = ("recall", "false_positive_rate", "architecture_accuracy", "rule_match", "documentation_score")


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def metrics(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """The five metrics of each sample; sides without entries have fixed values."""
    none = F.array().cast("array<string>")
    rows = expected.join(observed, "sample_id", "left").withColumns({c: F.coalesce(c, none) for c in ("detected", "layers_seen", "required", "forbidden", "layers")})
    hit = F.size(F.array_intersect("required", "detected"))
    wrong = F.size(F.array_intersect("forbidden", "detected"))
    need, ban, got = (F.size(F.array_distinct(c)) for c in ("required", "forbidden", "detected"))
    return rows.select(
        "sample_id", "category",
        share(hit, need, 1.0).alias("recall"),
        share(wrong, got, 0.0).alias("false_positive_rate"),
        share(F.size(F.array_intersect("layers", "layers_seen")), F.size(F.array_distinct("layers")), 1.0).alias("architecture_accuracy"),
        share(hit + ban - wrong, need + ban, 1.0).alias("rule_match"),
        (F.col("documentation") == F.coalesce("documented", F.lit(False))).cast("double").alias("documentation_score"),
    )


def macro_average(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Plain averages over samples, in all or by a column; no sample at all is an error."""
    if rows.isEmpty():
        raise ValueError("no sample to average")
    means = [F.avg(m).alias(m) for m in METRICS]
    return (rows.groupBy(by) if by else rows).agg(F.count(F.lit(1)).alias("samples"), *means)


def problems(expected: DataFrame, categories: list[str], least: int = 3, undocumented: str | None = None) -> DataFrame:
    """What is wrong with a data set: (problem, subject).

    Repeated and blank ids, categories with too few samples, lists with blank
    entries, samples of the ``undocumented`` category that expect
    documentation, and, where there are such columns, a minimum above its
    maximum.
    """
    subject = F.coalesce(F.col("sample_id").cast("string"), F.lit("")).alias("subject")
    of = lambda rows, problem: rows.select(F.lit(problem).alias("problem"), subject)
    repeated = of(expected.groupBy("sample_id").count().filter("count > 1"), "repeated id")
    blank = of(expected.filter(F.coalesce(F.trim(F.col("sample_id").cast("string")), F.lit("")) == ""), "blank id")
    named = expected.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = named.join(expected.groupBy("category").count(), "category", "left").filter(F.coalesce("count", F.lit(0)) < least)
    out = repeated.unionByName(blank).unionByName(counts.select(F.lit("few samples").alias("problem"), F.col("category").alias("subject")))
    for c in ("required", "forbidden", "layers"):
        out = out.unionByName(of(expected.filter(F.exists(c, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")), f"blank entry in {c}"))
    if undocumented is not None:
        out = out.unionByName(of(expected.filter((F.col("category") == undocumented) & F.col("documentation")), "contradictory documentation"))
    if {"least", "most"} <= set(expected.columns):
        out = out.unionByName(of(expected.filter("least > most"), "minimum above maximum"))
    return out


def by_category(expected: DataFrame) -> DataFrame:
    """Samples of each category, numbered: (category, nth, sample_id)."""
    return ranked(expected.select("category", "sample_id"), ["category"], ["sample_id"])


def reports(rows: DataFrame) -> DataFrame:
    """Metric rows as JSON and as a line of text."""
    text = F.format_string("%s: recall %.2f, false positives %.2f, rules %.2f", F.col("sample_id").cast("string"), "recall", "false_positive_rate", "rule_match")
    return rows.select("sample_id", F.to_json(F.struct(*METRICS)).alias("metrics"), text.alias("markdown"))


def traced(failures: DataFrame) -> DataFrame:
    """Failures (sample_id, pos, node, message, detail) of pipeline runs as one trace per sample, in order of ``pos``; those without a message say nothing and are left out, a null detail is empty."""
    told = failures.filter(F.trim("message") != "").withColumn("detail", F.coalesce("detail", F.lit("")))
    return told.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "message", "detail"))).alias("trace"))  # steps of one sample's run


def full_reports(rows: DataFrame, failures: DataFrame, version: str = "-") -> DataFrame:
    """A report per sample: (sample_id, status, metrics, trace, markdown).

    ``rows`` are those of ``metrics``, with or without a column ``status``; a
    sample without one has PASSED if nothing failed, else FAILED. metrics and
    trace are JSON, an absent trace is an empty list; the text has the metrics
    with two decimals and a line for each failure.
    """
    none = F.array().cast("array<struct<pos:bigint,node:string,message:string,detail:string>>")
    traces = traced(failures).withColumn("trace", F.col("trace").cast("array<struct<pos:bigint,node:string,message:string,detail:string>>"))
    own = rows.join(traces, "sample_id", "left").withColumn("trace", F.coalesce("trace", none))
    status = F.when(F.size("trace") == 0, "PASSED").otherwise("FAILED")
    own = own.withColumn("status", F.coalesce("status", status) if "status" in rows.columns else status)
    said = F.transform("trace", lambda x: F.concat(F.lit("- **"), x.node, F.lit("**: "), x.message, F.when(F.trim(x.detail) == "", "").otherwise(F.concat(F.lit(" ("), x.detail, F.lit(")"))), F.lit("\n")))
    head = F.format_string("# Evaluation report\n\n- data set: %s\n- sample: %s\n- status: %s\n\n## Metrics\n\n| metric | value |\n|---|---|\n", F.lit(version), F.col("sample_id").cast("string"), "status")
    table = F.concat(*[F.format_string(f"| {m} | %.2f |\n", m) for m in METRICS])
    text = F.concat(head, table, F.lit("\n## Failures\n\n"), F.when(F.size("trace") == 0, "none\n").otherwise(F.array_join(said, "")))
    entries = F.transform("trace", lambda x: F.struct(x.node.alias("node"), x.message.alias("message"), x.detail.alias("detail")))
    return own.select("sample_id", "status", F.to_json(F.struct(*METRICS)).alias("metrics"), F.to_json(entries).alias("trace"), text.alias("markdown"))
