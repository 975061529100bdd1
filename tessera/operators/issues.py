"""Issues of audit rules: rules, union, de-duplication, counts, ranking, snapshots.

An issue row has project_id, rule_id, category, risk_level, file_path, line,
description and pos (its place among the issues found).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X
from ..sources.tables import materialise
from . import code
from .ranks import ranked

KEY = ["project_id", "rule_id", "file_path", "line", "description"]
ORDER = ["file_path", "line", "rule_id"]


@dataclass(frozen=True)
class Rule:
    """A pluggable rule: its id, category and base level, and what it finds in a corpus."""

    id: str
    category: str
    level: str
    inspect: Callable[[DataFrame], DataFrame]


class Rules:
    """Rules by id, in the order they were added."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.all: dict[str, Rule] = {}
        for r in rules:
            self.add(r)

    def add(self, rule: Rule) -> None:
        if rule.id in self.all:
            raise ValueError(f"rule {rule.id} is there already")
        self.all[rule.id] = rule

    def audit(self, corpus: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
        """Issues of all rules, or of those named, over a corpus; once each."""
        chosen = list(self.all.values()) if only is None else [self.all[i] for i in only]
        return dedupe(union(r.inspect(corpus) for r in chosen))


def line_issues(lines: DataFrame) -> DataFrame:
    """Credentials (HIGH) and, where a line has none, connection strings (MEDIUM), from lines (project_id, file_path, line, text)."""
    level = F.when(F.col("text").rlike(L.CREDENTIAL), "HIGH").when(F.col("text").rlike(L.CONNECTION), "MEDIUM")
    found = lines.withColumn("risk_level", level).filter("risk_level is not null")
    return found.select(
        "project_id",
        F.lit("HARDCODED-VALUE").alias("rule_id"),
        F.lit("HARDCODED").alias("category"),
        "risk_level",
        "file_path",
        "line",
        F.when(F.col("risk_level") == "HIGH", "credential in text").otherwise("connection string in text").alias("description"),
        F.col("line").cast("long").alias("pos"),
    )


def literal_issues(files: DataFrame) -> DataFrame:
    """The same of the string literals of source files, each with the literal as ``trigger``; text blocks hold line breaks and are never one value."""
    rows = code.literals(files).filter("kind = 'STRING'").withColumn("trigger", F.concat(F.lit('"'), "text", F.lit('"')))
    level = F.when(F.col("text").rlike(L.CREDENTIAL), "HIGH").when(F.col("text").rlike(L.CONNECTION), "MEDIUM")
    found = rows.withColumn("risk_level", level).filter("risk_level is not null")
    text = F.when(F.col("risk_level") == "HIGH", "credential in a literal").otherwise("connection string in a literal")
    return found.select(
        "project_id", F.lit("HARDCODED-VALUE").alias("rule_id"), F.lit("HARDCODED").alias("category"), "risk_level", "file_path", "line", text.alias("description"),
        (F.col("line").cast("long") * 1_000_000 + F.col("column")).alias("pos"), "trigger",
    )


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dedupe(issues: DataFrame) -> DataFrame:
    """One row per key, the most severe one; among equals the first found. A partial aggregate, then one shuffle on the key."""
    best = F.min_by(F.struct("category", "risk_level", "pos"), F.struct(X.risk_rank(F.col("risk_level")), "pos")).alias("best")
    return issues.groupBy(*KEY).agg(best).select(*KEY, "best.*")


def counts_by_risk(issues: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Issues of each project (of ``projects``, or those with issues) by level, a row for every level: those without issues have 0."""
    n = [F.count_if(F.col("risk_level") == r).alias(r) for r in L.RISKS]
    rows = issues.groupBy("project_id").agg(*n)
    if projects is not None:
        rows = projects.select("project_id").distinct().join(rows, "project_id", "left").fillna(0, list(L.RISKS))
    return rows.unpivot("project_id", list(L.RISKS), "risk_level", "n")


def counts_at_once(issues: DataFrame) -> DataFrame:
    """Counts by level, by rule, by file and in all, in one pass."""
    cube = issues.groupingSets([["risk_level"], ["rule_id"], ["file_path"], []], "risk_level", "rule_id", "file_path")
    kind = F.when(F.grouping("risk_level") == 0, "risk").when(F.grouping("rule_id") == 0, "rule").when(F.grouping("file_path") == 0, "file").otherwise("all")
    return cube.agg(kind.alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", F.coalesce("risk_level", "rule_id", "file_path", F.lit("*")).alias("name"), "n")


def report(issues: DataFrame) -> DataFrame:
    """Per project: total, high, medium, low, files, highest level, score, status and grade."""
    n = {r: F.count_if(F.col("risk_level") == r) for r in L.RISKS}
    rows = issues.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"), *[c.alias(r.lower()) for r, c in n.items()],
        F.count_distinct("file_path").alias("files"), F.min_by("risk_level", X.risk_rank(F.col("risk_level"))).alias("highest"),
    )
    return score(rows)


def score(rows: DataFrame) -> DataFrame:
    """Scores from counts (total, high, medium, low): heuristics, not measured rates."""
    total, high, medium, low = map(F.col, ("total", "high", "medium", "low"))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (high * 8.0 + medium * 3.0 + low * 0.8)))
    rows = rows.withColumn("overall", overall)
    return (
        rows.withColumn("severe_share", F.when(total == 0, 1.0).otherwise((high + medium) / total))
        .withColumn("minor_share", F.when(total == 0, 0.0).otherwise(low / total))
        .withColumn("architecture", F.greatest(F.lit(0.0), 1 - medium / F.greatest(total + 5, F.lit(1))))
        .withColumn("rule_match", F.greatest(F.lit(0.0), 1 - high / F.greatest(total + 3, F.lit(1))))
        .withColumn("documentation", F.when(F.col("overall") >= 70, 0.85).otherwise(0.55))
        .withColumn("status", F.when(F.col("overall") >= 60, "PASSED").otherwise("FAILED"))
        .withColumn("grade", F.when(F.col("overall") >= 80, "good").when(F.col("overall") >= 60, "fair").otherwise("poor"))
    )


def tree_density(issues: DataFrame) -> DataFrame:
    """For every folder and file on the way to an issue, its issues and the worst level, with the project's largest count."""
    each = issues.select("project_id", F.explode(X.prefixes(X.normal_path(F.col("file_path")))).alias("path"), X.risk_rank(F.col("risk_level")).alias("rank"))
    stats = each.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    stats = materialise(stats, "density")
    most = stats.groupBy("project_id").agg(F.max("n").alias("most"))  # a row per project
    return stats.join(most, "project_id").select("project_id", "path", "n", F.element_at(F.array(*map(F.lit, L.RISKS)), F.col("rank") + 1).alias("worst"), "most")


def flagged(issues: DataFrame) -> DataFrame:
    """Issues with the flags that decide what is shown."""
    ignorable = (F.col("rule_id") == "EMPTY-CATCH") | F.col("description").contains("empty catch")
    config = F.col("rule_id").startswith("DEPENDENCY") | (F.col("category") == "DEPENDENCY")
    return issues.withColumns({"ignorable": ignorable, "dependency_config": config, "low_impact": ignorable | (config & (F.col("risk_level") == "LOW"))})


def visible(issues: DataFrame, hide_low_impact: bool = True, hide_dependency: bool = False) -> DataFrame:
    rows = flagged(issues)
    hidden = (F.lit(hide_low_impact) & F.col("low_impact")) | (F.lit(hide_dependency) & F.col("dependency_config"))
    return rows.filter(~hidden)


def validated(issues: DataFrame, width: int = 512) -> tuple[DataFrame, DataFrame]:
    """(valid rows with texts cut to ``width``, rejected rows with their reasons)."""
    texts = ["rule_id", "file_path", "description"]
    reasons = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is empty")) for c in texts]
    reasons.append(F.when(F.coalesce(F.col("line"), F.lit(-1)) < 0, F.lit("line is negative")))
    reasons.append(F.when(~F.coalesce(F.col("risk_level").isin(*L.RISKS), F.lit(False)), F.lit("unknown level")))
    rows = issues.withColumn("reasons", F.array_compact(F.array(*reasons)))
    valid = rows.filter(F.size("reasons") == 0).drop("reasons")
    return valid.withColumns({c: F.substring(c, 1, width) for c in texts}), rows.filter(F.size("reasons") > 0)


def line_counts(files: DataFrame) -> DataFrame:
    """Lines of each file that has a text: files (project_id, file_path, content)."""
    return files.filter("content is not null").select("project_id", "file_path", F.size(F.split("content", "\n")).alias("lines"))


def line_marks(issues: DataFrame, counts: DataFrame, on: Sequence[str] = ("project_id", "file_path")) -> DataFrame:
    """Issues whose line is there: counts has the columns ``on`` and lines.

    Where issues are matched with files by something else than their path,
    ``on`` names it, and the line is checked as they meet: pairs that do not
    pass are never shuffled, however many there are.
    """
    return issues.join(counts, list(on)).filter("line between 1 and lines").drop("lines")


def keyed(issues: DataFrame) -> DataFrame:
    return issues.withColumn("issue_key", X.issue_key(F.col("rule_id"), F.col("file_path"), F.col("line")))


def without(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """Issues whose key is not among ``keys`` (project_id, issue_key): ignored ones, or ones with a fix."""
    return keyed(issues).join(keys.select("project_id", "issue_key").distinct(), ["project_id", "issue_key"], "left_anti")


def with_suggestion(issues: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions (project_id, issue_key, ...) beside their issues."""
    return keyed(issues).join(suggestions, ["project_id", "issue_key"])


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row per key as one aggregate; ``order`` from the most to the least weighty, larger is newer."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def ordered(issues: DataFrame) -> DataFrame:
    """All issues with their place (nth) in the canonical order of their project: file, line, rule, first found; then by description."""
    return ranked(issues, ["project_id"], [*ORDER, "pos", "description"])


def top(issues: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n issues of each project; Spark keeps n rows per task and group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return issues.withColumn("nth", rn).filter(F.col("nth") <= n)


def severe_or_all(issues: DataFrame) -> DataFrame:
    """HIGH and MEDIUM issues of projects that have any, else all of a project's issues."""
    severe = F.col("risk_level").isin("HIGH", "MEDIUM")
    some = issues.groupBy("project_id").agg(F.bool_or(severe).alias("some"))
    return issues.join(some, "project_id").filter(severe | ~F.col("some")).drop("some")


def batches(issues: DataFrame) -> DataFrame:
    """Rules with two or more issues in a project, most first."""
    return issues.groupBy("project_id", "rule_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").orderBy(F.desc("n"), "project_id", "rule_id")


def advice(issues: DataFrame) -> DataFrame:
    """A fix text per issue, chosen by words of the rule and the description, and why: the issue's own note in ``risk_note``, if there is such a column and it says anything, else its rule."""
    rule, text = F.upper("rule_id"), F.col("description")
    at = F.concat("file_path", F.lit(":"), F.col("line").cast("string"))
    says = lambda kind: F.exists(F.array(*map(F.lit, L.ADVICE_WORDS[kind])), lambda w: F.contains(text, w))
    advice = (
        F.when(rule.contains("NULL") | says("NULL"), F.concat(F.lit("put the constant on the left of equals at "), at))
        .when(rule.contains("DEAD") | says("DEAD"), F.concat(F.lit("delete or call the unused code at "), at))
        .when(rule.contains("EXCEPTION") | says("EXCEPTION"), F.concat(F.lit("log or rethrow in the catch block at "), at))
        .when(rule.contains("CONFLICT") | says("CONFLICT"), F.concat(F.lit("make versions agree in "), F.col("file_path")))
        .otherwise(F.concat(F.lit("change "), at, F.lit(": "), text))
    )
    by_rule = F.concat(F.lit("by rule "), F.col("rule_id"))
    note = F.when(F.trim("risk_note") != "", F.col("risk_note")).otherwise(by_rule) if "risk_note" in issues.columns else by_rule
    return issues.withColumns({"advice": advice, "rationale": note})


def involved(rows: DataFrame, kind: str, column: str) -> DataFrame:
    """What results involve, each once a project: (project_id, kind, name), from issues, technologies or cycles; nulls and blank names are nothing."""
    named = rows.select("project_id", F.lit(kind).alias("kind"), F.col(column).cast("string").alias("name"))
    return named.filter(F.trim("name") != "").distinct()


def snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """Per project and snapshot (captured_at, issue_keys) what was added, removed and kept since the one before."""
    before = F.lag("issue_keys").over(Window.partitionBy("project_id").orderBy("captured_at"))
    rows = snapshots.withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    return rows.select(
        "project_id", "captured_at",
        F.size(F.array_except("issue_keys", "before")).cast("long").alias("added"),
        F.size(F.array_except("before", "issue_keys")).cast("long").alias("removed"),
        F.size(F.array_intersect("issue_keys", "before")).cast("long").alias("unchanged"),
    )


def snapshot_history(snapshots: DataFrame, keep: int = 12) -> DataFrame:
    """Snapshots that differ from the one before, the newest ``keep`` of a project."""
    order = Window.partitionBy("project_id").orderBy("captured_at")
    changed = snapshots.withColumn("before", F.lag("issue_keys").over(order)).filter("before is null or before <> issue_keys").drop("before")
    newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("captured_at")))
    return changed.withColumn("nth", newest).filter(F.col("nth") <= keep)


# --- snapshots as rows (project_id, captured_at, issue_key, nth), nth being a key's place in its snapshot ---


def long_form(issues: DataFrame, captured_at: Column, key: Column) -> DataFrame:
    """Snapshots as rows, from issues: each key of a project and day once, in order."""
    rows = issues.select("project_id", captured_at.alias("captured_at"), key.alias("issue_key")).distinct()
    return ranked(rows, ["project_id", "captured_at"], ["issue_key"])


def sequence(snapshots: DataFrame) -> DataFrame:
    """The snapshots of each project with the one before: a row per snapshot, however many keys it has."""
    before = F.lag("captured_at").over(Window.partitionBy("project_id").orderBy("captured_at"))
    return snapshots.select("project_id", "captured_at").distinct().withColumn("before", before)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Keys of every snapshot against the one before: (project_id, captured_at, issue_key, change), ADDED, REMOVED or UNCHANGED; all keys of a first one are added."""
    steps = materialise(sequence(snapshots), "snapshot-steps")
    now = snapshots.select("project_id", "captured_at", "issue_key", F.lit(True).alias("here"))
    then = snapshots.select("project_id", F.col("captured_at").alias("before"), "issue_key", F.lit(True).alias("there"))
    then = then.join(steps.filter("before is not null"), ["project_id", "before"]).drop("before")
    both = now.join(then, ["project_id", "captured_at", "issue_key"], "full_outer")
    change = F.when(F.col("there").isNull(), "ADDED").when(F.col("here").isNull(), "REMOVED").otherwise("UNCHANGED")
    return both.select("project_id", "captured_at", "issue_key", change.alias("change"))


def digests(snapshots: DataFrame) -> DataFrame:
    """A digest of each snapshot that differs with its keys and their order: of the hashes of key and place a count, a sum and an exclusive or, which merge."""
    h = F.xxhash64("issue_key", "nth")
    return snapshots.groupBy("project_id", "captured_at").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("nth", "issue_key")).alias("mixed")).alias("digest"))


def history(snapshots: DataFrame, keep: int = 12) -> DataFrame:
    """Snapshots that differ from the one before in keys or order, the newest ``keep`` of a project; only digests are compared."""
    order = Window.partitionBy("project_id").orderBy("captured_at")
    changed = digests(snapshots).withColumn("before", F.lag("digest").over(order)).filter("before is null or before <> digest")
    newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("captured_at")))
    return changed.select("project_id", "captured_at", "digest.n").withColumn("nth", newest).filter(F.col("nth") <= keep)
