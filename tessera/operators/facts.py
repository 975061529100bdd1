"""Facts of source files by line patterns: files (project_id, file_path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from . import code
from .ranks import ranked


def lines(files: DataFrame, content: Column | str = "content") -> DataFrame:
    """Lines with their numbers, from 1."""
    rows = files.select("project_id", "file_path", F.posexplode(F.split(content, "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1)


def found_at(rows: DataFrame, rule: str, category: str, level: str, description: str) -> DataFrame:
    """Places (project_id, file_path, line) as issue rows."""
    return rows.select(
        "project_id", F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(level).alias("risk_level"), "file_path", "line", F.lit(description).alias("description"), F.col("line").cast("long").alias("pos")
    )


def empty_catches(files: DataFrame) -> DataFrame:
    """Catch blocks without a statement as issues, LOW; a block of comments alone is empty."""
    return empty_catches_of(code.segments(files))


def empty_catches_of(segs: DataFrame) -> DataFrame:
    """The same from segments."""
    after = F.lead(F.struct("mark", "head")).over(Window.partitionBy("project_id", "file_path").orderBy("seq"))
    rows = segs.withColumn("after", after)
    rows = rows.filter((F.col("mark") == "{") & F.col("head").rlike(r"\bcatch ?\([^()]*\)$") & (F.col("after.mark") == "}") & (F.col("after.head") == ""))
    return found_at(rows, "EMPTY-CATCH", "ROBUSTNESS", "LOW", "empty catch block")


def literal_equals(files: DataFrame) -> DataFrame:
    """Calls of equals on a name or field with a literal as their one argument as issues, MEDIUM, once a line."""
    call = r"(^|[^\w.)\]\x22])([A-Za-z_]\w*\.)*(?!super\b|this\.equals)[A-Za-z_]\w*\s*\.\s*equals\(\s*(\x22\x22|-?[0-9][\w.]*|true|false|null)\s*\)"
    rows = lines(files, code.blanked(F.col("content"))).filter(F.col("text").rlike(call))
    return found_at(rows, "LITERAL-EQUALS", "ROBUSTNESS", "MEDIUM", "equals on a name that may be null")


def outline(files: DataFrame, most: int = 24) -> DataFrame:
    """The first type of each file, and its methods by pattern: constructors first, the first of each name, at most ``most`` a file, with line and parameters."""
    pattern = r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:[\w<>\[\],.? ]+\s+)?(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"
    rows = lines(files).withColumns({"name": F.regexp_extract("text", pattern, 1), "parameters": F.regexp_extract("text", pattern, 2)}).filter("name <> ''")
    first = rows.groupBy("project_id", "file_path", "name").agg(F.min_by(F.struct("line", "parameters"), "line").alias("m"))
    type_line = r"^\s*(?:[\w@]+\s+)*(?:class|interface|enum|record)\s+(\w+)"
    types = lines(files).withColumn("type", F.regexp_extract("text", type_line, 1)).filter("type <> ''").groupBy("project_id", "file_path").agg(F.min_by("type", "line").alias("type"))
    first = first.join(types, ["project_id", "file_path"], "left")
    nth = F.row_number().over(Window.partitionBy("project_id", "file_path").orderBy(F.col("name") != F.coalesce("type", F.lit("")), "m.line"))
    first = first.withColumn("nth", nth).filter(F.col("nth") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "m.line", "name", "m.parameters"))), lambda x: F.struct(x.line.alias("line"), x["name"].alias("name"), x.parameters.alias("parameters")))
    return first.groupBy("project_id", "file_path").agg(F.first("type").alias("type"), listed.alias("methods"))


def symbol_lines(text_lines: DataFrame, symbol: str) -> DataFrame:
    """The first line of each file that holds a symbol as a word."""
    hits = text_lines.filter(F.col("text").rlike(rf"\b{symbol}\b"))
    return hits.groupBy("project_id", "file_path").agg(F.min("line").alias("line"))


def best_symbol(text_lines: DataFrame, symbol: str, most: int = 48) -> DataFrame:
    """Per project the best place of a symbol: files named like it first, then by path; the first ``most`` candidates count. No project is one task."""
    rank = F.when(F.contains(F.col("file_path"), F.lit(f"/{symbol}.")), 0).when(F.contains(F.lower("file_path"), F.lit(symbol.lower())), 1).otherwise(2)
    files = text_lines.select("project_id", "file_path").distinct().withColumn("rank", rank)
    first = ranked(files, ["project_id"], ["rank", "file_path"]).filter(F.col("nth") <= most)
    rows = symbol_lines(text_lines, symbol).join(first, ["project_id", "file_path"])
    best = rows.groupBy("project_id").agg(F.min(F.struct("rank", "file_path", "line")).alias("b"))
    return best.select("project_id", "b.file_path", "b.line")


def diffs(pairs: DataFrame) -> DataFrame:
    """One hunk per pair of texts (id, before, after): where it starts, and the lines left and right of it that differ."""
    a, b = F.split("before", "\n"), F.split("after", "\n")
    rows = pairs.withColumns({"a": a, "b": b})

    def same(x: F.Column, y: F.Column) -> F.Column:
        """Elements that two arrays share at their start."""
        n = F.least(F.size(x), F.size(y))
        differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: ~F.get(x, k - 1).eqNullSafe(F.get(y, k - 1)))
        return F.least(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n), n)

    rows = rows.withColumn("head", same(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.reverse(c), F.lit(1), F.size(c) - F.col("head"))
    rows = rows.withColumns({"ra": rest(F.col("a")), "rb": rest(F.col("b"))})
    rows = rows.withColumn("tail", same(F.col("ra"), F.col("rb")))
    cut = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head") - F.col("tail"))
    return rows.select("id", (F.col("head") + 1).alias("start"), cut(F.col("a")).alias("removed"), cut(F.col("b")).alias("added")).filter("size(removed) + size(added) > 0")


def suggested_code(replies: DataFrame) -> DataFrame:
    """Code of a reply: the first fenced block, else the last inline span that looks like code."""
    fenced = F.nullif(F.regexp_extract("content", r"(?s)```[a-zA-Z]*\n(.*?)```", 1), F.lit(""))
    spans = F.filter(F.regexp_extract_all("content", F.lit("`([^`\n]+)`"), F.lit(1)), lambda s: s.rlike(r"[(){};=.]"))
    return replies.withColumn("code", F.coalesce(fenced, F.try_element_at(spans, F.lit(-1))))


def sections(replies: DataFrame, mark: str = "[①②③④⑤]", least: int = 2) -> DataFrame:
    """Replies with what stands between marks, blank parts left out; null under ``least`` parts."""
    parts = F.filter(F.transform(F.split("content", mark), lambda s: F.trim(s)), lambda s: s != "")
    return replies.withColumn("sections", F.when(F.size(parts) >= least, parts))


def last_actions(messages: DataFrame, marker: str, types: list[str], most: int = 3) -> DataFrame:
    """Actions, a JSON list after the last marker of a message: known types, the first few."""
    parsed = F.from_json(F.substring_index("content", marker, -1), "array<struct<type: string, target: string, label: string>>")
    good = F.slice(F.filter(parsed, lambda a: a.type.isin(*types)), 1, most)
    return messages.withColumn("actions", F.when(F.contains(F.col("content"), F.lit(marker)), F.coalesce(good, F.array().cast("array<struct<type: string, target: string, label: string>>"))))


ACTION = "type: string, scope: string, summary: string, filePath: string, symbol: string, line: string, clarifyQuestion: string, options: array<struct<id: string, label: string>>"


def agent_actions(messages: DataFrame, marker: str = L.ACTION_MARKER) -> DataFrame:
    """Actions that messages (id, content) ask for in a JSON list after the last marker: a row for each of the first three valid ones, in order.

    (id, nth, type, scope, summary, needs_confirmation, file_path, symbol, line,
    question, options). JAVADOC takes an unknown scope as file; NAVIGATE needs
    a file or a symbol, and its line must be above 0 to count; CLARIFY needs
    two options with an id and a label, and the first four count. Texts are
    trimmed, long ones cut, missing summaries made up. A list that is not JSON
    has no actions.
    """
    after = F.trim(F.substring_index("content", marker, -1))
    parsed = F.from_json(after, f"array<struct<{ACTION.replace(': ', ':')}>>")
    rows = messages.filter(F.contains(F.col("content"), F.lit(marker))).select("id", F.posexplode(parsed).alias("at", "a")).filter("a is not null")
    text = lambda c: F.coalesce(F.trim(F.col(f"a.{c}")), F.lit(""))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    rows = rows.select("id", "at", F.upper(text("type")).alias("type"), F.lower(text("scope")).alias("scope"), cut(text("summary"), L.SUMMARY_WIDTH).alias("summary"), text("filePath").alias("file"), text("symbol").alias("symbol"), F.col("a.line").alias("raw"), text("clarifyQuestion").alias("question"), F.col("a.options").alias("options"))
    good = F.filter(F.transform(F.coalesce("options", F.array().cast("array<struct<id: string, label: string>>")), lambda o: F.struct(F.trim(o.id).alias("id"), F.trim(o.label).alias("label"))), lambda o: (o.id != "") & (o.label != ""))
    good = F.transform(F.slice(good, 1, L.MOST_OPTIONS), lambda o: F.struct(o.id.alias("id"), cut(o.label, L.OPTION_WIDTH).alias("label")))
    rows = rows.withColumn("options", good)
    is_a = lambda t: F.col("type") == t
    valid = is_a("JAVADOC") | (is_a("NAVIGATE") & ((F.col("file") != "") | (F.col("symbol") != ""))) | (is_a("CLARIFY") & (F.size("options") >= L.LEAST_OPTIONS))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("at"))  # the actions of one message
    rows = rows.filter(valid).withColumn("nth", nth).filter(F.col("nth") <= L.MOST_ACTIONS)
    scope = F.when(is_a("JAVADOC"), F.when(F.col("scope").isin(*L.ACTION_SCOPES), F.col("scope")).otherwise("file")).otherwise("")
    asks = F.when(F.col("question") != "", F.col("question")).when(F.col("summary") != "", F.col("summary")).otherwise(L.CLARIFY_QUESTION)
    short = F.when(F.length("file") <= L.PATH_WIDTH, F.col("file")).otherwise(F.concat(F.lit("…"), F.right("file", F.lit(L.PATH_END))))
    opens = F.when(F.col("symbol") == "", F.concat(F.lit(L.OPEN_FILE), short)).otherwise(F.concat(F.lit(L.GO_TO), "symbol"))
    summary = F.when(F.col("summary") != "", F.col("summary")).when(is_a("JAVADOC"), L.JAVADOC_SUMMARY).when(is_a("NAVIGATE"), opens).otherwise(asks)
    line = F.expr("try_cast(trim(raw) AS INT)")
    to = lambda t, c: F.when(is_a(t), c)
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        "id", F.col("nth").cast("long").alias("nth"), "type", scope.alias("scope"), summary.alias("summary"), (~is_a("CLARIFY")).alias("needs_confirmation"), to("NAVIGATE", none("file")).alias("file_path"),
        to("NAVIGATE", none("symbol")).alias("symbol"), to("NAVIGATE", F.when(line > 0, line)).alias("line"), to("CLARIFY", asks).alias("question"), to("CLARIFY", F.col("options")).alias("options"),
    )


def model_suggestions(replies: DataFrame, targets: DataFrame) -> DataFrame:
    """Suggestions in replies (project_id, reply_id, content), each a JSON list that may stand in a fence or in text.

    Entries with a blank field and unknown issues are dropped; of several for
    an issue in a reply the last counts. targets: (project_id, issue_key).
    """
    bare = F.trim("content")
    fenced = F.regexp_extract(bare, r"(?s)^```[^\n]*\n(.*)```", 1)
    bare = F.when(fenced != "", F.trim(fenced)).otherwise(bare)
    listed = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(F.when(listed != "", listed).otherwise(bare), "array<struct<issueKey: string, suggestion: string, rationale: string>>")
    rows = replies.select("project_id", "reply_id", F.posexplode(parsed).alias("nth", "x"))
    rows = rows.select("project_id", "reply_id", "nth", F.col("x.issueKey").alias("issue_key"), "x.suggestion", "x.rationale")
    for c in ("issue_key", "suggestion", "rationale"):
        rows = rows.filter(F.coalesce(F.trim(c), F.lit("")) != "")
    rows = rows.join(targets.select("project_id", "issue_key").distinct(), ["project_id", "issue_key"], "left_semi")
    last = F.max_by(F.struct("suggestion", "rationale"), "nth").alias("s")
    return rows.groupBy("project_id", "reply_id", "issue_key").agg(last).select("project_id", "reply_id", "issue_key", "s.*")


def comment_gaps(comments: DataFrame) -> DataFrame:
    """What method comments (id, comment, parameters, needs_return) lack: (id, missing), a row for each tag, and ``block`` for what is no comment block."""
    is_block = F.trim("comment").rlike(r"(?s)^/\*\*.*\*/$")
    tags = F.transform("parameters", lambda p: F.concat(F.lit("@param "), p))
    tags = F.concat(tags, F.when(F.col("needs_return"), F.array(F.lit("@return"))).otherwise(F.array().cast("array<string>")))
    lacking = F.when(is_block, F.filter(tags, lambda t: ~F.contains(F.col("comment"), t))).otherwise(F.array(F.lit("block")))
    return comments.select("id", F.explode(lacking).alias("missing"))
