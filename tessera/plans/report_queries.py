"""Queries whose result is what a reader sees: reports with traces, advice, outlines, places and orders, compared in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import evaluate, facts, files, graph, issues, sessions, stack
from .code_queries import LINES as METHOD_LINES
from .code_queries import S, U, sources
from .queries import BASE, EXT, LINES, MATCHED, METRIC_ROWS, REACH, lines_of, listed, query, tech_names

# --- M12: a run's failures are the errors of a user ---------------------------

FAILURES = "(SELECT user_id AS sample_id, event_id AS pos, 'N' || CAST(event_id % 9 AS STRING) AS node, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS message, CASE WHEN value >= 60 THEN 'slow' END AS detail FROM {events} WHERE event_type = 'error')"
TABLE = " || ".join(f"format('| {m} | {{{{:.2f}}}} |', {m}) || chr(10)" for m in evaluate.METRICS)


@query(f"""WITH f AS (SELECT sample_id, pos, node, message, coalesce(detail, '') AS detail FROM {FAILURES} WHERE trim(message) <> ''),
  t AS (SELECT sample_id, CAST(to_json(list(struct_pack(node := node, message := message, detail := detail) ORDER BY pos)) AS STRING) AS trace,
    string_agg('- **' || node || '**: ' || message || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END || chr(10), '' ORDER BY pos) AS said FROM f GROUP BY 1)
  SELECT m.sample_id, CASE WHEN t.said IS NULL THEN 'PASSED' ELSE 'FAILED' END AS status, coalesce(t.trace, '[]') AS trace, '# Evaluation report' || chr(10) || chr(10) || '- data set: v1' || chr(10) || '- sample: ' || CAST(m.sample_id AS STRING) || chr(10)
  || '- status: ' || CASE WHEN t.said IS NULL THEN 'PASSED' ELSE 'FAILED' END || chr(10) || chr(10) || '## Metrics' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|---|---|' || chr(10) || {TABLE}
  || chr(10) || '## Failures' || chr(10) || chr(10) || coalesce(t.said, 'none' || chr(10)) AS markdown FROM {METRIC_ROWS} m LEFT JOIN t ON t.sample_id = m.sample_id""")
def m12_full_reports(v):
    message = F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("props"))
    node = F.concat(F.lit("N"), (F.col("event_id") % 9).cast("string"))
    failed = v("events").filter("event_type = 'error'").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("pos"), node.alias("node"), message.alias("message"), F.when(F.col("value") >= 60, "slow").alias("detail"))
    return evaluate.full_reports(evaluate.metrics(v("v_expected"), v("v_observed")), failed, "v1").select("sample_id", "status", "trace", "markdown")


# --- W7, W13: places and orders -----------------------------------------------


@query(f"""WITH r AS (SELECT project_id, path AS file_path, CASE WHEN contains(path, '/de.') THEN 0 WHEN contains(lower(path), 'de') THEN 1 ELSE 2 END AS rank FROM {{v_files}} WHERE content IS NOT NULL),
  t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rank, file_path) AS nth FROM r),
  h AS (SELECT project_id, file_path, min(line) AS line FROM {LINES} WHERE regexp_matches(text, '\\bde\\b') GROUP BY ALL)
  SELECT t.project_id, arg_min(t.file_path, nth) AS file_path, arg_min(line, nth) AS line FROM t JOIN h ON h.project_id = t.project_id AND h.file_path = t.file_path WHERE nth <= 48 GROUP BY 1""")
def w7_symbol_place(v):
    return facts.best_symbol(lines_of(v), "de").withColumn("line", F.col("line").cast("long"))


@query("""SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id DESC) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS nth FROM {conversations}""")
def w13_numbered(v):
    return sessions.numbered(v("conversations")).select("conv_id", "turn", "session", "nth")


# --- X18, X19 -----------------------------------------------------------------

TOLD = """(SELECT project_id, pos, file_path, line, CASE pos % 9 WHEN 0 THEN 'null-check' WHEN 1 THEN 'dead.code' WHEN 2 THEN 'Exception' WHEN 3 THEN 'conflict' ELSE rule_id END AS rule_id,
  CASE pos % 9 WHEN 4 THEN 'NPE at ' || description WHEN 5 THEN '死代码' WHEN 6 THEN 'catch ' || description WHEN 7 THEN '冲突 空指针' ELSE description END AS description, CASE WHEN pos % 4 = 0 THEN 'note ' || rule_id WHEN pos % 4 = 1 THEN ' ' END AS risk_note FROM {v_issues})"""


@query(f"""SELECT project_id, pos, CASE WHEN pos % 9 IN (0, 4, 7) THEN 'put the constant on the left of equals at ' || file_path || ':' || CAST(line AS STRING)
    WHEN pos % 9 IN (1, 5) THEN 'delete or call the unused code at ' || file_path || ':' || CAST(line AS STRING) WHEN pos % 9 IN (2, 6) THEN 'log or rethrow in the catch block at ' || file_path || ':' || CAST(line AS STRING)
    WHEN pos % 9 = 3 THEN 'make versions agree in ' || file_path ELSE 'change ' || file_path || ':' || CAST(line AS STRING) || ': ' || description END AS advice,
  CASE WHEN pos % 4 = 0 THEN risk_note ELSE 'by rule ' || rule_id END AS rationale FROM {TOLD}""")
def x18_advice_of_each_kind(v):
    way, own = F.col("pos") % 9, F.col("rule_id")
    rule = F.when(way == 0, "null-check").when(way == 1, "dead.code").when(way == 2, "Exception").when(way == 3, "conflict").otherwise(own)
    text = F.when(way == 4, F.concat(F.lit("NPE at "), "description")).when(way == 5, "死代码").when(way == 6, F.concat(F.lit("catch "), "description")).when(way == 7, "冲突 空指针").otherwise(F.col("description"))
    note = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("note "), own)).when(F.col("pos") % 4 == 1, " ")
    rows = v("v_issues").withColumns({"description": text, "risk_note": note, "rule_id": rule})
    return issues.advice(rows).select("project_id", "pos", "advice", "rationale")


@query(f"""WITH f AS (SELECT *, 'n' || n || '/S' || src || '.java' AS file_path FROM {S} JOIN {METHOD_LINES} USING (src))
  SELECT project_id, file_path, 1 AS nth, 6 + 2 * n_imports AS line, 'S' || src AS name, '' AS parameters FROM f UNION ALL
  SELECT f.project_id, f.file_path, 1 + u.i, 3 + 2 * n_imports + 4 * u.i, 'm' || u.k, 'int a, String... rest' FROM f JOIN (SELECT src, k, row_number() OVER (PARTITION BY src ORDER BY k) AS i FROM {U}) u USING (src) UNION ALL
  SELECT project_id, file_path, 2 + n_methods, 8 + 2 * n_imports + 4 * n_methods, 'odd', 'String s' FROM f""")
def x19_outline_methods(v):
    text = F.regexp_replace("content", r"(?m)^  void ", "  final void ")
    rows = facts.outline(sources(v).withColumn("content", text)).select("project_id", "file_path", F.posexplode("methods").alias("at", "m"))
    return rows.select("project_id", "file_path", (F.col("at") + 1).cast("long").alias("nth"), F.col("m.line").cast("long").alias("line"), F.col("m.name").alias("name"), F.col("m.parameters").alias("parameters"))


# --- U3, P1 -------------------------------------------------------------------


@query(f"""{REACH} SELECT DISTINCT project_id, 'module' AS kind, CAST(node AS STRING) AS name FROM c UNION ALL SELECT DISTINCT project_id, 'file', file_path FROM {{v_issues}}
  UNION ALL SELECT DISTINCT project_id, 'stack', stack FROM (WITH {MATCHED} SELECT * FROM m) WHERE trim(stack) <> ''""")
def u3_involved(v):
    parts = [issues.involved(graph.components(v("v_edges")), "module", "node"), issues.involved(v("v_issues"), "file", "file_path"), issues.involved(stack.technologies(tech_names(v))[0], "stack", "stack")]
    return issues.union([p.withColumn("project_id", F.col("project_id").cast("long")) for p in parts])


MOVED = """(SELECT project_id, CASE size % 11 WHEN 0 THEN 'Node_Modules/' || path WHEN 1 THEN path || '/Thumbs.DB' WHEN 2 THEN path || '.JAR' WHEN 3 THEN 'src/build/' || path WHEN 5 THEN 'builder/' || path WHEN 6 THEN path || '/target' ELSE path END AS path,
  CASE WHEN size % 11 = 4 THEN size * 3000 ELSE size END AS size FROM {v_files})"""


@query(f"""SELECT project_id, path FROM {MOVED} WHERE NOT list_has_any(string_split(lower(regexp_replace(path, '/?[^/]*$', '')), '/'), [{listed(L.EXCLUDED_DIRS)}]) AND lower({BASE}) NOT IN ({listed(L.EXCLUDED_NAMES)})
  AND {EXT} NOT IN ({listed(L.EXCLUDED_EXTENSIONS)}) AND size <= {L.MAX_FILE_SIZE}""")
def p1_kept_of_all_kinds(v):
    way, path = F.col("size") % 11, F.col("path")
    put = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    moved = F.when(way == 0, put("Node_Modules/", path)).when(way == 1, put(path, "/Thumbs.DB")).when(way == 2, put(path, ".JAR")).when(way == 3, put("src/build/", path)).when(way == 5, put("builder/", path)).when(way == 6, put(path, "/target")).otherwise(path)
    rows = v("v_files").withColumns({"path": moved, "size": F.when(way == 4, F.col("size") * 3000).otherwise(F.col("size"))})
    return files.kept(rows).select("project_id", "path")
