"""Queries over source text that is written from the tables: a class for each supplier, which uses the suppliers that its order lines name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, code, facts, graph, issues, links, manifests, scan
from ..sources import archives
from .queries import View, diverging, in_file, query

UNKNOWN = 99  # nation of a supplier that is not there


def sources(v: View) -> DataFrame:
    """Source files (project_id, file_path, content), one for each supplier with order lines."""
    nation = v("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("string").alias("nation"))
    uses = v("v_uses").join(nation.select(F.col("key").alias("src"), "nation"), "src")
    uses = uses.join(nation.select(F.col("key").alias("dst"), F.col("nation").alias("far")), "dst", "left").withColumn("far", F.coalesce("far", F.lit(str(UNKNOWN))))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    src, dst, k, far = map(F.col, ("src", "dst", "k", "far"))
    way = k % 4
    says = F.when(way == 0, text("f", k, ".go(1);")).when(way == 1, text("S", dst, '.make("a(b");')).when(way == 2, text("this.m", k, "(2);")).otherwise(text("m", k, "(3);"))
    parts = uses.select(
        "project_id", "src", "nation", "k",
        F.when(way == 0, text("import n", far, ".S", dst, ";\n")).alias("import"),
        F.when(way == 0, text("  private S", dst, " f", k, " = new S", dst, "();\n")).alias("field"),
        text("  void m", k, "(int a, String... rest) throws Err {\n    // call() {\n    ", says, "\n  }\n").alias("method"),
    )
    column = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: F.coalesce(x[c], F.lit(""))), "").alias(c)
    rows = parts.groupBy("project_id", "src", "nation").agg(*[column(c) for c in ("import", "field", "method")])  # seven at most
    up = F.floor(src / 2)
    content = text(
        "package n", F.col("nation"), ";\n", F.col("import"), '/* a { comment\n */\n@Mark("x{")\npublic class S', src, " extends S", up, " implements Runnable {\n", F.col("field"),
        "  public S", src, "() { super(); }\n", F.col("method"), "  static class In { void deep() { S", src, ".stat(1); } }\n",
        "  void odd(String s) {\n    try { s.trim(); } catch (Err e) { /* no { */ }\n    if (s.equals(\"a\") || \"b\".equals(s) || s.trim().equals(\"c\")) { s = null; }\n  }\n}\n",
    )
    return rows.select("project_id", text("n", F.col("nation"), "/S", src, ".java").alias("file_path"), content.alias("content"))


def found(v: View) -> code.Facts:
    return code.extractor("java")(sources(v))


S = """(SELECT DISTINCT u.project_id, u.src, s.s_nationkey AS n FROM {v_uses} u JOIN {supplier} s ON s.s_suppkey = u.src)"""
U = """(SELECT u.project_id, u.src, u.k, u.dst, s.s_nationkey AS n, coalesce(t.s_nationkey, 99) AS far, t.s_suppkey IS NOT NULL AND EXISTS (SELECT 1 FROM {v_uses} x WHERE x.src = u.dst) AS there
  FROM {v_uses} u JOIN {supplier} s ON s.s_suppkey = u.src LEFT JOIN {supplier} t ON t.s_suppkey = u.dst)"""
IMPORTS = f"(SELECT DISTINCT src, dst, far FROM {U} WHERE k % 4 = 0)"
LINES = f"(SELECT src, count(*) FILTER (k % 4 = 0) AS n_imports, count(*) AS n_methods FROM {U} GROUP BY 1)"
OWN = "'n' || n || '.S' || src"


@query(f"""SELECT project_id, {OWN} AS qualified, 'CLASS' AS kind, 'S' || src // 2 AS super_class, 'Runnable' AS interfaces, NULL AS enclosing, 4 + n_imports AS start_line, 12 + 2 * n_imports + 4 * n_methods AS end_line, 'Mark' AS annotations, 'public' AS modifiers
  FROM {S} JOIN {LINES} USING (src) UNION ALL SELECT project_id, {OWN} || '.In', 'CLASS', NULL, '', {OWN}, 7 + 2 * n_imports + 4 * n_methods, 7 + 2 * n_imports + 4 * n_methods, '', 'static' FROM {S} JOIN {LINES} USING (src)""")
def x2_types(v):
    rows = found(v).types.withColumns({c: F.array_join(c, ",") for c in ("interfaces", "annotations", "modifiers")})
    return rows.select("project_id", "qualified", "kind", "super_class", "interfaces", "enclosing", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "annotations", "modifiers")


METHODS = f"""(SELECT project_id, {OWN} AS owner, 'm' || k AS name, 'void' AS return_type, 'm' || k || '(int, String...)' AS signature, 'Err' AS thrown FROM {U} UNION ALL SELECT project_id, {OWN}, '<init>', NULL, '<init>()', '' FROM {S}
  UNION ALL SELECT project_id, {OWN} || '.In', 'deep', 'void', 'deep()', '' FROM {S} UNION ALL SELECT project_id, {OWN}, 'odd', 'void', 'odd(String)', '' FROM {S})"""


@query(f"SELECT *, true AS has_body FROM {METHODS}")
def x3_f11_methods(v):
    rows = code.signatures(found(v).methods)
    return rows.select("project_id", "owner", "name", "return_type", "signature", F.array_join("thrown", ",").alias("thrown"), "has_body")


SITES = f"""(SELECT project_id, src, {OWN} AS caller_owner, '<initializer>' AS caller_method, 'TYPE' AS receiver_kind, 'S' || dst AS receiver_type, 'S' || dst AS callee, 'CONSTRUCTOR' AS call_kind, dst FROM {U} WHERE k % 4 = 0
  UNION ALL SELECT project_id, src, {OWN}, 'm' || k, CASE k % 4 WHEN 0 THEN 'VARIABLE' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'THIS' ELSE 'NONE' END, CASE WHEN k % 4 < 2 THEN 'S' || dst END,
    CASE k % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'make' ELSE 'm' || k END, 'METHOD', CASE WHEN k % 4 < 2 THEN dst END FROM {U}
  UNION ALL SELECT project_id, src, {OWN}, '<init>', 'SUPER', NULL, '<init>', 'CONSTRUCTOR_DELEGATION', NULL FROM {S}
  UNION ALL SELECT project_id, src, {OWN} || '.In', 'deep', 'TYPE', 'S' || src, 'stat', 'METHOD', src FROM {S}
  UNION ALL SELECT project_id, src, {OWN}, 'odd', r, CASE r WHEN 'VARIABLE' THEN 'String' END, c, 'METHOD', NULL FROM {S},
    (SELECT unnest(['VARIABLE', 'VARIABLE', 'UNRESOLVED', 'VARIABLE', 'UNRESOLVED']) AS r, unnest(['trim', 'equals', 'equals', 'trim', 'equals']) AS c))"""


@query(f"SELECT project_id, caller_owner, caller_method, receiver_kind, receiver_type, callee, call_kind FROM {SITES}")
def x4_call_sites(v):
    return found(v).call_sites.select("project_id", "caller_owner", "caller_method", "receiver_kind", "receiver_type", "callee", "call_kind")


@query(f"""SELECT project_id, 'n' || n || '/S' || src || '.java' AS file_path, 'n' || n AS package, 'n' || far || '.S' || dst AS imported, false AS is_static, false AS is_wildcard FROM {U} WHERE k % 4 = 0""")
def x1_imports(v):
    f = found(v)
    return f.imports.join(f.packages, code.FILE).select("project_id", "file_path", "package", "imported", "is_static", "is_wildcard")


RESOLVED = f"""(SELECT c.*, CASE WHEN receiver_kind IN ('NONE', 'THIS') THEN c.caller_owner WHEN c.dst = c.src THEN s.own WHEN i.dst IS NOT NULL THEN 'n' || i.far || '.S' || i.dst WHEN t.n = s.n THEN t.own END AS callee_owner
  FROM {SITES} c JOIN (SELECT *, {OWN} AS own FROM {S}) s ON s.src = c.src LEFT JOIN {IMPORTS} i ON i.src = c.src AND i.dst = c.dst LEFT JOIN (SELECT *, {OWN} AS own FROM {S}) t ON t.src = c.dst AND t.project_id = c.project_id)"""


@query(f"SELECT project_id, caller_owner, caller_method, receiver_kind, callee, call_kind, callee_owner FROM {RESOLVED}")
def j1_j2_callee_owners(v):
    return code.resolved(found(v)).select("project_id", "caller_owner", "caller_method", "receiver_kind", "callee", "call_kind", "callee_owner")


@query(f"SELECT project_id, count(*) AS files, 2 * count(*) AS types, CAST(sum(n_methods) + 3 * count(*) AS BIGINT) AS methods FROM {S} JOIN {LINES} USING (src) GROUP BY 1")
def g25_totals(v):
    return code.totals(sources(v), found(v))


@query(f"""SELECT project_id, 'top_level' AS listing, {OWN} AS name FROM {S} UNION ALL SELECT project_id, 'nested', {OWN} || '.In' FROM {S} UNION ALL SELECT project_id, 'constructors', {OWN} || '#<init>' FROM {S}
  UNION ALL SELECT project_id, 'methods', owner || '#' || name FROM {METHODS} WHERE name <> '<init>'""")
def g28_listings(v):
    f = found(v)
    parts = []
    for what in ("top_level", "nested", "constructors", "methods"):
        name = F.col("qualified") if what in ("top_level", "nested") else F.concat("owner", F.lit("#"), "name")
        parts.append(code.listing(f, what).select("project_id", F.lit(what).alias("listing"), name.alias("name")))
    return code.union_of(parts)


@query(f"""SELECT project_id, 'n' || n AS module, min('n' || n || '/S' || src || '.java') AS file_path, arg_min(CAST(4 + n_imports AS BIGINT), 'n' || n || '/S' || src || '.java') AS line,
  arg_min('n' || n || '.S' || src, 'n' || n || '/S' || src || '.java') AS qualified FROM {S} JOIN {LINES} USING (src) GROUP BY ALL""")
def j18_anchors(v):
    return graph.anchors(found(v).types, "package").withColumn("line", F.col("line").cast("long"))


def layer_of(package):
    return F.concat(F.lit("r"), (F.regexp_extract(package, r"(\d+)", 1).cast("int") % 5).cast("string"))


#: Sites that are resolved: no class declares go, make or stat, so of calls of the project's own types only constructors and own methods are.
OPEN = f"""(callee_owner IS NULL OR (call_kind <> 'CONSTRUCTOR' AND receiver_kind NOT IN ('NONE', 'THIS') AND (project_id, callee_owner) IN (SELECT (project_id, {OWN}) FROM {S})))"""
LINKED = f"(SELECT * FROM {RESOLVED} WHERE NOT {OPEN})"
CYCLES = f"""WITH RECURSIVE t AS (SELECT project_id, {OWN} AS type, 'n' || n AS package, 'r' || n % 5 AS layer FROM {S} UNION ALL SELECT project_id, {OWN} || '.In', 'n' || n, 'r' || n % 5 FROM {S}),
  e AS (SELECT DISTINCT project_id, caller_owner AS src, callee_owner AS dst FROM {LINKED}),
  m AS (SELECT DISTINCT e.project_id AS p, 'layer' AS grain, a.layer AS src, b.layer AS dst FROM e JOIN t a ON a.project_id = e.project_id AND a.type = e.src JOIN t b ON b.project_id = e.project_id AND b.type = e.dst WHERE a.layer <> b.layer
    UNION SELECT DISTINCT e.project_id, 'package', a.package, b.package FROM e JOIN t a ON a.project_id = e.project_id AND a.type = e.src JOIN t b ON b.project_id = e.project_id AND b.type = e.dst WHERE a.package <> b.package),
  r(p, grain, a, b) AS (SELECT p, grain, src, dst FROM m UNION SELECT r.p, r.grain, r.a, m.dst FROM r JOIN m ON m.p = r.p AND m.grain = r.grain AND m.src = r.b),
  c AS (SELECT x.p, x.grain, x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.p = y.p AND x.grain = y.grain AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.p, x.grain, x.a),
  i AS (SELECT m.p, m.grain, x.component, m.src, m.dst FROM m JOIN c x ON x.p = m.p AND x.grain = m.grain AND x.node = m.src JOIN c y ON y.p = m.p AND y.grain = m.grain AND y.node = m.dst WHERE x.component = y.component),
  w(p, grain, component, place, path, n) AS (SELECT DISTINCT p, grain, component, component, [component], 0 FROM c
    UNION ALL SELECT w.p, w.grain, w.component, i.dst, list_append(min(w.path), i.dst), any_value(w.n) + 1 FROM w JOIN i ON i.p = w.p AND i.grain = w.grain AND i.component = w.component AND i.src = w.place
    WHERE w.n < 40 AND (w.n = 0 OR w.place <> w.component) GROUP BY w.p, w.grain, w.component, i.dst),
  b AS (SELECT p, grain, component, min(n) AS length, arg_min(path, n) AS path FROM w WHERE n > 0 AND place = component GROUP BY p, grain, component),
  d AS (SELECT DISTINCT e.project_id AS p, g.grain, CASE g.grain WHEN 'layer' THEN x.layer ELSE x.package END AS src, CASE g.grain WHEN 'layer' THEN y.layer ELSE y.package END AS dst, e.src AS src_type, e.dst AS dst_type, q.file_path, q.line
    FROM e JOIN t x ON x.project_id = e.project_id AND x.type = e.src JOIN t y ON y.project_id = e.project_id AND y.type = e.dst
    JOIN (SELECT project_id, {OWN} AS type, 'n' || n || '/S' || src || '.java' AS file_path, CAST(4 + n_imports AS BIGINT) AS line FROM {S} JOIN {LINES} USING (src)) q ON q.project_id = e.project_id AND q.type = e.src, (SELECT unnest(['layer', 'package']) AS grain) g),
  s AS (SELECT b.p, b.grain, b.component, k.k AS step, b.path[k.k] AS src, b.path[k.k + 1] AS dst FROM b, (SELECT unnest(range(1, 41)) AS k) k WHERE k.k <= b.length),
  m2 AS (SELECT s.p, s.grain, s.component, s.step, d.src_type, d.dst_type, d.file_path, d.line FROM s JOIN d ON d.p = s.p AND d.grain = s.grain AND d.src = s.src AND d.dst = s.dst)"""


@query(f"""SELECT r.project_id, 'n' || s.n || '/S' || r.src || '.java' AS file_path, CAST(CASE caller_method WHEN '<init>' THEN 6 + 2 * n_imports WHEN 'deep' THEN 7 + 2 * n_imports + 4 * n_methods
    WHEN 'odd' THEN CASE WHEN callee = 'trim' AND nth = 1 THEN 9 ELSE 10 END + 2 * n_imports + 4 * n_methods ELSE 9 + 2 * n_imports + 4 * before END AS BIGINT) AS line, caller_method, callee
  FROM (SELECT *, row_number() OVER (PARTITION BY src, caller_owner, caller_method, callee) AS nth, (SELECT count(*) FROM {{v_uses}} x WHERE x.src = q.src AND 'm' || x.k < q.caller_method) AS before FROM {RESOLVED} q WHERE {OPEN}) r
  JOIN {S} s ON s.src = r.src JOIN {LINES} l ON l.src = r.src""")
def j5_unresolved_sites(v):
    rows = code.unresolved(code.linked(found(v)))
    return rows.select("project_id", "file_path", F.col("line").cast("long").alias("line"), "caller_method", "callee")


@query(CYCLES + """
  SELECT b.p AS project_id, b.grain, CASE b.grain WHEN 'layer' THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, CAST(b.length AS BIGINT) AS length, array_to_string(b.path, ' -> ') AS description, f.file_path, f.line
  FROM b JOIN (SELECT p, grain, component, arg_min(file_path, (src_type, dst_type)) AS file_path, arg_min(line, (src_type, dst_type)) AS line FROM m2 WHERE step = 1 GROUP BY ALL) f ON f.p = b.p AND f.grain = b.grain AND f.component = b.component""")
def i5_cycle_findings(v):
    return cycles(v)[0].select("project_id", "grain", "risk_level", "length", "description", "file_path", F.col("line").cast("long").alias("line"))


@query(CYCLES + " SELECT DISTINCT p AS project_id, grain, component, CAST(step - 1 AS BIGINT) AS step, file_path FROM m2")
def i5_cycle_files(v):
    return cycles(v)[1].withColumn("step", F.col("step").cast("long"))


def cycles(v: View) -> tuple[DataFrame, DataFrame]:
    f = code.held(found(v))
    sites = code.linked(f).filter("declaring <> caller_owner")
    edges = sites.select("project_id", F.col("caller_owner").alias("src"), F.col("declaring").alias("dst"), "file_path").distinct()
    return graph.cycle_findings(edges, f.types.withColumn("layer", layer_of(F.col("package"))), {"layer": "HIGH", "package": "MEDIUM"})


@query(f"""SELECT project_id, 'EMPTY-CATCH' AS rule_id, 'LOW' AS risk_level, 'n' || n || '/S' || src || '.java' AS file_path, CAST(9 + 2 * n_imports + 4 * n_methods AS BIGINT) AS line FROM {S} JOIN {LINES} USING (src)
  UNION ALL SELECT project_id, 'LITERAL-EQUALS', 'MEDIUM', 'n' || n || '/S' || src || '.java', 10 + 2 * n_imports + 4 * n_methods FROM {S} JOIN {LINES} USING (src)""")
def r3_r4_located(v):
    rules = issues.Rules([issues.Rule("EMPTY-CATCH", "ROBUSTNESS", "LOW", facts.empty_catches), issues.Rule("LITERAL-EQUALS", "ROBUSTNESS", "MEDIUM", facts.literal_equals)])
    return rules.audit(sources(v)).select("project_id", "rule_id", "risk_level", "file_path", F.col("line").cast("long"))


@query(f"""SELECT project_id, 'n' || n || '/S' || src || '.java' AS file_path, 'S' || src AS type, 2 + n_methods AS n, 'S' || src AS first FROM {S} JOIN {LINES} USING (src)""")
def x19_outline(v):
    text = F.regexp_replace("content", r"(?m)^  void ", "  final void ")
    rows = facts.outline(sources(v).withColumn("content", text))
    return rows.select("project_id", "file_path", "type", F.size("methods").cast("long").alias("n"), F.col("methods")[0]["name"].alias("first"))


# --- manifests, archives, replies and comments written from the same uses --------------------------------


def packages_json(v: View) -> DataFrame:
    """A package.json for each supplier: what it uses under an odd place as a dependency, the rest for development."""
    pair = F.concat(F.lit('"s'), F.col("dst").cast("string"), F.lit("k"), F.col("k").cast("string"), F.lit('": "'), F.when(F.col("k") % 3 == 0, "^").when(F.col("k") % 3 == 1, ">= ").otherwise(""), F.col("weight").cast("string"), F.lit('.0"'))
    block = lambda odd: F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") % 2 == odd, pair))), ", ")  # noqa: E731  (seven at most)
    rows = v("v_uses").groupBy("project_id", "src").agg(block(1).alias("use"), block(0).alias("dev"))
    text = F.concat(F.lit('{"name": "x", "dependencies": {'), "use", F.lit('}, "devDependencies": {'), "dev", F.lit('}, "scripts": {"a": "1"}}'))
    return rows.select("project_id", F.concat(F.col("src").cast("string"), F.lit("/package.json")).alias("file_path"), text.alias("content"))


@query("""SELECT project_id, CAST(src AS STRING) || '/package.json' AS file_path, CASE WHEN k % 2 = 1 THEN 'dependencies' ELSE 'devDependencies' END AS block, 's' || dst || 'k' || k AS name, weight || '.0' AS version FROM {v_uses}""")
def x8_npm_packages(v):
    return manifests.npm_packages(packages_json(v))


REQUIREMENTS = """(SELECT l_orderkey % 10 AS project_id, CAST(l_orderkey AS STRING) AS file_path, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'p' || CAST(l_partkey % 400 AS STRING) END AS name,
  CASE WHEN l_returnflag = 'N' THEN '==1.' || CAST(l_suppkey % 2 AS STRING) WHEN l_returnflag = 'A' THEN CASE WHEN l_suppkey % 9 = 0 THEN '=2' ELSE '>=1' END END AS "constraint", CASE WHEN l_suppkey % 5 = 0 THEN 'os' END AS marker FROM {lineitem})"""


def requirement_sql(rows: str) -> str:
    good = f"""(SELECT *, CASE WHEN regexp_matches("constraint", '^==[0-9][0-9.]*$') AND marker IS NULL THEN substring("constraint", 3) END AS version FROM {rows} WHERE name <> '')"""
    return f"""WITH g AS {good}, s AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path, name, coalesce("constraint", '') ORDER BY line) AS nth FROM g),
  p AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path, name ORDER BY line) AS nth FROM g WHERE version IS NOT NULL), f AS (SELECT project_id, file_path, name, count(DISTINCT version) AS n FROM p GROUP BY ALL),
  d AS (SELECT project_id, name FROM p GROUP BY ALL HAVING count(DISTINCT version) > 1)
  SELECT project_id, 'INVALID' AS rule_id, 'MEDIUM' AS risk_level, file_path, line, name FROM {rows} WHERE name = '' OR "constraint" = '=2'
  UNION ALL SELECT project_id, 'DUPLICATE', 'LOW', file_path, line, name FROM s WHERE nth = 2
  UNION ALL SELECT p.project_id, 'CONFLICT', 'HIGH', p.file_path, p.line, p.name FROM p JOIN f USING (project_id, file_path, name) WHERE nth = 2 AND n > 1
  UNION ALL SELECT project_id, 'CONFLICT', 'MEDIUM', first.file_path, first.line, name FROM (SELECT project_id, name, min({{{{'file_path': file_path, 'line': line}}}}) AS first FROM p GROUP BY ALL) JOIN d USING (project_id, name)
    WHERE (project_id, name) NOT IN (SELECT (project_id, name) FROM f WHERE n > 1)"""


@query(requirement_sql(REQUIREMENTS))
def g13_f8_requirement_findings(v):
    rows = v("lineitem").select(
        (F.col("l_orderkey") % 10).alias("project_id"), F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_partkey") % 97 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 400).cast("string"))).alias("name"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("==1."), (F.col("l_suppkey") % 2).cast("string"))).when(F.col("l_returnflag") == "A", F.when(F.col("l_suppkey") % 9 == 0, "=2").otherwise(">=1")).alias("constraint"),
        F.when(F.col("l_suppkey") % 5 == 0, "os").alias("marker"),
    )
    return manifests.requirement_findings(rows)


NAMES = ("'ok/' || page_id || '.txt'", "'../' || page_id", "'/etc/' || page_id", "'C:/' || page_id", "'a/../../' || page_id", "'a/' || page_id || '?'", "'a/./..'", "' '")
REASONS = (None, "outside", "absolute", "absolute", "outside", "characters", "folder", "empty")


@query("SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(NAMES)) + " END AS entry, CASE page_id % 8 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(REASONS) if r) + " END AS reason FROM {pages}")
def s3_screened_entries(v):
    name = F.expr("CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(NAMES)) + " END")
    return v("pages").select("page_id", name.alias("entry"), archives.entry_reason(name).alias("reason"))


@query("""SELECT project_id, src AS reply_id, 'k' || dst AS issue_key, arg_max('fix ' || k, k) AS suggestion, 'for ' || dst AS rationale FROM {v_uses} WHERE k % 3 > 0 AND dst % 2 = 0 GROUP BY project_id, src, dst""")
def x13_model_suggestions(v):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    one = text('{"issueKey": "k', F.col("dst"), '", "suggestion": "', F.when(F.col("k") % 3 > 0, text("fix ", F.col("k"))).otherwise(" "), '", "rationale": "for ', F.col("dst"), '"}')
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", one.alias("one")))), lambda x: x.one), ", ")  # seven at most
    rows = v("v_uses").groupBy("project_id", F.col("src").alias("reply_id")).agg(listed.alias("l"))
    content = F.when(F.col("reply_id") % 2 == 0, text("```json\n[", F.col("l"), "]\n```")).otherwise(text("Here they are: [", F.col("l"), "]. Done."))
    targets = v("v_uses").filter("dst % 2 = 0").select("project_id", text("k", F.col("dst")).alias("issue_key"))
    return facts.model_suggestions(rows.select("project_id", "reply_id", content.alias("content")), targets)


@query("""SELECT src * 10 + k AS id, '@param b' AS missing FROM {v_uses} WHERE k % 3 = 1 UNION ALL SELECT src * 10 + k, '@return' FROM {v_uses} WHERE k % 3 = 1 AND dst % 2 = 0 UNION ALL SELECT src * 10 + k, 'block' FROM {v_uses} WHERE k % 3 = 2""")
def x17_comment_gaps(v):
    comment = F.when(F.col("k") % 3 == 0, "/** does it\n * @param a x\n * @param b y\n * @return z */").when(F.col("k") % 3 == 1, "/** @param a only */").otherwise("// @param a")
    rows = v("v_uses").select((F.col("src") * 10 + F.col("k")).alias("id"), comment.alias("comment"), F.array(F.lit("a"), F.lit("b")).alias("parameters"), (F.col("dst") % 2 == 0).alias("needs_return"))
    return facts.comment_gaps(rows)


@query("""SELECT src * 10 + k AS id, CASE k % 3 WHEN 0 THEN 'x = ' || dst || ';' WHEN 1 THEN 'go(' || dst || ')' END AS code FROM {v_uses}""")
def x12_suggested_code(v):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    content = F.when(F.col("k") % 3 == 0, text("see `y()`:\n```java\nx = ", F.col("dst"), ";```\n")).when(F.col("k") % 3 == 1, text("try `first()` or `go(", F.col("dst"), ")` but not `words here`")).otherwise("no code")
    return facts.suggested_code(v("v_uses").select((F.col("src") * 10 + F.col("k")).alias("id"), content.alias("content"))).select("id", "code")


@query("""SELECT src * 10 + k AS id, CASE WHEN k % 2 = 0 THEN 'OPEN:t' || dst || ',FIX:u' END AS actions FROM {v_uses}""")
def x10_last_actions(v):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    listed = text('[{"type": "OPEN", "target": "t', F.col("dst"), '", "label": "l"}, {"type": "NOPE", "target": "n", "label": "l"}, {"type": "FIX", "target": "u", "label": "l"}]')
    content = F.when(F.col("k") % 2 == 0, text("say @@ACTIONS[] and then @@ACTIONS", listed)).otherwise("no actions")
    rows = facts.last_actions(v("v_uses").select((F.col("src") * 10 + F.col("k")).alias("id"), content.alias("content")), "@@ACTIONS", ["OPEN", "FIX"])
    return rows.select("id", F.array_join(F.transform("actions", lambda a: F.concat(a.type, F.lit(":"), a.target)), ",").alias("actions"))


@query("""WITH m AS (SELECT src * 10 + k AS id, k, dst FROM {v_uses} WHERE k % 4 < 3)
  SELECT id, 1 AS nth, 'NAVIGATE' AS type, '' AS scope, CASE k % 3 WHEN 0 THEN '跳转到 s' || dst ELSE '打开文件 f' || dst END AS summary, true AS needs_confirmation, CASE WHEN k % 3 > 0 THEN 'f' || dst END AS file_path, CASE k % 3 WHEN 0 THEN 's' || dst END AS symbol,
    CASE WHEN dst % 3 > 0 THEN dst % 3 END AS line, NULL AS question, NULL AS options FROM m UNION ALL
  SELECT id, 2, 'JAVADOC', CASE k % 2 WHEN 0 THEN 'viewport' ELSE 'file' END, '补充 Javadoc 注释', true, NULL, NULL, NULL, NULL, NULL FROM m UNION ALL
  SELECT id, 3, 'CLARIFY', '', 'which ' || dst, false, NULL, NULL, NULL, 'which ' || dst, 'a:A,b:' || repeat('x', 80) || '…' FROM m""")
def x10_agent_actions(v):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, dst = F.col("k"), F.col("dst")
    where = F.when(k % 3 == 0, text('"symbol": " s', dst, ' "')).otherwise(text('"filePath": "f', dst, '"'))
    listed = text(
        '[{"type": "NOPE"}, {"type": "NAVIGATE", "line": 3}, {"type": "navigate", ', where, ', "line": "', dst % 3, '"}, {"type": "CLARIFY", "options": [{"id": "a", "label": "A"}, {"id": " ", "label": "B"}]}, ',
        '{"type": "JavaDoc", "scope": "', F.when(k % 2 == 0, "VIEWPORT").otherwise("planet"), '"}, {"type": "CLARIFY", "clarifyQuestion": "which ', dst, '", "options": [{"id": "a", "label": "A"}, {"label": "no id"}, {"id": "b", "label": "', "x" * 81, '"}]}, {"type": "JAVADOC", "scope": "file"}]',
    )
    content = F.when(k % 4 < 3, text("say AGENT_ACTIONS_JSON:[] and AGENT_ACTIONS_JSON: ", listed)).otherwise(F.when(dst % 2 == 0, "AGENT_ACTIONS_JSON: oops").otherwise("none"))
    rows = facts.agent_actions(v("v_uses").select((F.col("src") * 10 + k).alias("id"), content.alias("content")))
    return rows.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o.id, F.lit(":"), o.label)), ","))


@query("""SELECT src * 10 + k AS doc_id, 1 AS line, 'https://a.io/p' || dst AS url, 'see ' || k AS label FROM {v_uses}
  UNION ALL SELECT src * 10 + k, 2, 'http://b.io/' || dst, '' FROM {v_uses} WHERE k % 2 = 0""")
def x9_markdown_links(v):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, dst = F.col("k"), F.col("dst")
    lines = F.array(text("read [see ", k, "](https://a.io/p", dst, ") and [no](ftp://x)"), text(F.when(k % 2 == 0, "a Live demo at ").otherwise("not at "), "http://b.io/", dst, "."))
    rows = v("v_uses").select((F.col("src") * 10 + k).alias("doc_id"), F.posexplode(lines).alias("at", "text"))
    found = links.in_markdown(rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text"))
    return found.select("doc_id", "line", "url", "label")


def poms(v: View) -> DataFrame:
    """A pom for each supplier: a parent, properties, and a dependency for each use; places of the third kind name a property, of the fourth one that is not there."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("k")
    version = F.when(k % 4 == 2, text("${v.", k, "}")).when(k % 4 == 3, "${none}").otherwise(text(F.col("weight"), ".0"))
    dependency = text("<dependency>\n<groupId>g", k, "</groupId>\n<artifactId>s", F.col("dst"), "</artifactId><version>", version, "</version></dependency>\n")
    prop = F.when(k % 4 == 2, text("<v.", k, ">", F.col("weight"), ".5</v.", k, ">\n")).otherwise("")
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c.alias("c")))), lambda x: x.c), "")  # noqa: E731  (seven at most)
    rows = v("v_uses").groupBy("project_id", "src").agg(joined(prop).alias("p"), joined(dependency).alias("d"))
    content = text("<project>\n<properties>\n", F.col("p"), "</properties>\n", F.col("d"), "<parent><groupId>top</groupId><artifactId>a</artifactId><version>1</version></parent>\n</project>")
    return rows.select("project_id", text(F.col("src"), "/pom.xml").alias("file_path"), content.alias("content"))


COORDS = """(WITH u AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k) AS nth, count(*) FILTER (k % 4 = 2) OVER (PARTITION BY src) AS props, count(*) OVER (PARTITION BY src) AS deps FROM {v_uses})
  SELECT project_id, src || '/pom.xml' AS file_path, CAST(nth AS BIGINT) AS ordinal, CAST(4 + props + 3 * (nth - 1) AS BIGINT) AS line, 'g' || k || ':s' || dst AS dep_id,
    CASE k % 4 WHEN 2 THEN weight || '.5' WHEN 3 THEN '$' || '{{none}}' ELSE weight || '.0' END AS version FROM u
  UNION ALL SELECT DISTINCT project_id, src || '/pom.xml', 0, 4 + props + 3 * deps, 'top:a', '1' FROM u)"""


@query(f"SELECT * FROM {COORDS}")
def x5_x6_maven_coordinates(v):
    rows = manifests.maven_coordinates(poms(v))
    return rows.select("project_id", "file_path", F.col("ordinal").cast("long").alias("ordinal"), F.col("line").cast("long").alias("line"), "dep_id", "version")


LISTED = """(SELECT project_id, src || '/requirements.txt' AS file_path, CAST(2 * nth AS BIGINT) AS line, 's-' || dst AS name, CASE WHEN k % 3 = 0 THEN '==' || weight WHEN k % 3 = 1 THEN '>=' || k END AS "constraint", CASE WHEN k % 2 = 0 THEN 'os > ' || k END AS marker
  FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k) AS nth FROM {v_uses}))"""


@query(f'SELECT project_id, file_path, line, name, "constraint" AS spec, marker FROM {LISTED}')
def x7_requirements(v):
    found = manifests.requirements(requirement_files(v))
    return found.select("project_id", "file_path", F.col("line").cast("long").alias("line"), "name", F.col("constraint").alias("spec"), "marker")


def requirement_files(v: View) -> DataFrame:
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("k")
    spec = F.when(k % 3 == 0, text("[extra]==", F.col("weight"))).when(k % 3 == 1, text(" >=", k)).otherwise("")
    line = text("# note\nS._", F.col("dst"), spec, F.when(k % 2 == 0, text(" ; os > ", k)).otherwise(""), "  # why\n")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("c")))), lambda x: x.c), "")  # seven at most
    rows = v("v_uses").groupBy("project_id", "src").agg(joined.alias("content"))
    return rows.select("project_id", text(F.col("src"), "/requirements.txt").alias("file_path"), text(F.col("content"), "-r more.txt\n\n").alias("content"))


@query(f"""WITH f AS (SELECT *, 'n' || n || '/S' || src || '.java' AS file_path FROM {S}), r AS (SELECT *, CASE WHEN ends_with(file_path, '/S7.java') THEN 0 WHEN contains(lower(file_path), 's7') THEN 1 ELSE 2 END AS rank FROM f),
  t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rank, file_path) AS nth FROM r), h AS (SELECT src, min(line) AS line FROM (SELECT u.src, CASE WHEN k % 4 = 0 THEN 2 + i ELSE 999 END AS line
    FROM (SELECT u.*, (SELECT count(*) FROM {U} x WHERE x.src = u.src AND x.k % 4 = 0 AND x.k < u.k) AS i FROM {U} u WHERE u.dst = 7 AND u.k % 4 < 2) u) GROUP BY 1)
  SELECT project_id, arg_min(file_path, rank * 1000 + nth) AS file_path FROM t WHERE nth <= 48 AND (src = 7 OR src IN (SELECT src FROM h) OR src IN (14, 15)) GROUP BY 1""")
def w7_best_symbol(v):
    return facts.best_symbol(facts.lines(sources(v)), "S7").select("project_id", "file_path")


# --- the audit of all of it -----------------------------------------------------------------------------


def services(v: View) -> DataFrame:
    """More source files: a class for each supplier with literals, text blocks, an anonymous class and private methods, a hub that all of a project use, and a file that can't be read."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, dst, src = F.col("k"), F.col("dst"), F.col("src")
    field = (
        F.when(k % 4 == 0, text("  String f", k, ' = "jdbc:mysql://h', dst, ':3306/x";\n'))
        .when(k % 4 == 1, text("  String f", k, ' = "password=', dst, '";\n'))
        .when(k % 4 == 2, text("  void f", k, '() { password = read("pwd"); } // "token=1"\n'))
        .otherwise(text("  String f", k, ' = """\n    secret=1 class Ghost {\n    """;\n'))
    )
    fields = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", field.alias("c")))), lambda x: x.c), "")  # seven at most
    rows = v("v_uses").groupBy("project_id", "src").agg(fields.alias("fields"))
    content = text(
        "package app.controller;\n", F.when(src % 4 == 0, "@Repository").otherwise(""), "\npublic class L", src, "Service {\n", F.col("fields"),
        "  private void used() { Hub.touch(); }\n  private void unused() { used(); }\n  Runnable r = new Runnable() { @Override public void run() { used(); } };\n}\n",
    )
    hub = rows.select("project_id").distinct()
    own = rows.select("project_id", text("app/L", src, ".java").alias("file_path"), content.alias("content"))
    own = own.unionByName(hub.select("project_id", F.lit("app/Hub.java").alias("file_path"), F.lit("package app.controller;\npublic class Hub { static void touch() { } }\n").alias("content")))
    return own.unionByName(hub.select("project_id", F.lit("app/Null.java").alias("file_path"), F.lit(None).cast("string").alias("content")))


def everything(v: View) -> DataFrame:
    """Sources, poms and requirements as one corpus."""
    return code.union_of([sources(v), services(v), poms(v), requirement_files(v)])


FIELDS = "(SELECT *, 4 + coalesce(sum(CASE k % 4 WHEN 3 THEN 3 ELSE 1 END) OVER (PARTITION BY src ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, 'app/L' || src || '.java' AS file FROM {v_uses})"
SERVICES = f"(SELECT project_id, src, file, 4 + sum(CASE k % 4 WHEN 3 THEN 3 ELSE 1 END) AS line, CASE src % 4 WHEN 0 THEN 2 ELSE 3 END AS start FROM {FIELDS} GROUP BY ALL)"
LITERALS = f"""SELECT project_id, 'HARDCODED-VALUE' AS rule_id, CASE k % 4 WHEN 0 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, file AS file_path, line, CASE k % 4 WHEN 0 THEN 'connection string' ELSE 'credential' END || ' in a literal' AS description FROM {FIELDS} WHERE k % 4 < 2"""
PACKAGES = f"(SELECT project_id, 'app.controller' AS package, 1 + count(*) AS n, bool_or(src % 4 = 0) AS mixed, 'app/Hub.java' AS file_path, 2 AS line FROM {SERVICES} GROUP BY ALL UNION ALL SELECT project_id, 'n' || n, 2 * count(*), false, min('n' || n || '/S' || src || '.java'), arg_min(4 + n_imports, 'n' || n || '/S' || src || '.java') FROM {S} JOIN {LINES} USING (src) GROUP BY ALL)"
DEPENDENTS = f"""(SELECT project_id, callee_owner AS node, count(DISTINCT caller_owner) AS dependents FROM {LINKED} WHERE callee_owner <> caller_owner GROUP BY ALL HAVING dependents > 15)"""
AUDIT = f"""{CYCLES}, found AS ({LITERALS} UNION ALL SELECT project_id, 'EMPTY-CATCH', 'LOW', 'n' || n || '/S' || src || '.java', 9 + 2 * n_imports + 4 * n_methods, 'empty catch block' FROM {S} JOIN {LINES} USING (src)
  UNION ALL SELECT project_id, 'LITERAL-EQUALS', 'MEDIUM', 'n' || n || '/S' || src || '.java', 10 + 2 * n_imports + 4 * n_methods, 'equals on a name that may be null' FROM {S} JOIN {LINES} USING (src)
  UNION ALL SELECT project_id, 'DEAD-METHOD', 'LOW', file, line + 1, 'nothing calls unused' FROM {SERVICES}
  UNION ALL SELECT b.p, 'CYCLE', 'MEDIUM', f.file_path, f.line, 'package cycle: ' || array_to_string(b.path, ' -> ') FROM b
    JOIN (SELECT p, grain, component, arg_min(file_path, (src_type, dst_type)) AS file_path, arg_min(line, (src_type, dst_type)) AS line FROM m2 WHERE step = 1 GROUP BY ALL) f ON f.p = b.p AND f.grain = b.grain AND f.component = b.component WHERE b.grain = 'package'
  UNION ALL SELECT project_id, 'LAYERING', 'MEDIUM', file, start, 'conflict: app.controller.L' || src || 'Service' FROM {SERVICES}
  UNION ALL SELECT project_id, 'LAYERING', 'LOW', file_path, line, 'mixed: ' || package FROM {PACKAGES} WHERE mixed
  UNION ALL SELECT project_id, 'RESPONSIBILITY', 'MEDIUM', file_path, line, 'overloaded: ' || package FROM {PACKAGES} WHERE n > 20
  UNION ALL SELECT project_id, 'RESPONSIBILITY', 'LOW', 'app/Hub.java', 2, 'app.controller.Hub has ' || count(*) || ' dependents' FROM {SERVICES} GROUP BY project_id HAVING count(*) > 15
  UNION ALL SELECT d.project_id, 'RESPONSIBILITY', 'LOW', 'n' || n || '/S' || src || '.java', 4 + n_imports, node || ' has ' || d.dependents || ' dependents' FROM {DEPENDENTS} d JOIN (SELECT *, {OWN} AS node FROM {S} JOIN {LINES} USING (src)) USING (project_id, node)
  UNION ALL SELECT project_id, 'DEPENDENCY-INVALID', 'MEDIUM', file_path, line, dep_id FROM {COORDS} WHERE starts_with(version, '$')
  UNION ALL SELECT project_id, 'DEPENDENCY-DUPLICATE', 'LOW', file_path, line, dep_id FROM {in_file(COORDS)} WHERE n >= 2 AND versions < 2
  UNION ALL SELECT project_id, 'DEPENDENCY-CONFLICT', 'HIGH', file_path, line, dep_id FROM {in_file(COORDS)} WHERE versions >= 2
  UNION ALL SELECT project_id, 'DEPENDENCY-CONFLICT', 'MEDIUM', file_path, line, dep_id FROM {diverging(COORDS)}
  UNION ALL SELECT project_id, 'REQUIREMENT-' || rule_id, risk_level, file_path, line, name FROM ({requirement_sql(LISTED)})),
  kept AS (SELECT project_id, rule_id, file_path, CAST(line AS BIGINT) AS line, description, arg_min(risk_level, CASE risk_level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS risk_level FROM found GROUP BY ALL)"""


@query(AUDIT + " SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, line, rule_id, description) AS nth FROM kept")
def i7_e2_audit_issues(v):
    return audit.audit(everything(v)).issues.select("project_id", "rule_id", "file_path", "line", "description", "risk_level", "nth")


@query(AUDIT + f""", tot AS (SELECT project_id, 2 * count(*) + 2 AS total FROM {S} GROUP BY ALL)
  SELECT tot.project_id, tot.total, tot.total AS scanned, 1 AS skipped, false AS truncated, count(kept.line) AS issues, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low
  FROM tot LEFT JOIN kept ON kept.project_id = tot.project_id GROUP BY ALL""")
def g20_audit_header(v):
    return audit.audit(everything(v)).header


@query(LITERALS)
def r1_r2_literals(v):
    return issues.literal_issues(services(v)).select("project_id", "rule_id", "risk_level", "file_path", F.col("line").cast("long").alias("line"), "description")


@query(f"""SELECT project_id, 'app.controller.L' || src || 'Service' AS owner, m AS name, file AS file_path, line + p AS line FROM {SERVICES}, (SELECT unnest(['used', 'unused', 'run']) AS m, unnest([0, 1, 2]) AS p)
  UNION ALL SELECT project_id, 'app.controller.L' || src || 'Service', 'f' || k, file, line FROM {FIELDS} WHERE k % 4 = 2 UNION ALL SELECT DISTINCT project_id, 'app.controller.Hub', 'touch', 'app/Hub.java', 2 FROM {SERVICES}""")
def x3_anonymous_methods(v):
    return code.extractor("java")(services(v)).methods.select("project_id", "owner", "name", "file_path", F.col("line").cast("long").alias("line"))


@query(f"""SELECT project_id, 'L' || src || 'Service' AS name, start AS start_line, line + 3 AS end_line, CASE src % 4 WHEN 0 THEN 'Repository' ELSE '' END AS annotations FROM {SERVICES} UNION ALL SELECT DISTINCT project_id, 'Hub', 2, 2, '' FROM {SERVICES}""")
def x2_types_beside_text_blocks(v):
    rows = code.extractor("java")(services(v)).types
    return rows.select("project_id", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.array_join("annotations", ",").alias("annotations"))


@query(f"""SELECT project_id, 'L' || src AS caller, m AS caller_method, c AS callee, line + p AS line FROM {SERVICES}, (SELECT unnest(['used', 'unused', '<initializer>', 'run']) AS m, unnest(['touch', 'used', 'Runnable', 'used']) AS c, unnest([0, 1, 2, 2]) AS p)
  UNION ALL SELECT project_id, 'L' || src, 'f' || k, 'read', line FROM {FIELDS} WHERE k % 4 = 2""")
def x4_anonymous_calls(v):
    rows = code.extractor("java")(services(v)).call_sites
    return rows.select("project_id", F.regexp_extract("caller_owner", r"(L\d+)Service$", 1).alias("caller"), "caller_method", "callee", F.col("line").cast("long").alias("line"))


@query("""WITH f AS (SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS nth, content FROM {v_files} WHERE ends_with(path, '.md'))
  SELECT project_id, count(*) AS total, count(*) FILTER (nth <= 20) AS scanned, count(*) FILTER (nth <= 20 AND (content IS NULL OR length(content) > 900)) AS skipped, bool_or(nth > 20) AS truncated, max(CASE WHEN nth = 21 THEN path END) AS first_left FROM f GROUP BY 1""")
def s1_scan_report(v):
    return scan.report(scan.placed(v("v_files").withColumnRenamed("path", "file_path"), ".md", 20, 900))
