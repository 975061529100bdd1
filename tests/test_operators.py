"""Operators on small fixtures, with rows written out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import code, evaluate, facts, files, graph, issues, manifests, sessions
from tessera.sources import archives, tables
from tessera.streaming import streams


def test_dedupe_keeps_the_most_severe(spark):
    rows = [(1, "R", "C", "LOW", "a", 1, "d", 1), (1, "R", "C", "HIGH", "a", 1, "d", 2), (1, "R", "C", "LOW", "b", 1, "d", 3)]
    df = spark.createDataFrame(rows, "project_id int, rule_id string, category string, risk_level string, file_path string, line int, description string, pos long")
    assert sorted((r.file_path, r.risk_level) for r in issues.dedupe(df.repartition(3)).collect()) == [("a", "HIGH"), ("b", "LOW")]
    assert {r.risk_level: r.n for r in issues.counts_by_risk(issues.dedupe(df)).collect()} == {"HIGH": 1, "MEDIUM": 0, "LOW": 1}


@pytest.mark.parametrize("local", [1, 100])
def test_cycles(spark, local):
    def found(pairs):
        df = spark.createDataFrame([(0, a, b, 1) for a, b in pairs], "project_id int, src string, dst string, weight long")
        return [(r.length, r.path) for r in graph.shortest_cycles(df, local).collect()]

    assert found([("a", "b"), ("b", "c"), ("c", "a"), ("h", "u")]) == [(3, "a -> b -> c -> a")]
    assert found([("x", "y"), ("y", "x")]) == [(2, "x -> y -> x")]
    assert found([("a", "b"), ("b", "c")]) == []
    assert found([("a", "c"), ("c", "a"), ("a", "b"), ("b", "a")]) == [(2, "a -> b -> a")]


@pytest.mark.parametrize("local", [0, 1000])
def test_components_and_nested_cycles(spark, local):
    import random

    rng = random.Random(1)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(50 + k, 50 + (k + 1) % 30) for k in range(30)} | {(90, 91), (91, 92), (92, 93)}
    reach = {a: {b for x, b in pairs if x == a} for a in {x for p in pairs for x in p}}
    for _ in reach:
        for a in reach:
            reach[a] |= {c for b in list(reach[a]) for c in reach.get(b, ())}
    groups = {a: {b for b in reach[a] if a in reach.get(b, ())} - {a} for a in reach}
    want = {(a, min(g | {a})) for a, g in groups.items() if g}
    df = spark.createDataFrame([(0, a, b, 1) for a, b in pairs], "project_id int, src int, dst int, weight long")
    assert {(r.node, r.component) for r in graph.components(df, local).collect()} == want and len(want) > 35
    assert graph.components(df.limit(0), local).count() == 0 and graph.shortest_cycles(df.filter("src >= 90"), local).count() == 0
    cycles = graph.shortest_cycles(df, local)
    assert [r.length for r in graph.cycles_with(cycles, F.lit(60)).collect()] == [30]


def test_large_and_small_projects_agree(spark):
    import random

    rng = random.Random(2)
    pairs = [(p, f"n{a}", f"n{b}") for p, n in ((0, 4), (1, 30), (2, 60), (None, 8)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n * 2))]
    df = spark.createDataFrame(pairs, "p long, src string, dst string").selectExpr("named_struct('p', p, 'grain', 'x') AS project_id", "src", "dst")
    known = df.filter("project_id.p is not null")
    both = [sorted((r.project_id.p, r.component, r.nodes) for r in graph.shortest_cycles(known, local).collect()) for local in (1_000, 40, 0)]
    assert both[0] == both[1] == both[2] and len(both[0]) > 2


def test_a_long_chain_is_few_jobs(spark):
    chain = spark.range(1000).selectExpr("0 AS project_id", "id AS src", "id + 1 AS dst")
    spark.sparkContext.setJobGroup("chain", "")
    assert graph.components(chain).count() == 0
    assert graph.shortest_cycles(chain.union(spark.createDataFrame([(0, 1000, 0)], chain.schema))).first().length == 1001
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 40
    spark.sparkContext.setJobGroup("none", "")


def test_resolution_order(spark):
    types = spark.createDataFrame(
        [(0, "p.A", "p", "A", "p/A"), (0, "q.A", "q", "A", "q/A"), (0, "q.B", "q", "B", "q/B"), (0, "r.B", "r", "B", "r/B"), (0, "r.C", "r", "C", "r/C"), (0, "java.lang.String", "java.lang", "String", "j/S")],
        "project_id int, qualified string, package string, simple string, file_path string",
    )
    imports = spark.createDataFrame([(0, "p/X", "q", True), (0, "p/X", "r", True), (0, "p/X", "ext.D", False)], "project_id int, file_path string, imported string, is_wildcard boolean")
    names = ["q.A", "A", "B", "C", "D", "String", "Nope", "other.D", "x.y.C"]
    refs = spark.createDataFrame([(0, i, "p/X", "p", n) for i, n in enumerate(names)], "project_id int, ref_id int, file_path string, package string, name string")
    got = {r.name: r.resolved for r in graph.resolved(refs, types, imports).collect()}
    assert got == {"q.A": "q.A", "A": "p.A", "B": None, "C": "r.C", "D": "ext.D", "String": "java.lang.String", "Nope": None, "other.D": "ext.D", "x.y.C": "r.C"}


def test_callee_owners(spark):
    sites = spark.createDataFrame(
        [(0, "f", "p.A", n, k, r) for n, k, r in (("go", "NONE", None), ("twist", "NONE", None), ("own", "NONE", None), ("go", "THIS", None), ("go", "SUPER", "p.B"), ("go", "TYPE", "p.B"), ("go", "UNRESOLVED", None))],
        "project_id int, file_path string, caller_owner string, callee string, receiver_kind string, resolved string",
    )
    imports = spark.createDataFrame([(0, "f", "q.T.twist", True, False), (0, "f", "q.T.own", True, False)], "project_id int, file_path string, imported string, is_static boolean, is_wildcard boolean")
    declared = spark.createDataFrame([(0, "p.A", "own")], "project_id int, type string, name string")
    got = sorted((r.callee, r.receiver_kind, r.callee_owner or "") for r in graph.callee_owners(sites, imports, declared).collect())
    assert got == [("go", "NONE", "p.A"), ("go", "SUPER", ""), ("go", "THIS", "p.A"), ("go", "TYPE", "p.B"), ("go", "UNRESOLVED", ""), ("own", "NONE", "p.A"), ("twist", "NONE", "q.T")]


def test_manifests(spark):
    pom = "<project>\n<parent>\n<groupId>g</groupId><artifactId>p</artifactId><version>1</version></parent>\n<properties><v.x>2.0</v.x></properties>\n<dependency><groupId>g</groupId>\n<artifactId>a</artifactId><version>${v.x}</version></dependency>\n<dependency><artifactId>b</artifactId><version>${none}</version></dependency></project>"
    files = spark.createDataFrame([(0, "pom.xml", pom)], "project_id int, file_path string, content string")
    rows = sorted((r.ordinal, r.line, r.dep_id, r.version) for r in manifests.maven_coordinates(files).collect())
    assert rows == [(0, 2, "g:p", "1"), (1, 5, "g:a", "2.0"), (2, 7, "?:b", "${none}")]
    text = "# c\n-r x\nRequests[security]==2.31.0 ; python_version < '3'\nmy_pkg>=1\n"
    files = spark.createDataFrame([(0, "requirements.txt", text)], "project_id int, file_path string, content string")
    rows = sorted((r.line, r.name, r.constraint, r.marker) for r in manifests.requirements(files).collect())
    assert rows == [(3, "requests", "==2.31.0", "python_version < '3'"), (4, "my-pkg", ">=1", None)]


JAVA = '''package demo.order;
import demo.util.Helper;
import java.util.*;
import static demo.util.Tools.twist;
/* a { comment
   over lines ; */
@Service("x{")
public final class OrderService extends Base<String, Map<K, V>> implements Runnable, java.io.Closeable {
    private Helper helper = Helper.create();
    private static final String S = "} { ;";
    public OrderService(Helper helper) { this.helper = helper; super.init(); }
    @Override
    public <T> List<String> run(final int a, Map<String, List<T>> m,
            String... rest) throws IOException, Err {
        if (a > 1) { helper.decorate("x"); this.helper.decorate(1); }
        new Helper().decorate(2);
        for (String q : rest) { go(q); }
        rest.stream().map(Helper::staticHelper).map(Helper::new); // no();
        return twist(this.run(2));
    }
    abstract void none(int[] xs);
    static class In { enum E { A, B; void e() { this.e(); } } void deep() { Object o = new Helper(); } }
    interface J extends A, B { int j(); }
}
'''


def test_facts_of_code(spark):
    files = spark.createDataFrame([(0, "O.java", JAVA), (0, "E.java", ""), (1, "N.java", None)], "project_id int, file_path string, content string")
    f = code.extractor("Java")(files)
    with pytest.raises(ValueError, match="cobol"):
        code.extractor("cobol")
    o = "demo.order.OrderService"
    types = {r.qualified: (r.kind, r.modifiers, r.annotations, r.super_class, r.interfaces, r.enclosing, r.start_line, r.end_line) for r in f.types.collect()}
    assert types == {
        o: ("CLASS", ["public", "final"], ["Service"], "Base", ["Runnable", "java.io.Closeable"], None, 7, 24),
        f"{o}.In": ("CLASS", ["static"], [], None, [], o, 22, 22), f"{o}.In.E": ("ENUM", [], [], None, [], f"{o}.In", 22, 22), f"{o}.J": ("INTERFACE", [], [], None, ["A", "B"], o, 23, 23),
    }
    methods = sorted((r.owner.removeprefix(o), r.signature, r.return_type or "", r.modifiers, r.annotations, r.thrown, r.has_body, r.line) for r in code.signatures(f.methods).collect())
    assert methods == [
        ("", "<init>(Helper)", "", ["public"], [], [], True, 11), ("", "none(int[])", "void", ["abstract"], [], [], False, 21),
        ("", "run(int, Map, String...)", "List<String>", ["public"], ["Override"], ["IOException", "Err"], True, 12),
        (".In", "deep()", "void", [], [], [], True, 22), (".In.E", "e()", "void", [], [], [], True, 22), (".J", "j()", "int", [], [], [], False, 23),
    ]
    sites = [(r.caller_method, r.receiver_kind, r.receiver_type, r.callee, r.call_kind, r.line) for r in f.call_sites.orderBy("seq", "nth").collect()]
    assert sites == [
        ("<initializer>", "TYPE", "Helper", "create", "METHOD", 9), ("<init>", "SUPER", None, "init", "METHOD", 11), ("run", "VARIABLE", "Helper", "decorate", "METHOD", 15),
        ("run", "VARIABLE", "Helper", "decorate", "METHOD", 15), ("run", "TYPE", "Helper", "Helper", "CONSTRUCTOR", 16), ("run", "TYPE", "Helper", "decorate", "METHOD", 16),
        ("run", "NONE", None, "go", "METHOD", 17), ("run", "VARIABLE", "String...", "stream", "METHOD", 18), ("run", "UNRESOLVED", None, "map", "METHOD", 18),
        ("run", "TYPE", "Helper", "staticHelper", "METHOD_REFERENCE", 18), ("run", "UNRESOLVED", None, "map", "METHOD", 18), ("run", "TYPE", "Helper", "Helper", "CONSTRUCTOR", 18),
        ("run", "NONE", None, "twist", "METHOD", 19), ("run", "THIS", None, "run", "METHOD", 19), ("e", "THIS", None, "e", "METHOD", 22), ("deep", "TYPE", "Helper", "Helper", "CONSTRUCTOR", 22),
    ]
    assert sorted((r.imported, r.is_static, r.is_wildcard, r.line) for r in f.imports.collect()) == [("demo.util.Helper", False, False, 2), ("demo.util.Tools.twist", True, False, 4), ("java.util", False, True, 3)]
    assert [(r.project_id, r.files, r.types, r.methods) for r in code.totals(files, f).orderBy("project_id").collect()] == [(0, 2, 4, 6), (1, 1, 0, 0)]


def test_facts(spark):
    text = 'class T {\n  public void go(int n) throws E {\n    if (s.equals("x")) {}\n    if (a().equals("x") || "y".equals(s) || t.equals(s)) {}\n    try { } catch (E e) { // no\n }\n  }\n  public T() { }\n}'
    files = spark.createDataFrame([(0, "T.java", text)], "project_id int, file_path string, content string")
    assert [(r.rule_id, r.risk_level, r.line) for r in facts.empty_catches(files).collect()] == [("EMPTY-CATCH", "LOW", 5)]
    assert [(r.rule_id, r.risk_level, r.line) for r in facts.literal_equals(files).collect()] == [("LITERAL-EQUALS", "MEDIUM", 3)]
    first = facts.outline(files).first()
    assert first.type == "T" and [(m.line, m.name) for m in first.methods] == [(8, "T"), (2, "go")]
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "a", "a"), (3, "a\nb", "b")], "id int, before string, after string")
    assert sorted((r.id, r.start, r.removed, r.added) for r in facts.diffs(pairs).collect()) == [(1, 2, ["b"], ["x"]), (3, 1, ["a"], [])]


def test_model_suggestions(spark):
    good = '[{"issueKey": "k1", "suggestion": "s", "rationale": "r"}, {"issueKey": "k1", "suggestion": "t", "rationale": "r"}, {"issueKey": "no", "suggestion": "s", "rationale": "r"}, {"issueKey": "k2", "suggestion": " ", "rationale": "r"}]'
    rows = [(0, 1, f"```json\n{good}\n```"), (0, 2, f"here: {good} done"), (0, 3, "none"), (0, 4, None)]
    replies = spark.createDataFrame(rows, "project_id int, reply_id int, content string")
    targets = spark.createDataFrame([(0, "k1"), (0, "k2")], "project_id int, issue_key string")
    assert sorted((r.reply_id, r.issue_key, r.suggestion) for r in facts.model_suggestions(replies, targets).collect()) == [(1, "k1", "t"), (2, "k1", "t")]


def test_comment_gaps(spark):
    rows = [(1, "/** a @param x b @return c */", ["x"], True), (2, "/** a */", ["x", "y"], True), (3, "// no", [], False), (4, "/** @param x */", ["x"], False)]
    df = spark.createDataFrame(rows, "id int, comment string, parameters array<string>, needs_return boolean")
    assert sorted((r.id, r.missing) for r in facts.comment_gaps(df).collect()) == [(2, "@param x"), (2, "@param y"), (2, "@return"), (3, "block")]


def test_requirement_findings(spark):
    rows = [("a.txt", 1, "x", "==1.0", None), ("a.txt", 2, "x", "==2.0", None), ("a.txt", 3, "y", ">=1", None), ("a.txt", 4, "y", ">=1", None), ("b.txt", 1, "z", "==1", None), ("c.txt", 1, "z", "==2", None),
            ("c.txt", 2, "w", "=3", None), ("c.txt", 3, "", None, None), ("c.txt", 4, "z", "==9", "python_version < '3'"), ("c.txt", 5, "v", "==1.*", None)]
    df = spark.createDataFrame([(0, *r) for r in rows], "project_id int, file_path string, line int, name string, constraint string, marker string")
    got = sorted((r.rule_id, r.risk_level, r.file_path, r.line) for r in manifests.requirement_findings(df).collect())
    assert got == [("CONFLICT", "HIGH", "a.txt", 2), ("CONFLICT", "MEDIUM", "b.txt", 1), ("DUPLICATE", "LOW", "a.txt", 4), ("INVALID", "MEDIUM", "c.txt", 2), ("INVALID", "MEDIUM", "c.txt", 3)]


def test_npm_packages(spark):
    text = '{"name": "n", "version": "9", "dependencies": {"a": "^1.2.3", "b": "*"}, "devDependencies": {"c": ">= 2"}, "scripts": {"d": "1"}}'
    df = spark.createDataFrame([(0, "package.json", text), (0, "x/package.json", "{")], "project_id int, file_path string, content string")
    assert sorted((r.block, r.name, r.version) for r in manifests.npm_packages(df).collect()) == [("dependencies", "a", "1.2.3"), ("dependencies", "b", "*"), ("devDependencies", "c", "2")]


def test_archives(spark):
    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, data in names:
                z.writestr(n, data)
        return out.getvalue()

    blobs = [("a.zip", packed([("ok/x.txt", "hi"), ("../up", "no"), ("/abs", "no"), ("C:/x", "no"), ("a/../../b", "no"), ("ab:c", "no"), ("d/", "")])), ("b.zip", b"junk"), ("c.zip", packed([("big", "0" * 200_000)])), ("d.zip", packed([(str(k), "") for k in range(9)])), ("e.zip", None)]
    df = spark.createDataFrame(blobs, "path string, content binary")
    got = sorted((r.archive, r.entry or "", r.reason or "", bytes(r.content) if r.content is not None else b"") for r in archives.entries(df, most_entries=8).collect())
    assert got == [
        ("a.zip", "../up", "outside", b""), ("a.zip", "/abs", "absolute", b""), ("a.zip", "C:/x", "absolute", b""), ("a.zip", "a/../../b", "outside", b""), ("a.zip", "ab:c", "characters", b""), ("a.zip", "ok/x.txt", "", b"hi"),
        ("b.zip", "", "unreadable", b""), ("c.zip", "", "too large", b""), ("d.zip", "", "too many entries", b""), ("e.zip", "", "unreadable", b""),
    ]


def test_counts_of_projects_without_issues(spark):
    none = spark.createDataFrame([], "project_id int, risk_level string")
    projects = spark.createDataFrame([(1,), (2,), (1,)], "project_id int")
    assert sorted((r.project_id, r.risk_level, r.n) for r in issues.counts_by_risk(none, projects).collect()) == [(p, r, 0) for p in (1, 2) for r in ("HIGH", "LOW", "MEDIUM")]


def test_no_sample_is_an_error(spark):
    with pytest.raises(ValueError):
        evaluate.macro_average(spark.createDataFrame([], "category string, recall double, false_positive_rate double, architecture_accuracy double, rule_match double, documentation_score double"))


def test_tables_of_an_application_are_removed(spark):
    import os

    kept = tables.materialise(spark.range(3), "three")
    assert kept.count() == 3 and os.path.isdir(tables.own_dir(spark))
    tables.clean(spark)
    assert not os.path.exists(tables.own_dir(spark))


def test_charsets(spark):
    rows = [(1, "plain é".encode()), (2, "中文代码".encode("gbk")), (3, None), (4, b""), (5, ("x" * 600).encode() + b"\xff")]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r.text for r in files.decoded(df).collect()}
    assert got == {1: "plain é", 2: "中文代码", 3: None, 4: "", 5: "x" * 600 + "\ufffd"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = lambda *r: spark.createDataFrame(list(r), "project_id int, x int")
    tables.replace_projects(rows((1, 1), (1, 2), (2, 3)), path)
    tables.replace_projects(rows((1, 9)), path)
    assert sorted((r.project_id, r.x) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 3)]
    for k in (1, 2):
        tables.append(spark.createDataFrame([(k, "a", "b")], "id int, kind string, name string"), str(tmp_path / "log"), "kind", "name")
    assert sorted((r.id, r.object_key) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(1, "a/b"), (2, "a/b")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.java").write_text("x")
    (tmp_path / "d" / "B.java").write_text("y" * 20)
    (tmp_path / "d" / "pom.xml").write_text("z")
    got = sorted((r.path.rsplit("/", 1)[1], r.size, r.skipped) for r in tables.corpus(spark, str(tmp_path / "d"), "*.java", most=10).collect())
    assert got == [("A.java", 1, False), ("B.java", 20, True)]
    (tmp_path / "set.json").write_text('{"version": "1", "samples": [{"id": "a"}, {"id": "b"}]}')
    assert sorted((r.version, r.id) for r in tables.samples(spark, str(tmp_path / "set.json"), "id: string").collect()) == [("1", "a"), ("1", "b")]


def test_metrics(spark):
    expected = spark.createDataFrame([("s", "c", ["a", "b"], ["z"], ["L"], True)], "sample_id string, category string, required array<string>, forbidden array<string>, layers array<string>, documentation boolean")
    observed = spark.createDataFrame([("s", ["a", "z"], ["L"], True)], "sample_id string, detected array<string>, layers_seen array<string>, documented boolean")
    r = evaluate.metrics(expected, observed).first()
    assert (r.recall, r.false_positive_rate, r.architecture_accuracy, round(r.rule_match, 3), r.documentation_score) == (0.5, 0.5, 1.0, 0.333, 1.0)


def test_reviews_batch_and_stream_agree(spark, tmp_path):
    names = {"A": "APPROVED", "M": "MODIFIED", "R": "REJECTED", "P": "PENDING"}
    runs = ["A", "R", "RRRRR", "RRRRRA", "RRA", "P", "RPMR", "RRRRPA", "RRRRRRR"]
    rows = [(k, k * 100 + i, i, names[c]) for k, run in enumerate(runs) for i, c in enumerate(run)]
    df = spark.createDataFrame(rows, "session_key int, ts int, id int, decision string")
    batch = {r.session_key: (r.round, r.approved, r.last_status, r.terminated) for r in sessions.review_states(df).collect()}
    assert batch[2] == (5, False, "REJECTED", True) and batch[3] == (5, False, "REJECTED", True) and batch[4] == (2, True, "APPROVED", True) and batch[5] == (0, False, "PENDING", False)


def test_streams_of_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("a", 90)], "route string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    over = streams.requests_over_limit(streams.table(spark, str(tmp_path / "in"), df.schema), limit=1)
    q = over.writeStream.outputMode("complete").format("memory").queryName("over").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.route, r.n) for r in spark.table("over").collect()] == [("a", 2)]


def test_cache_writes(spark):
    import random

    rng = random.Random(3)
    rows = sorted((rng.randrange(5), 60 * rng.randrange(600), k) for k in range(300))
    rows = [(0, 1800 * k, 1000 + k) for k in range(9)] + [(k + 10, t, i) for k, t, i in rows]
    df = spark.createDataFrame(rows, "key int, s int, id int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want, last = set(), {}
    for k, t, i in sorted(rows):
        if k not in last or t - last[k] > 3600:
            last[k] = t
            want.add(i)
    assert {r.id for r in sessions.cache_writes(df.repartition(4)).collect()} == want
    assert {i for i in want if i >= 1000} == {1000, 1003, 1006}


def test_live_counts(spark, tmp_path):
    df = spark.createDataFrame([(0, "HIGH", 0), (0, "HIGH", 60), (0, "LOW", 4000), (1, "HIGH", 9000)], "project_id int, risk_level string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.live_counts(streams.table(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.project_id, r.risk_level, r.n) for r in spark.table("live").collect()) == [(0, "HIGH", 2), (0, "LOW", 1), (1, "HIGH", 1)]
