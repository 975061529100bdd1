"""Tokens and scopes of source files: text blocks, anonymous classes, lambdas, annotations, enum constants."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import code, issues

BLOCK = '''package p;
class A {
  String s = """
      class Ghost { void no() { call(); } }
      "quoted" \\""" still
      """;
  @Mark({"a", "b{"})
  @Other(names = {"x"}, of = @In(value = {1, 2}))
  public static class B extends A { void b() { a.go(s); } }
}
class C { }
'''
ANON = '''package p;
public class D {
  private final Task field = new Task(one(), 2) {
    @Override public void inner(int x) { a(); }
    int n = seven();
  };
  void outer() {
    run(new Task() {
      int m = eight();
      public String inner() throws E { return b(); }
    });
    c();
    list.forEach(x -> {
      d(x);
      if (x > 1) { e(); }
    });
    class Local { Object o = f(); void g() { h(); } }
    i();
  }
  Runnable r = () -> { j(); };
}
'''
ENUM = '''package p;
enum E {
  ONE(1) { int twice() { return k(); } },
  TWO(l()), THREE { int twice() { return 3; } };
  static { m(); }
  E(int... n) { this.n = n; }
  abstract int twice();
}
'''


@pytest.fixture(scope="module")
def found(spark):
    return code.facts(spark.createDataFrame([(1, "A.java", BLOCK), (1, "D.java", ANON), (1, "E.java", ENUM)], "project_id long, file_path string, content string"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_types(found):
    got = rows(found.types, "qualified", "enclosing", "start_line", "end_line", F.array_join("annotations", ","))
    assert got == sorted([
        ("p.A", None, 2, 10, ""), ("p.A.B", "p.A", 7, 9, "Mark,Other"), ("p.C", None, 11, 11, ""), ("p.D", None, 2, 21, ""), ("p.D.Local", "p.D", 17, 17, ""), ("p.E", None, 2, 8, ""),
    ], key=repr)


def test_methods(found):
    got = rows(code.signatures(found.methods), "owner", "signature", "has_body", "line")
    assert got == sorted([
        ("p.A.B", "b()", True, 9), ("p.D", "inner(int)", True, 4), ("p.D", "outer()", True, 7), ("p.D", "inner()", True, 10), ("p.D.Local", "g()", True, 17),
        ("p.E", "twice()", True, 3), ("p.E", "twice()", True, 4), ("p.E", "<init>(int...)", True, 6), ("p.E", "twice()", False, 7),
    ], key=repr)


def test_call_sites(found):
    got = rows(found.call_sites, "caller_owner", "caller_method", "callee")
    first = "<initializer>"
    assert got == sorted([
        ("p.A.B", "b", "go"), ("p.D", first, "Task"), ("p.D", first, "one"), ("p.D", "inner", "a"), ("p.D", first, "seven"), ("p.D", "outer", "run"), ("p.D", "outer", "Task"), ("p.D", "outer", "eight"), ("p.D", "inner", "b"),
        ("p.D", "outer", "c"), ("p.D", "outer", "forEach"), ("p.D", "outer", "d"), ("p.D", "outer", "e"), ("p.D.Local", first, "f"), ("p.D.Local", "g", "h"), ("p.D", "outer", "i"), ("p.D", first, "j"),
        ("p.E", "twice", "k"), ("p.E", first, "l"), ("p.E", first, "m"),
    ], key=repr)


def plain_tokens(text):
    """Literals by a walk over the characters: (line, column, kind, value)."""
    out, i = [], 0
    at = lambda k: (text.count("\n", 0, k) + 1, k - (text.rfind("\n", 0, k) + 1) + 1)
    while i < len(text):
        if text.startswith('"""', i):
            k = i + 3
            while k < len(text) and not text.startswith('"""', k):
                k += 2 if text[k] == "\\" else 1
            out.append((*at(i), "TEXT_BLOCK", text[i + 3 : k]))
            i = k + 3
        elif text[i] in "\"'":
            k = i + 1
            while k < len(text) and text[k] not in (text[i], "\n"):
                k += 2 if text[k] == "\\" else 1
            if k < len(text) and text[k] == text[i]:
                if text[i] == '"':
                    out.append((*at(i), "STRING", text[i + 1 : k]))
                i = k + 1
            else:
                i += 1
        elif text.startswith("//", i):
            i = (text + "\n").index("\n", i)
        elif text.startswith("/*", i):
            k = text.find("*/", i + 2)
            i = len(text) if k < 0 else k + 2
        else:
            i += 1
    return out


def test_literals(spark):
    rng = random.Random(3)
    bits = ['"a\\"b"', '""', '"""\nx "y" \\""" \n"""', "'\"'", "'\\''", '// "no"\n', '/* "no"\n*/', "\n", " x = ", ";", '"password=1"', "/", '"//"', "é", '"/*"']
    texts = ["".join(rng.choice(bits) for _ in range(40)) + "\n" for _ in range(30)] + ["", "x", '"' + "a\\n" * 900 + '"', "/*" + "*" * 20000, '"""' + "x\n" * 9000 + '"""']
    df = spark.createDataFrame([(k, "F", t) for k, t in enumerate(texts)], "project_id long, file_path string, content string")
    got = {}
    for r in code.literals(df).collect():
        got.setdefault(r.project_id, []).append((r.line, r.column, r.kind, r.text))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain_tokens(t)) for k, t in enumerate(texts) if plain_tokens(t)}


def test_rule_reads_literals_only(spark):
    text = 'class A {\n  String u = "jdbc:mysql://db:3306/x";\n  void a() { password = reader.read(); b("pwd: abc", "my jdbc:x://y"); }\n  // "token=9"\n  String t = """\n  secret=1\n  """;\n  String p = "password=";\n}\n'
    df = spark.createDataFrame([(1, "A.java", text)], "project_id long, file_path string, content string")
    assert rows(issues.literal_issues(df), "risk_level", "line", "trigger") == [("HIGH", 3, '"pwd: abc"'), ("MEDIUM", 2, '"jdbc:mysql://db:3306/x"')]


def test_scopes_are_dealt_once(spark):
    """Windows over a file's segments keep to one exchange, and no join looks up the blocks around them."""
    df = spark.createDataFrame([(1, "D.java", ANON)], "project_id long, file_path string, content string")
    segs = code.materialise(code.segments(df), "segments")
    plan = code.scopes(segs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_linked_reads_each_fact_once(spark):
    """What is linked comes from tables of facts, not again and again from the segments they are found in."""
    df = spark.createDataFrame([(1, "A.java", BLOCK), (1, "D.java", ANON)], "project_id long, file_path string, content string")
    linked = code.linked(code.facts(df))
    assert linked.count() > 0
    assert not [f for f in linked.inputFiles() if "/enclosed-" in f or "/segments-" in f]
