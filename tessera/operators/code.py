"""Facts of source files: types, methods, variables and call sites, by Spark jobs over segments of text.

Files are (project_id, file_path, content). A file's text falls into tokens
(strings, text blocks, characters, comments, code), each with its place. With
strings and comments blanked and the arguments of annotations taken out, it
falls into segments that end in a brace or semicolon. A segment that ends in an
opening brace begins a scope: a type, a method, the body of an anonymous class
or of an enum constant, or another block (a lambda, a statement, an array).
Running counts over the segments of a file tell how deep each lies and which
scopes are around it; patterns over a segment tell what it declares or calls.
There is no grammar: brackets in arguments of annotations or of anonymous
classes are told to a depth of four, and an anonymous class whose arguments
hold a block themselves is read as a plain block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import materialise
from . import graph

FILE = ["project_id", "file_path"]
#: Words of the language.
MODIFIERS = ("public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "transient", "volatile", "strictfp", "sealed")
NOT_CALLED = ("if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "new", "else", "do", "try", "case", "super", "this")
NOT_TYPES = ("return", "throw", "new", "else", "case", "package", "import", "goto", "assert", "instanceof", "throws")
INITIALIZER, CONSTRUCTOR = "<initializer>", "<init>"
INSTANTIABLE = ("CLASS", "ENUM", "RECORD")

# loops are possessive, so that long strings and comments need no stack
TEXT_BLOCK = r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+(?:"""|\z)'
TOKENS = rf"""(?s){TEXT_BLOCK}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|//[^\n]*|/\*.*?(?:\*/|$)|[^"'/]+|."""


def nested(depth: int = 4) -> str:
    """A pattern of a pair of round brackets with others in it."""
    inner = r"[^()]*+"
    for _ in range(depth):
        inner = rf"[^()]*+(?:\({inner}\)[^()]*+)*+"
    return rf"\({inner}\)"


TYPE = r"(?s)(?:^|\s)(class|interface|enum|record|@interface)\s+(\w+)"
MODIFIER = rf"\b({'|'.join(MODIFIERS)})\b"
ANNOTATION = r"@(?!interface\b)([\w.]+)"
NAMED = r"[A-Za-z_][\w.]*(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*"
METHOD = rf"(?s)^(?:(?:<[^()]*>\s*)?({NAMED})\s+)?([A-Za-z_]\w*)\s*\(([^()]*)\)\s*(?:throws\s+([\w.,\s]+?))?\s*$"
ANNOTATED = rf"@(?!interface\b)[\w.]+\s*{nested()}|[^@]+|@"
CONSTANT = rf"[A-Za-z_]\w*\s*(?:{nested()})?"
CONSTANTS = rf"(?s)^,?\s*{CONSTANT}(?:\s*,\s*{CONSTANT})*\s*,?$"
ANONYMOUS = rf"(?s)\bnew\s+[\w.]+(?:\s*<[^;{{}}()=]*>)?\s*{nested()}$"
CREATED = r"\bnew\s+([\w.]+)(?:\s*<[^<>()]*>)?\s*\("
CALL = r"(?:(?:\bnew\s+[\w.]+(?:\s*<[^<>()]*>)?\s*\([^()]*\)|[\w.]+|[)\]\x22])\s*\.\s*)?(?:<[^<>()]*>\s*)?(?:\bnew\s+)?\b\w+\s*\(|[\w.]+\s*::\s*\w+"
VARIABLE = rf"(?:^|[(,;\s])({NAMED})(?:\s*\.\.\.)?\s+([A-Za-z_]\w*)\s*(?:=(?!=)|;|,|\)|:|$)"


def only_lines(text: Column) -> Column:
    return F.regexp_replace(text, "[^\n]", "")


def kind_of(token: Column) -> Column:
    """What a token is: TEXT_BLOCK, STRING, CHARACTER, COMMENT or CODE."""
    return (
        F.when(token.startswith('"""') & (F.length(token) > 3), "TEXT_BLOCK")
        .when(token.startswith('"') & (F.length(token) > 1), "STRING")
        .when(token.startswith("'") & (F.length(token) > 1), "CHARACTER")
        .when(token.startswith("//") | token.startswith("/*"), "COMMENT")
        .otherwise("CODE")
    )


def tokens(files: DataFrame) -> DataFrame:
    """Tokens of files: nth, kind, text, start (code points before it), line and column (of its beginning, from 1)."""
    rows = files.select(*FILE, F.posexplode(F.regexp_extract_all("content", F.lit(TOKENS), F.lit(0))).alias("nth", "text"))
    before = Window.partitionBy(*FILE).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    newlines = F.length(only_lines(F.col("text")))
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    # where the last line before a token begins: behind the last newline of the tokens before
    breaks = F.when(newlines > 0, F.col("start") + F.length("text") - F.length(F.substring_index("text", "\n", -1)))
    rows = rows.withColumns({"start": start, "line": F.coalesce(F.sum(newlines).over(before), F.lit(0)) + 1})
    column = F.col("start") - F.coalesce(F.max(breaks).over(before), F.lit(0)) + 1
    return rows.select(*FILE, "nth", kind_of(F.col("text")).alias("kind"), "text", "start", F.col("line").cast("int").alias("line"), column.alias("column"))


def literals(files: DataFrame) -> DataFrame:
    """String literals of files as (project_id, file_path, line, column, kind, text), without their quotes; escapes stay as they are written."""
    rows = tokens(files).filter(F.col("kind").isin("STRING", "TEXT_BLOCK"))
    bare = F.when(F.col("kind") == "STRING", F.regexp_extract("text", r'(?s)^"(.*)"$', 1)).otherwise(F.regexp_extract("text", r'(?s)^"""(.*?)(?:""")?\z', 1))
    return rows.select(*FILE, "line", "column", "kind", bare.alias("text"))


def blanked(content: Column) -> Column:
    """Source text without what stands in strings and comments; lines stay where they are."""
    blank = lambda t: (
        F.when(t.startswith("/*"), only_lines(t))
        .when(t.startswith("//"), F.lit(""))
        .when(t.startswith('"""') & (F.length(t) > 3), F.concat(F.lit('""'), only_lines(t)))
        .when(t.startswith('"') & (F.length(t) > 1), F.lit('""'))
        .when(t.startswith("'") & (F.length(t) > 1), F.lit("0"))
        .otherwise(t)
    )
    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(TOKENS), F.lit(0)), blank), "")


def without_arguments(text: Column) -> Column:
    """Blanked text without the arguments of annotations; lines stay where they are."""
    bare = lambda t: F.when(t.rlike(r"^@[\w.]"), F.concat(F.regexp_extract(t, r"^@[\w.]+", 0), F.lit(" "), only_lines(t))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ANNOTATED), F.lit(0)), bare), "")


def matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def segments(files: DataFrame) -> DataFrame:
    """Segments of files: seq, head (text before the end), mark ({, } or ;), depth (before it), line (where its text begins)."""
    parts = F.regexp_extract_all(without_arguments(blanked(F.col("content"))), F.lit(r"[^{};]*[{};]"), F.lit(0))
    rows = files.select(*FILE, F.posexplode(parts).alias("seq", "text"))
    before = Window.partitionBy(*FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.right("text", F.lit(1))
    step = F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
    rows = rows.withColumns({"mark": mark, "head": F.trim(F.regexp_replace(F.regexp_replace("text", "[{};]$", ""), r"\s+", " "))})
    lead = F.length(F.regexp_extract("text", r"(?s)^(\s*)", 1)) - F.length(F.translate(F.regexp_extract("text", r"(?s)^(\s*)", 1), "\n", ""))
    newlines = F.length("text") - F.length(F.translate(F.col("text"), "\n", ""))
    return rows.select(
        *FILE, "seq", "head", "mark",
        F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int").alias("depth"),
        (F.coalesce(F.sum(newlines).over(before), F.lit(0)) + lead + 1).cast("int").alias("line"),
        (F.coalesce(F.sum(newlines).over(before), F.lit(0)) + newlines + 1).cast("int").alias("end_line"),
    )


def opened(rows: DataFrame, kind: Column, name: str, **held: Column) -> DataFrame:
    """Rows with ``name``: the seq of the innermost open block that ``kind`` marks around each, null outside; ``held`` are further columns with what holds of that block's own row.

    A closing brace belongs to the last opening one of its depth; the number
    of marked blocks that are open is a running count, and the block around a
    row is the last one opened at that count.
    """
    file = Window.partitionBy(*FILE)
    at = F.when(F.col("mark") == "{", F.col("depth")).when(F.col("mark") == "}", F.col("depth") - 1)
    rows = rows.withColumns({"_opens": F.coalesce(kind & (F.col("mark") == "{"), F.lit(False)), "_at": at})
    closes = F.lag("_opens").over(Window.partitionBy(*FILE, "_at").orderBy("seq"))
    rows = rows.withColumn("_closes", (F.col("mark") == "}") & F.coalesce(closes, F.lit(False)))
    step = F.when(F.col("_opens"), 1).when(F.col("_closes"), -1).otherwise(0)
    level = F.coalesce(F.sum(step).over(file.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_level", level)
    roles = F.when(F.col("_opens"), F.array(F.struct(F.col("_level").alias("key"), F.lit(False).alias("self")), F.struct((F.col("_level") + 1).alias("key"), F.lit(True).alias("self"))))
    rows = rows.withColumn("_role", F.explode(F.coalesce(roles, F.array(F.struct(F.col("_level").alias("key"), F.lit(False).alias("self"))))))
    block = F.struct(F.col("seq").alias(name), *[c.alias(n) for n, c in held.items()])
    last = F.last(F.when(F.col("_role.self"), block), ignorenulls=True).over(Window.partitionBy(*FILE, "_role.key").orderBy("seq", "_role.self"))
    rows = rows.withColumn("_block", F.when(F.col("_role.key") > 0, last)).filter("not _role.self")
    return rows.withColumns({n: F.col(f"_block.{n}") for n in (name, *held)}).drop("_opens", "_at", "_closes", "_level", "_role", "_block")


def packages(segs: DataFrame) -> DataFrame:
    """(project_id, file_path, package) of files that declare one."""
    name = F.regexp_extract("head", r"^(?:@\S+ )*package ([\w.]+)$", 1)
    return segs.filter("depth = 0 and mark = ';'").select(*FILE, name.alias("package")).filter("package <> ''").groupBy(*FILE).agg(F.min("package").alias("package"))


def imports(segs: DataFrame) -> DataFrame:
    """(project_id, file_path, imported, is_static, is_wildcard, line)."""
    pattern = r"^import (static )?([\w.]+?)(\.\*)?$"
    part = lambda k: F.regexp_extract("head", pattern, k)
    rows = segs.filter("depth = 0 and mark = ';'").filter(F.col("head").rlike(pattern))
    return rows.select(*FILE, part(2).alias("imported"), (part(1) != "").alias("is_static"), (part(3) != "").alias("is_wildcard"), "line")


def listed(text: Column) -> Column:
    """Names between commas, without type arguments."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", ""), r"<[^<>]*>", "")
    return F.filter(F.transform(F.split(bare, ","), lambda s: F.trim(s)), lambda s: s != "")


@dataclass(frozen=True)
class Facts:
    """Facts of a corpus."""

    types: DataFrame
    methods: DataFrame
    call_sites: DataFrame
    imports: DataFrame
    packages: DataFrame
    variables: DataFrame
    held: bool = False


def facts(files: DataFrame) -> Facts:
    """All facts of Java sources, from one pass that cuts them into segments.

    types: qualified, package, name, kind, modifiers, annotations, super_class,
    interfaces, enclosing, start_line, end_line. methods: owner, name (that of
    a constructor is ``<init>``), return_type, parameters (type, name,
    varargs), modifiers, annotations, thrown, has_body, line. call_sites:
    caller_owner, caller_method, receiver_text, receiver_kind, receiver_type,
    callee, call_kind, line. variables: name, type, the last declaration of a
    name in a file. Calls outside methods belong to ``<initializer>``.
    """
    return facts_of(materialise(segments(files), "segments"))


def facts_of(segs: DataFrame) -> Facts:
    """The same from segments, which should be a table."""
    rows = materialise(scopes(segs), "enclosed")
    returns, name = F.regexp_extract("declared", METHOD, 1), F.regexp_extract("declared", METHOD, 2)

    package = packages(segs)
    types = qualified_types(segs, rows, package)
    owner = types.select(*FILE, F.col("seq").alias("type_seq"), F.col("qualified").alias("owner"))
    members = rows.join(owner, [*FILE, "type_seq"])

    parameter = lambda p: F.struct(
        F.trim(F.regexp_replace(F.regexp_extract(p, r"(?s)^(.*?)(?:\.\.\.)?\s+?(\w+)$", 1), r"^final\s+|\.\.\.$", "")).alias("type"), F.regexp_extract(p, r"(\w+)$", 1).alias("name"), p.contains("...").alias("varargs")
    )
    flat_args = F.regexp_replace(F.regexp_replace(F.regexp_extract("declared", METHOD, 3), r"<[^<>]*<[^<>]*>[^<>]*>", ""), r"<[^<>]*>", "")
    methods = members.filter("is_method").select(
        *FILE, "owner", F.when(returns == "", CONSTRUCTOR).otherwise(name).alias("name"), F.nullif(returns, F.lit("")).alias("return_type"),
        F.transform(F.filter(F.transform(F.split(flat_args, ","), lambda p: F.trim(p)), lambda p: p != ""), parameter).alias("parameters"),
        matches(F.regexp_extract("head", r"(?s)^([^(]*)", 1), MODIFIER, 1).alias("modifiers"), matches(F.regexp_extract("head", r"(?s)^(.*?)\w+\s*\([^()]*\)[^()]*$", 1), ANNOTATION, 1).alias("annotations"),
        listed(F.regexp_extract("declared", METHOD, 4)).alias("thrown"), (F.col("mark") == "{").alias("has_body"), "line", "seq",
    )
    variables = declared_variables(rows)
    return Facts(types, methods.drop("seq"), call_sites(members, methods, variables), imports(segs), package, variables)


def held(found: Facts) -> Facts:
    """The same with what is looked up several times as tables."""
    if found.held:
        return found
    return replace(found, held=True, **{name: materialise(getattr(found, name), name) for name in ("types", "call_sites", "imports", "packages")})


def scopes(segs: DataFrame) -> DataFrame:
    """Segments with the scopes around them: type_seq (the innermost type), body_seq (the innermost type or anonymous body) and method_seq (the innermost method).

    Beside them is_type, is_body, is_method (what a segment begins or, without
    a body, declares), is_constants (constants of an enum) and declared (the
    segment without annotations and modifiers). A method stands directly in the
    body of a type, of an anonymous class or of an enum constant.
    """
    is_type = F.col("head").rlike(TYPE) & (F.col("mark") == "{")
    # dealt by file once, which all windows below keep to
    rows = segs.repartition(*FILE).withColumn("is_type", is_type)
    rows = opened(rows, F.col("is_type"), "type_seq", type_depth=F.col("depth"), type_name=F.regexp_extract("head", TYPE, 2), in_enum=F.regexp_extract("head", TYPE, 1) == "enum")
    declared = F.trim(F.regexp_replace(F.regexp_replace("head", r"@[\w.]+(\s*\([^()]*\))?\s*", ""), rf"^(?:(?:{'|'.join(MODIFIERS)})\s+)+", ""))
    rows = rows.withColumn("declared", declared)
    returns, name = F.regexp_extract("declared", METHOD, 1), F.regexp_extract("declared", METHOD, 2)
    constants = F.col("in_enum") & (F.col("depth") == F.col("type_depth") + 1) & (F.col("head") != "static") & (name != F.col("type_name")) & F.col("head").rlike(CONSTANTS)
    rows = rows.withColumn("is_constants", F.coalesce(constants, F.lit(False)))
    is_body = F.col("is_type") | ((F.col("mark") == "{") & (F.col("is_constants") | F.col("head").rlike(ANONYMOUS)))
    rows = rows.withColumn("is_body", is_body)
    rows = opened(rows, F.col("is_body"), "body_seq", body_depth=F.col("depth"))
    direct = (F.col("depth") == F.col("body_depth") + 1) & ~F.col("is_body") & ~F.col("is_constants") & F.col("mark").isin("{", ";")
    own = (name == F.col("type_name")) & (F.col("body_seq") == F.col("type_seq"))
    named = F.col("declared").rlike(METHOD) & ~name.isin(*NOT_CALLED) & ~returns.isin(*NOT_TYPES) & ((returns != "") | own)
    rows = rows.withColumn("is_method", F.coalesce(direct & named, F.lit(False)))
    return opened(rows, F.col("is_method"), "method_seq")


def qualified_types(segs: DataFrame, rows: DataFrame, package: DataFrame) -> DataFrame:
    """Types with qualified names; a nested one is named by the types around it, which are looked up until none is left."""
    head = F.col("head")
    before = F.regexp_extract(head, r"(?s)^(.*?)(?:@interface|\b(?:class|interface|enum|record)\s)", 1)
    kind = F.regexp_extract(head, TYPE, 1)
    after = lambda word: F.regexp_extract(head, rf"(?s)\b{word}\s+(.*?)(?:\s(?:extends|implements|permits)\s.*)?$", 1)
    ends = closing_lines(segs)
    rows = rows.filter("is_type").join(ends, [*FILE, "seq"], "left").join(package, FILE, "left")
    rows = rows.select(
        *FILE, "seq", F.coalesce("package", F.lit("")).alias("package"), F.regexp_extract(head, TYPE, 2).alias("name"), F.upper(F.when(kind == "@interface", "annotation").otherwise(kind)).alias("kind"),
        matches(before, MODIFIER, 1).alias("modifiers"), matches(before, ANNOTATION, 1).alias("annotations"),
        F.when(kind != "interface", F.try_element_at(listed(after("extends")), F.lit(1))).alias("super_class"),
        F.when(kind == "interface", listed(after("extends"))).otherwise(listed(after("implements"))).alias("interfaces"),
        F.col("type_seq").alias("up"), F.col("line").alias("start_line"), "close_line",
    )
    names = rows.select(*FILE, "seq", "package", F.col("name").alias("path"), "up")
    names = materialise(names, "type-names")
    step = rows.select(*FILE, F.col("seq").alias("up"), F.col("name").alias("outer"), F.col("up").alias("next"))
    done = names.filter("up is null")
    todo = names.filter("up is not null")
    while not todo.isEmpty():  # once for each level of nesting
        todo = materialise(todo.join(step, [*FILE, "up"]).select(*FILE, "seq", "package", F.concat_ws(".", "outer", "path").alias("path"), F.col("next").alias("up")), "type-names")
        done, todo = done.unionByName(todo.filter("up is null")), todo.filter("up is not null")
    qualified = F.concat_ws(".", F.nullif("package", F.lit("")), "path")
    done = materialise(done.select(*FILE, "seq", qualified.alias("qualified")), "qualified-types")
    outer = done.select(*FILE, F.col("seq").alias("up"), F.col("qualified").alias("enclosing"))
    found = rows.join(done, [*FILE, "seq"]).join(outer, [*FILE, "up"], "left")
    return found.select(*FILE, "seq", "qualified", "package", "name", "kind", "modifiers", "annotations", "super_class", "interfaces", "enclosing", "start_line", F.col("close_line").alias("end_line"))


def closing_lines(segs: DataFrame) -> DataFrame:
    """For each opening brace (seq) the line of the brace that closes it."""
    at = F.when(F.col("mark") == "{", F.col("depth")).when(F.col("mark") == "}", F.col("depth") - 1)
    close = F.lead(F.struct("mark", "end_line")).over(Window.partitionBy(*FILE, "_at").orderBy("seq"))
    rows = segs.filter("mark <> ';'").withColumn("_at", at).withColumn("_close", close).filter("mark = '{'")
    return rows.select(*FILE, "seq", F.when(F.col("_close.mark") == "}", F.col("_close.end_line")).alias("close_line"))


def declared_variables(rows: DataFrame) -> DataFrame:
    """Declared names with their types: fields, locals and parameters; of several declarations in a file the last counts."""
    found = F.arrays_zip(matches(F.col("head"), VARIABLE, 1).alias("type"), matches(F.col("head"), VARIABLE, 2).alias("name"))
    each = rows.filter("not is_type").select(*FILE, "seq", F.posexplode(found).alias("nth", "v")).select(*FILE, "seq", "nth", F.trim("v.type").alias("type"), F.col("v.name").alias("name"))
    each = each.filter(~F.col("type").isin(*NOT_TYPES, *MODIFIERS, *NOT_CALLED) & ~F.col("name").isin(*NOT_TYPES, *NOT_CALLED))
    return each.groupBy(*FILE, "name").agg(F.max_by("type", F.struct("seq", "nth")).alias("type"))


def call_sites(members: DataFrame, methods: DataFrame, variables: DataFrame) -> DataFrame:
    """Call sites of segments that lie in types, with what their receiver is and, where it can be told, its type."""
    of = methods.select(*FILE, F.col("seq").alias("method_seq"), F.col("name").alias("caller_method"))
    text = F.regexp_replace("head", r"@[\w.]+(\s*\([^()]*\))?", " ")
    text = F.when(F.col("is_constants"), F.regexp_replace(text, r"(^|,)\s*[A-Za-z_]\w*\s*(?=\(|,|$)", "$1 ")).otherwise(text)
    rows = members.filter("not is_type and not is_method").join(of, [*FILE, "method_seq"], "left")
    # a type within a method begins anew: what is in none of its own methods belongs to its initializer
    rows = rows.withColumn("caller_method", F.when(F.col("method_seq") > F.col("type_seq"), F.col("caller_method")))
    rows = rows.select(*FILE, F.col("owner").alias("caller_owner"), F.coalesce("caller_method", F.lit(INITIALIZER)).alias("caller_method"), "line", "seq", F.posexplode(F.concat(matches(text, CREATED, 0), F.filter(matches(text, CALL, 0), lambda c: ~c.rlike(r"^new\s+\w+\s*\($")))).alias("nth", "call"))
    created = F.regexp_extract("call", rf"^{CREATED}$", 1)
    reference = F.regexp_extract("call", r"^([\w.]+)\s*::\s*(\w+)$", 1)
    member = F.regexp_extract("call", r"::\s*(\w+)$", 1)
    name = F.regexp_extract("call", r"(\w+)\s*\($", 1)
    before = F.trim(F.regexp_extract("call", r"(?s)^(.*?)\s*\.\s*(?:<[^<>()]*>\s*)?\w+\s*\($", 1))
    rows = rows.withColumns({"created": created, "reference": reference, "member": member, "name": name, "before": before})
    rows = rows.filter((F.col("created") != "") | (F.col("reference") != "") | ~F.col("name").isin(*[w for w in NOT_CALLED if w not in ("super", "this")]))
    delegation = F.col("name").isin("this", "super") & (F.col("before") == "") & (F.col("created") == "") & (F.col("reference") == "")
    text = F.when(F.col("reference") != "", F.col("reference")).otherwise(F.col("before"))
    rows = rows.withColumns({"delegation": delegation, "receiver_text": F.when(delegation, F.col("name")).when(F.col("created") == "", F.nullif(text, F.lit("")))})
    last = F.substring_index("receiver_text", ".", -1)
    known = variables.select(*FILE, F.col("name").alias("_v"), F.col("type").alias("variable_type"))
    may = (F.col("reference") == "") & F.col("receiver_text").rlike(r"^[\w.]+$") & ~F.col("receiver_text").isin("this", "super")
    rows = rows.withColumn("_v", F.when(may, last)).join(known, [*FILE, "_v"], "left")
    inner = F.regexp_extract("receiver_text", r"^new\s+([\w.]+)", 1)
    kind = (
        F.when(F.col("created") != "", "TYPE")
        .when(F.col("receiver_text").isNull(), "NONE")
        .when(F.col("receiver_text") == "this", "THIS")
        .when(F.col("receiver_text") == "super", "SUPER")
        .when(F.col("variable_type").isNotNull(), "VARIABLE")
        .when(inner != "", "TYPE")
        .when(F.col("receiver_text").rlike(r"^[A-Za-z_][\w.]*$"), "TYPE")
        .otherwise("UNRESOLVED")
    )
    rows = rows.withColumn("receiver_kind", kind)
    of_type = F.when(F.col("created") != "", F.col("created")).when(F.col("receiver_kind") == "VARIABLE", F.col("variable_type")).when(inner != "", inner).when(F.col("receiver_kind") == "TYPE", F.col("receiver_text"))
    made = (F.col("created") != "") | (F.col("member") == "new")
    call_kind = F.when(F.col("delegation"), "CONSTRUCTOR_DELEGATION").when(made, "CONSTRUCTOR").when(F.col("reference") != "", "METHOD_REFERENCE").otherwise("METHOD")
    callee = F.when(F.col("created") != "", F.col("created")).when(F.col("member") == "new", F.col("reference")).when(F.col("member") != "", F.col("member")).when(F.col("delegation"), CONSTRUCTOR).otherwise(F.col("name"))
    return rows.select(*FILE, "caller_owner", "caller_method", "receiver_text", "receiver_kind", of_type.alias("receiver_type"), callee.alias("callee"), call_kind.alias("call_kind"), "line", "seq", "nth")


def signatures(methods: DataFrame) -> DataFrame:
    """Methods with their signature: name(type, type), variable ones with dots."""
    return methods.withColumn("signature", F.concat("name", F.lit("("), F.array_join(F.transform("parameters", lambda p: F.concat(p.type, F.when(p.varargs, "...").otherwise(""))), ", "), F.lit(")")))


def totals(files: DataFrame, found: Facts) -> DataFrame:
    """Per project: files, types and methods; a project without either counts 0 of them."""
    n = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    for name, rows in (("types", found.types), ("methods", found.methods)):
        n = n.join(rows.groupBy("project_id").agg(F.count(F.lit(1)).alias(name)), "project_id", "left")
    return n.select("project_id", "files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("types", "methods")])


def listing(found: Facts, what: str) -> DataFrame:
    """A listing of facts: top_level or nested types, methods or constructors."""
    if what == "top_level":
        return found.types.filter("enclosing is null")
    if what == "nested":
        return found.types.filter("enclosing is not null")
    made = F.col("name") == CONSTRUCTOR
    return found.methods.filter(made if what == "constructors" else ~made)


#: Extractors by language; another one is added by putting it in.
LANGUAGES: dict[str, Callable[[DataFrame], Facts]] = {"java": facts}


def extractor(language: str) -> Callable[[DataFrame], Facts]:
    """The extractor of a language; one that is not there is an error."""
    found = LANGUAGES.get(language.strip().lower())
    if found is None:
        raise ValueError(f"no extractor for {language!r}, there are {', '.join(sorted(LANGUAGES))}")
    return found


def references(found: Facts) -> DataFrame:
    """Type references of call sites for ``graph.resolved``: call sites with ref_id, package and name (cleaned)."""
    sites = found.call_sites.withColumn("ref_id", F.xxhash64(*FILE, "seq", "nth"))
    return sites.join(found.packages, FILE, "left").withColumns({"package": F.coalesce("package", F.lit("")), "name": X.type_name(F.col("receiver_type"))})


def parents(found: Facts) -> DataFrame:
    """What types extend and implement, as far as it is in the project: (project_id, type, parent)."""
    types = found.types.select("project_id", "qualified", "package", F.col("name").alias("simple"), "file_path")
    above = F.array_compact(F.concat(F.array("super_class"), F.coalesce("interfaces", F.array().cast("array<string>"))))
    rows = found.types.select(*FILE, "package", F.col("qualified").alias("type"), F.explode(above).alias("reference"))
    rows = graph.resolved(rows.withColumn("name", X.type_name(F.col("reference"))), types, found.imports)
    return rows.filter("resolved is not null").select("project_id", "type", F.col("resolved").alias("parent")).distinct()


def declared(found: Facts) -> DataFrame:
    """For each type and member name the nearest type, itself first, that declares it; what can be made declares a constructor: (project_id, type, name, owner, distance)."""
    members = found.methods.select("project_id", F.col("owner").alias("type"), "name")
    made = found.types.filter(F.col("kind").isin(*INSTANTIABLE)).select("project_id", F.col("qualified").alias("type"), F.lit(CONSTRUCTOR).alias("name"))
    return graph.nearest_declaring(parents(found), members.unionByName(made))


def resolved(found: Facts) -> DataFrame:
    """Call sites with the types that their receivers and callees resolve to."""
    found = held(found)
    types = found.types.select("project_id", "qualified", "package", F.col("name").alias("simple"), "file_path")
    return graph.callee_owners(graph.resolved(references(found), types, found.imports), found.imports, declared(found))


def linked(found: Facts) -> DataFrame:
    """The same with ``declaring``: the type that declares what is called, null for sites that stay unresolved.

    In a type of the project that is the nearest one above, itself first, that
    declares the name; a type of another project stands for itself.
    """
    found = held(found)
    known = materialise(declared(found), "declared")
    types = found.types.select("project_id", "qualified", F.col("package"), F.col("name").alias("simple"), "file_path")
    sites = graph.callee_owners(graph.resolved(references(found), types, found.imports), found.imports, known)
    called = F.when(F.col("call_kind") == "CONSTRUCTOR", CONSTRUCTOR).otherwise(F.col("callee"))
    sites = sites.withColumn("called", called)
    own = types.select("project_id", F.col("qualified").alias("callee_owner"), F.lit(True).alias("is_own")).distinct()
    above = known.select("project_id", F.col("type").alias("callee_owner"), F.col("name").alias("called"), F.col("owner").alias("declared_by"))
    rows = sites.join(own, ["project_id", "callee_owner"], "left").join(above, ["project_id", "callee_owner", "called"], "left")
    return rows.withColumn("declaring", F.when(F.col("is_own"), F.col("declared_by")).otherwise(F.col("callee_owner"))).drop("is_own", "declared_by")


def unresolved(sites: DataFrame) -> DataFrame:
    """Of ``linked`` sites those that no type is known to declare: (project_id, file_path, line, caller_owner, caller_method, callee, call_kind)."""
    return sites.filter("declaring is null").select(*FILE, "line", "caller_owner", "caller_method", "callee", "call_kind")


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
