"""Call and dependency graphs: edges (project_id, src, dst, weight), cycles, resolution of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.tables import materialise
from . import small_graphs

#: Edges of a project up to which one task walks it.
LOCAL = 200_000


def method_edges(calls: DataFrame) -> DataFrame:
    """Calls (project_id, caller, callee, kind, path, pos) as weighted edges: calls, paths, kind of the first one; no self loops."""
    return (
        calls.filter("caller <> callee")
        .groupBy("project_id", F.col("caller").alias("src"), F.col("callee").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_set("path")).alias("paths"), F.min_by("kind", "pos").alias("kind"))
    )


def owner_edges(edges: DataFrame) -> DataFrame:
    """Method edges (``owner#method``) as edges between owners: weights added, paths united."""
    rows = edges.withColumns({"src": X.owner_of(F.col("src")), "dst": X.owner_of(F.col("dst"))}).filter("src <> dst")
    return rows.groupBy("project_id", "src", "dst").agg(F.sum("weight").alias("weight"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Who calls whom, from either side: a row (project_id, node, direction, other) per callee and caller of a node."""
    sides = F.array(F.struct(F.col("src").alias("node"), F.lit("callee").alias("direction"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.lit("caller").alias("direction"), F.col("src").alias("other")))
    return edges.select("project_id", F.explode(sides).alias("x")).select("project_id", "x.*").distinct()


def split(edges: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges into the project's own types, all others); types are (project_id, type)."""
    own = types.select("project_id", F.col("type").alias("dst")).distinct()
    return edges.join(own, ["project_id", "dst"], "left_semi"), edges.join(own, ["project_id", "dst"], "left_anti")


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between modules (project_id, type, module): both ends known, weights added, no self edges."""
    a = modules.select("project_id", F.col("type").alias("src"), F.col("module").alias("a"))
    b = modules.select("project_id", F.col("type").alias("dst"), F.col("module").alias("b"))
    rows = edges.join(a, ["project_id", "src"]).join(b, ["project_id", "dst"]).filter("a <> b")
    return rows.groupBy("project_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))


def dead(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Private methods with a body that nothing calls: methods (project_id, method, is_private, has_body, is_constructor, is_callback)."""
    own = methods.filter("is_private and has_body and not is_constructor and not is_callback")
    return own.join(edges.select("project_id", F.col("dst").alias("method")).distinct(), ["project_id", "method"], "left_anti")


def spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest labels along edges: state (project_id, node, label) until no node's label falls; rounds grow with the longest way.

    Only nodes whose label fell in a round pass it on in the next; states are
    tables in the shared folder, so a lost executor costs a round.
    """
    state = materialise(state, "labels")
    moved = state
    while True:
        told = moved.join(edges.select("project_id", F.col("src").alias("node"), "dst"), ["project_id", "node"])
        told = told.groupBy("project_id", F.col("dst").alias("node")).agg(F.min("label").alias("told"))
        state = state.join(told, ["project_id", "node"], "left").select("project_id", "node", F.least("label", "told").alias("label"), F.coalesce(F.col("told") < F.col("label"), F.lit(False)).alias("fell"))
        state = materialise(state, "labels")
        moved = state.filter("fell").drop("fell")
        state = state.drop("fell")
        if moved.isEmpty():
            return state


def by_size(edges: DataFrame, local: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct edges (project_id, src, dst) without loops: those of projects of up to ``local`` edges with the part, of about so many edges, that takes them, and the others."""
    own = materialise(edges.filter("src <> dst").select("project_id", "src", "dst").distinct(), "edges")
    size = own.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    total, most = size.agg(F.sum("n"), F.max("n")).first()
    parts = max(1, -(-(total or 0) // max(1, local)))
    key = F.to_json(F.struct("project_id"))
    small = own if (most or 0) <= local else own.join(size.filter(F.col("n") <= local), "project_id", "left_semi")
    large = None if (most or 0) <= local else own.join(size.filter(F.col("n") > local), "project_id", "left_semi")
    return small.withColumn("key", key).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))), large


def schema_of(edges: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    project = edges.schema["project_id"].dataType
    if isinstance(project, T.StructType):
        project = T.StructType([T.StructField(f.name, f.dataType) for f in project])  # what comes from Arrow may be null
    return T.StructType([T.StructField("project_id", project), *[T.StructField(n, t) for n, t in fields]])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Strongly connected components of two nodes or more: (project_id, node, component), the component named by its smallest node.

    Projects of up to ``local`` edges are walked whole, many of them in a task;
    larger ones are spread over all tasks.
    """
    small, large = by_size(edges, local)
    node = edges.schema["src"].dataType
    found = small.groupBy("part").applyInArrow(lambda t: small_graphs.components(t), schema_of(edges, ("node", node), ("component", node)))
    return found if large is None else found.unionByName(wide_components(large))


def wide_components(edges: DataFrame) -> DataFrame:
    """The same for graphs of any size.

    Labels spread forwards: a node's label is the smallest node that reaches
    it, so a component has one label, and the smallest node of each label is in
    one. What reaches that node under its own label is its component. These
    leave, and so do edges between labels; the rest goes on until no edge is
    left. Nodes without a way in or out leave first.
    """
    key = ["project_id", "node"]
    todo = materialise(edges.filter("src <> dst").select("project_id", "src", "dst").distinct(), "edges")
    out = None
    while not todo.isEmpty():
        into, away = (todo.select("project_id", F.col(c).alias("node")).distinct() for c in ("dst", "src"))
        inner = into.join(away, key)
        for c in ("src", "dst"):
            todo = todo.join(inner.withColumnRenamed("node", c), ["project_id", c])
        todo = materialise(todo.select("project_id", "src", "dst"), "edges")
        nodes = todo.select("project_id", F.col("src").alias("node")).union(todo.select("project_id", "dst")).distinct()
        label = materialise(spread(nodes.withColumn("label", F.col("node")), todo), "forward")
        for c in ("src", "dst"):
            todo = todo.join(label.select("project_id", F.col("node").alias(c), F.col("label").alias(f"{c}_label")), ["project_id", c])
        todo = materialise(todo.filter("src_label = dst_label").select("project_id", "src", "dst", F.col("src_label").alias("label")), "edges")
        # backwards from the smallest node of each label
        flags = label.select(*key, F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))
        back = spread(flags, todo.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = label.join(back.filter("label = 0").select(*key), key)
        found = materialise(found.select(*key, F.col("label").alias("component")), "component")
        out = found if out is None else out.unionByName(found)
        for c in ("src", "dst"):
            todo = todo.join(found.select("project_id", F.col("node").alias(c)), ["project_id", c], "left_anti")
        todo = materialise(todo.select("project_id", "src", "dst"), "edges")
    if out is None:
        return edges.select("project_id", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    size = out.groupBy("project_id", "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return out.join(size, ["project_id", "component"]).select(*key, "component")


def shortest_cycles(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """The shortest cycle through the smallest node of each component, the smallest one in order of its nodes.

    (project_id, component, length, path, nodes), where path joins the nodes by
    `` -> `` and returns to the start. Projects of up to ``local`` edges are
    walked whole, many of them in a task.
    """
    small, large = by_size(edges, local)
    node = edges.schema["src"].dataType
    found = small.groupBy("part").applyInArrow(lambda t: small_graphs.shortest_cycles(t), schema_of(edges, ("component", node), ("nodes", T.ArrayType(node))))
    if large is not None:
        found = found.unionByName(wide_cycles(large))
    return found.select("project_id", "component", (F.size("nodes") - 1).cast("long").alias("length"), F.array_join("nodes", " -> ").alias("path"), "nodes")


def wide_cycles(edges: DataFrame) -> DataFrame:
    """(project_id, component, nodes) for graphs of any size: one best path per node and round is kept, and a component of n nodes is done after n rounds at most."""
    inside = materialise(wide_components(edges), "components")
    a = inside.select("project_id", F.col("node").alias("src"), "component")
    b = inside.select("project_id", F.col("node").alias("dst"), F.col("component").alias("c2"))
    own = edges.select("project_id", "src", "dst").filter("src <> dst").distinct().join(a, ["project_id", "src"]).join(b, ["project_id", "dst"]).filter("component = c2")
    own = materialise(own.select("project_id", "component", "src", "dst"), "inner-edges")
    front = inside.filter("node = component").select("project_id", "component", F.col("node").alias("at"), F.array("node").alias("path"))
    seen = front.select("project_id", "component", "at")
    found = None
    while not front.isEmpty():
        step = front.join(own.withColumnRenamed("src", "at"), ["project_id", "component", "at"])
        step = step.groupBy("project_id", "component", F.col("dst").alias("at")).agg(F.min("path").alias("path"))
        step = materialise(step.withColumn("path", F.concat("path", F.array("at"))), "paths")
        done = step.filter("at = component")
        found = done if found is None else found.unionByName(done)
        over = found.select("project_id", "component")
        front = step.join(over, ["project_id", "component"], "left_anti").join(seen, ["project_id", "component", "at"], "left_anti")
        front = materialise(front.select("project_id", "component", "at", "path"), "front")
        seen = seen.unionByName(front.select("project_id", "component", "at"))
    if found is None:
        found = front.select("project_id", "component", "path")
    return found.select("project_id", "component", F.col("path").alias("nodes"))


def cycles_with(cycles: DataFrame, module: Column) -> DataFrame:
    """Cycles that a module is on, the shortest first."""
    return cycles.filter(F.array_contains("nodes", module)).orderBy("length", "path")


def fan_in(edges: DataFrame, more_than: int = 15) -> DataFrame:
    """Nodes with more than so many distinct dependents."""
    return edges.groupBy("project_id", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("dependents")).filter(F.col("dependents") > more_than)


def overused(edges: DataFrame, counted: DataFrame, more_than: int = 15) -> DataFrame:
    """Nodes of ``counted`` (project_id, node: those whose layer is not exempt) with too many dependents, as findings, LOW."""
    return fan_in(edges, more_than).join(counted.select("project_id", "node").distinct(), ["project_id", "node"], "left_semi").withColumn("risk_level", F.lit("LOW"))


def diagram_lines(edges: DataFrame) -> DataFrame:
    """A row per node and edge of each project's diagram: (project_id, part, nth, line), labels without marks that end them."""
    nodes = edges.select("project_id", F.col("src").alias("node")).union(edges.select("project_id", "dst")).distinct()
    nodes = materialise(nodes.withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy("node"))), "diagram-nodes")
    label = lambda c: F.regexp_replace(c.cast("string"), '["\\[\\]]', "")
    shown = nodes.select("project_id", F.lit("node").alias("part"), "nth", F.format_string('n%d["%s"]', "nth", label(F.col("node"))).alias("line"))
    a, b = (nodes.select("project_id", F.col("node").alias(e), F.col("nth").alias(f"{e}_nth")) for e in ("src", "dst"))
    rows = edges.join(a, ["project_id", "src"]).join(b, ["project_id", "dst"])
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("src_nth", "dst_nth"))
    arrows = rows.select("project_id", F.lit("edge").alias("part"), nth.alias("nth"), F.format_string("n%d -->|%s| n%d", "src_nth", F.col("weight").cast("string"), "dst_nth").alias("line"))
    return shown.unionByName(arrows)


def diagram(edges: DataFrame) -> DataFrame:
    """The same as one text per project, for graphs of modules."""
    order = F.sort_array(F.collect_list(F.struct((F.col("part") == "edge").alias("late"), "nth", "line")))
    return diagram_lines(edges).groupBy("project_id").agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform(order, lambda x: x.line), "\n")).alias("diagram"))


def nearest_declaring(parents: DataFrame, members: DataFrame) -> DataFrame:
    """For each type and member name the nearest type, upwards, that declares it: (project_id, type, name, owner, distance).

    parents: (project_id, type, parent); members: (project_id, type, name).
    Names go down from the types that declare them, and a type takes a name
    from the first that brings it, the smaller owner among equals; so circles
    end, and there are as many rounds as the longest way down.
    """
    front = members.select("project_id", "type", "name", F.col("type").alias("owner"), F.lit(0).cast("long").alias("distance")).distinct()
    front = materialise(front, "members")
    out = front
    below = parents.select("project_id", F.col("parent").alias("type"), F.col("type").alias("child")).distinct()
    while not front.isEmpty():
        step = front.join(below, ["project_id", "type"]).groupBy("project_id", F.col("child").alias("type"), "name").agg(F.min("owner").alias("owner"), (F.min("distance") + 1).alias("distance"))
        front = materialise(step.join(out, ["project_id", "type", "name"], "left_anti"), "members")
        out = out.unionByName(front)
    return out


def resolved(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Type references to types, in strict order.

    refs: (project_id, file_path, package, name, others); types: (project_id,
    qualified, package, simple, file_path); imports: (project_id, file_path,
    imported, is_wildcard). A name is looked up as a qualified name; then its
    last part in its file, among explicit imports, in its package, among
    wildcard imports if exactly one fits, and in ``java.lang`` of the project.
    """
    t = types.select("project_id", "qualified", F.col("package").alias("t_package"), "simple", F.col("file_path").alias("t_file"))
    of = lambda rows, way, scope, simple, resolved: rows.select("project_id", F.lit(way).alias("way"), scope.alias("scope"), simple.alias("simple"), resolved.alias("resolved"))
    none, simple, least = F.lit(""), F.col("simple"), F.min("resolved").alias("resolved")
    wild = imports.filter("is_wildcard").select("project_id", "file_path", F.col("imported").alias("t_package")).distinct().join(t, ["project_id", "t_package"])
    wild = wild.groupBy("project_id", "file_path", "simple").agg(F.count_distinct("qualified").alias("hits"), F.min("qualified").alias("qualified")).filter("hits = 1")
    names = [
        of(t, 0, none, F.col("qualified"), F.col("qualified")),
        of(t, 1, F.col("t_file"), simple, F.col("qualified")),
        of(imports.filter("not is_wildcard"), 2, F.col("file_path"), F.substring_index("imported", ".", -1), F.col("imported")),
        of(t, 3, F.col("t_package"), simple, F.col("qualified")),
        of(wild, 4, F.col("file_path"), simple, F.col("qualified")),
        of(t.filter("t_package = 'java.lang'"), 5, none, simple, F.col("qualified")),
    ]
    names = reduce(DataFrame.unionByName, names).groupBy("project_id", "way", "scope", "simple").agg(least)
    # each different reference is looked up once, in all ways at once, and the first way that finds it counts
    key = ["project_id", "file_path", "package", "name"]
    asked = refs.select(*key).filter("name is not null").distinct()
    last = F.substring_index("name", ".", -1)
    ways = [(none, F.col("name")), (F.col("file_path"), last), (F.col("file_path"), last), (F.col("package"), last), (F.col("file_path"), last), (none, last)]
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), scope.alias("scope"), of_.alias("simple")) for k, (scope, of_) in enumerate(ways)]))
    asked = asked.select(*key, ways.alias("w")).select(*key, "w.*")
    best = asked.join(names, ["project_id", "way", "scope", "simple"]).groupBy(*key).agg(F.min_by("resolved", "way").alias("resolved"))
    return refs.join(best, key, "left")


def callee_owners(sites: DataFrame, imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Call sites with callee_owner, by the kind of their receiver.

    sites: (project_id, file_path, caller_owner, callee, receiver_kind,
    resolved, others); imports: (project_id, file_path, imported, is_static,
    is_wildcard); declared: (project_id, type, name), names that a type
    declares or inherits. A call without a receiver goes to the caller's own
    type unless the name is statically imported and not declared there; ``this``
    is the own type; ``super`` and what can't be told stay open.
    """
    static = imports.filter("is_static and not is_wildcard").select(
        "project_id", "file_path", F.substring_index("imported", ".", -1).alias("callee"), F.regexp_extract("imported", r"^(.*)\.\w+$", 1).alias("static_owner")
    )
    static = static.groupBy("project_id", "file_path", "callee").agg(F.min("static_owner").alias("static_owner"))
    own = declared.select("project_id", F.col("type").alias("caller_owner"), F.col("name").alias("callee"), F.lit(True).alias("is_declared")).distinct()
    rows = sites.join(static, ["project_id", "file_path", "callee"], "left").join(own, ["project_id", "caller_owner", "callee"], "left")
    bare = F.when(F.col("static_owner").isNull() | F.col("is_declared"), F.col("caller_owner")).otherwise(F.col("static_owner"))
    owner = F.when(F.col("receiver_kind") == "NONE", bare).when(F.col("receiver_kind") == "THIS", F.col("caller_owner")).when(F.col("receiver_kind") == "SUPER", F.lit(None)).otherwise(F.col("resolved"))
    return rows.withColumn("callee_owner", owner).drop("static_owner", "is_declared")


def anchors(types: DataFrame, module: str) -> DataFrame:
    """Where an issue of a module is shown: its first declaration by file and line, of types (project_id, qualified, file_path, start_line, module column)."""
    first = F.min(F.struct("file_path", "start_line", "qualified")).alias("a")
    return types.groupBy("project_id", F.col(module).alias("module")).agg(first).select("project_id", "module", "a.file_path", F.col("a.start_line").alias("line"), "a.qualified")


def placed_edges(edges: DataFrame, types: DataFrame, grain: str) -> DataFrame:
    """Edges between types (src, dst, file_path: where they come from) as edges between modules, each with every file that makes it: (project_id, src, dst, src_type, dst_type, file_path)."""
    known = types.filter(F.col(grain).isNotNull()).select("project_id", "qualified", F.col(grain).alias("module")).distinct()
    a = known.select("project_id", F.col("qualified").alias("src_type"), F.col("module").alias("src"))
    b = known.select("project_id", F.col("qualified").alias("dst_type"), F.col("module").alias("dst"))
    rows = edges.select("project_id", F.col("src").alias("src_type"), F.col("dst").alias("dst_type"), "file_path")
    return rows.join(a, ["project_id", "src_type"]).join(b, ["project_id", "dst_type"]).filter("src <> dst")


def cycle_findings(edges: DataFrame, types: DataFrame, grains: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cycles between modules as issues at several grains, and the files on them.

    edges: (project_id, src, dst, file_path) between types; types: (project_id,
    qualified, file_path, start_line and a column per grain); grains: column
    and level, such as layer HIGH and package MEDIUM. An issue is anchored in
    the file that makes its first step, the one of the first edge by types and
    file, at the first type there that belongs to the module the step leaves;
    without one at the module's first type. Files: a row (project_id, grain,
    component, step, file_path) for each file that makes a step.
    """
    edges = materialise(edges, "type-edges")
    types = materialise(types, "types")
    # all grains go through one search, each as projects of its own
    own = lambda grain: F.struct("project_id", F.lit(grain).alias("grain"))
    placed, modules, inside = [], [], []
    for grain in grains:
        known = types.filter(F.col(grain).isNotNull())
        modules.append(anchors(known, grain).drop("qualified").withColumn("project_id", own(grain)))
        placed.append(placed_edges(edges, types, grain).withColumn("project_id", own(grain)))
        there = known.groupBy("project_id", "file_path", F.col(grain).alias("src")).agg(F.min("start_line").alias("line"))
        inside.append(there.withColumn("project_id", own(grain)))
    placed, modules, inside = (reduce(DataFrame.unionByName, x) for x in (placed, modules, inside))
    placed = materialise(placed, "module-edges")
    cycles = materialise(shortest_cycles(placed.select("project_id", "src", "dst").distinct()), "cycles")
    steps = cycles.select("project_id", "component", F.posexplode(F.slice("nodes", 1, F.size("nodes") - 1)).alias("step", "src"), "nodes").withColumn("dst", F.col("nodes")[F.col("step") + 1]).drop("nodes")
    made = steps.join(placed, ["project_id", "src", "dst"])
    first = made.filter("step = 0").join(inside, ["project_id", "file_path", "src"]).groupBy("project_id", "component")
    first = first.agg(F.min(F.struct("src_type", "dst_type", "file_path", "line")).alias("at")).select("project_id", "component", F.col("at.file_path").alias("at_file"), F.col("at.line").alias("at_line"))
    rows = cycles.join(first, ["project_id", "component"], "left").join(modules.withColumnRenamed("module", "component"), ["project_id", "component"], "left")
    level = F.create_map(*[F.lit(x) for pair in grains.items() for x in pair])
    rows = rows.select(
        "project_id.project_id", F.lit("CYCLE").alias("rule_id"), "project_id.grain", level[F.col("project_id.grain")].alias("risk_level"), "component",
        F.coalesce("at_file", "file_path").alias("file_path"), F.coalesce("at_line", "line").alias("line"), F.col("path").alias("description"), "length",
    )
    files = made.select("project_id.project_id", "project_id.grain", "component", "step", "file_path").distinct()
    return rows, files
