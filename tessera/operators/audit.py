"""The audit of a corpus as one run: rules say which facts they need, and each fact is computed once for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X
from ..sources import tables
from ..sources.tables import materialise
from . import code, facts, graph, issues, layers, manifests, scan

#: Types of a package, and dependents of a type, above which they are findings.
MOST_TYPES, MOST_DEPENDENTS = 20, 15


class Corpus:
    """Files (project_id, file_path, content) and their facts, each computed when it is first asked for and kept as a table."""

    def __init__(self, files: DataFrame, most_files: int | None = None, most_chars: int = scan.MOST_CHARS):
        self.files, self.most_files, self.most_chars = files, most_files, most_chars
        self.seen = Observation("scan")
        self._known: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self._known:
            self._known[name] = FACTS[name](self)
        return self._known[name]


def java(c: Corpus) -> DataFrame:
    return scan.chosen(c.files, ".java", c.most_files, c.most_chars)


def segments(c: Corpus) -> DataFrame:
    """Segments of the Java sources; what the scan reads is counted on the way."""
    read = c["java"].observe(c.seen, F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("characters"))
    return materialise(code.segments(read), "segments")


def call_owners(c: Corpus) -> DataFrame:
    """Call sites with the type that declares what they call."""
    return materialise(code.linked(c["facts"]), "call-owners")


def method_edges(c: Corpus) -> DataFrame:
    """Calls between methods (project_id, src, dst), each as ``type#name``."""
    rows = c["call_owners"].filter("declaring is not null")
    rows = rows.select("project_id", F.concat_ws("#", "caller_owner", "caller_method").alias("src"), F.concat_ws("#", "declaring", "called").alias("dst"))
    return rows.filter("src <> dst").distinct()


def type_edges(c: Corpus) -> DataFrame:
    """Edges between types of the projects, with the files they come from: (project_id, src, dst, file_path)."""
    rows = c["call_owners"].filter("declaring <> caller_owner")
    rows = rows.select("project_id", F.col("caller_owner").alias("src"), F.col("declaring").alias("dst"), "file_path").distinct()
    own = c["facts"].types.select("project_id", F.col("qualified").alias("dst")).distinct()
    return materialise(rows.join(own, ["project_id", "dst"], "left_semi"), "type-edges")


def layered(c: Corpus) -> DataFrame:
    """Types with their layers."""
    return materialise(layers.assigned(c["facts"].types.withColumn("path", F.col("file_path"))), "layers")


FACTS: dict[str, Callable[[Corpus], object]] = {
    "java": java,
    "segments": segments,
    "facts": lambda c: code.facts_of(c["segments"]),
    "call_owners": call_owners,
    "method_edges": method_edges,
    "type_edges": type_edges,
    "layers": layered,
    "coordinates": lambda c: materialise(manifests.maven_coordinates(tables.manifests(c.files.withColumn("path", F.col("file_path"))).filter(F.lower(X.base_name(F.col("file_path"))) == "pom.xml").drop("path")), "coordinates"),
    "requirements": lambda c: materialise(manifests.requirements(tables.manifests(c.files.withColumn("path", F.col("file_path"))).filter(F.lower(X.base_name(F.col("file_path"))) != "pom.xml").drop("path")), "requirements"),
}


@dataclass(frozen=True)
class Rule:
    """A rule of the audit: the facts it needs, and its issues from them."""

    id: str
    needs: tuple[str, ...]
    inspect: Callable[..., DataFrame]


def issue(rows: DataFrame, rule: str, category: str, description) -> DataFrame:
    """Rows (project_id, risk_level, file_path, line) as issues."""
    columns = ["project_id", F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), "risk_level", "file_path", F.col("line").cast("long").alias("line")]
    return rows.select(*columns, description.alias("description"), F.col("line").cast("long").alias("pos"))


def dead_methods(found: code.Facts, edges: DataFrame) -> DataFrame:
    own = found.methods.select(
        "project_id", F.concat_ws("#", "owner", "name").alias("method"), "name", "file_path", "line", "has_body", F.array_contains("modifiers", "private").alias("is_private"),
        (F.col("name") == code.CONSTRUCTOR).alias("is_constructor"), F.arrays_overlap("annotations", F.array(*map(F.lit, L.CALLBACKS))).alias("is_callback"),
    )
    return issue(graph.dead(own, edges).withColumn("risk_level", F.lit("LOW")), "DEAD-METHOD", "DEAD_CODE", F.concat(F.lit("nothing calls "), "name"))


def cycles(edges: DataFrame, types: DataFrame) -> DataFrame:
    rows, _ = graph.cycle_findings(edges, types.filter("layer <> 'UNKNOWN'").unionByName(types.filter("layer = 'UNKNOWN'").withColumn("layer", F.lit(None).cast("string"))), {"layer": "HIGH", "package": "MEDIUM"})
    return issue(rows, "CYCLE", "ARCHITECTURE", F.concat("grain", F.lit(" cycle: "), "description"))


def layering(types: DataFrame) -> DataFrame:
    """Types whose signals differ, packages of several roles and packages of too many types, each at the type or the package's first one."""
    at = graph.anchors(types, "package").select("project_id", F.col("module").alias("subject"), "file_path", "line")
    own = types.select("project_id", F.col("qualified").alias("subject"), "file_path", F.col("start_line").alias("line"))
    found = layers.findings(types, MOST_TYPES)
    first = own.groupBy("project_id", "subject").agg(F.min(F.struct("file_path", "line")).alias("a")).select("project_id", "subject", "a.*")
    rows = found.filter("kind = 'CONFLICT'").join(first, ["project_id", "subject"]).unionByName(found.filter("kind <> 'CONFLICT'").join(at, ["project_id", "subject"]))
    over = F.col("kind") == "OVERLOADED"
    kept = lambda rows, rule: issue(rows, rule, "ARCHITECTURE", F.concat(F.lower("kind"), F.lit(": "), "subject"))
    return kept(rows.filter(~over), "LAYERING").unionByName(kept(rows.filter(over), "RESPONSIBILITY"))


def overused(edges: DataFrame, types: DataFrame) -> DataFrame:
    counted = types.filter(~F.col("layer").isin(*L.WIDELY_USED)).select("project_id", F.col("qualified").alias("node"))
    first = types.groupBy("project_id", F.col("qualified").alias("node")).agg(F.min(F.struct("file_path", F.col("start_line").alias("line"))).alias("a")).select("project_id", "node", "a.*")
    rows = graph.overused(edges, counted, MOST_DEPENDENTS).join(first, ["project_id", "node"])
    return issue(rows, "RESPONSIBILITY", "ARCHITECTURE", F.format_string("%s has %d dependents", "node", "dependents"))


def declared(coords: DataFrame) -> DataFrame:
    rows = manifests.findings(coords)
    return reduce(DataFrame.unionByName, [issue(rows.filter(F.col("rule_id") == r), r, "DEPENDENCY", F.col("description")) for r in ("DEPENDENCY-INVALID", "DEPENDENCY-DUPLICATE", "DEPENDENCY-CONFLICT")])


def required(rows: DataFrame) -> DataFrame:
    found = manifests.requirement_findings(rows).withColumn("rule_id", F.concat(F.lit("REQUIREMENT-"), "rule_id"))
    line = F.col("line").cast("long")
    return found.select("project_id", "rule_id", F.lit("DEPENDENCY").alias("category"), "risk_level", "file_path", line.alias("line"), F.coalesce("name", F.lit("")).alias("description"), line.alias("pos"))


#: The rules that are there; another one is added by putting it in.
RULES = (
    Rule("HARDCODED-VALUE", ("java",), lambda java: issues.literal_issues(java).drop("trigger").withColumn("line", F.col("line").cast("long"))),
    Rule("EMPTY-CATCH", ("segments",), lambda segs: facts.empty_catches_of(segs).withColumn("line", F.col("line").cast("long"))),
    Rule("LITERAL-EQUALS", ("java",), lambda java: facts.literal_equals(java).withColumn("line", F.col("line").cast("long"))),
    Rule("DEAD-METHOD", ("facts", "method_edges"), dead_methods),
    Rule("CYCLE", ("type_edges", "layers"), cycles),
    Rule("LAYERING", ("layers",), layering),
    Rule("OVERUSED", ("type_edges", "layers"), overused),
    Rule("DEPENDENCY", ("coordinates",), declared),
    Rule("REQUIREMENT", ("requirements",), required),
)


@dataclass(frozen=True)
class Report:
    """Issues in order, and a row per project: counts by level beside what the scan read."""

    issues: DataFrame
    header: DataFrame
    seen: dict


def audit(files: DataFrame, rules: Iterable[Rule] = RULES, most_files: int | None = None, most_chars: int = scan.MOST_CHARS) -> Report:
    """All issues of ``files``, each once, the most severe of those with one key, numbered in their project's order.

    Projects without an issue are in the header too. A rule sees whole tables
    of facts; which rules run decides which facts are computed.
    """
    corpus = Corpus(files, most_files, most_chars)
    found = issues.union(r.inspect(*[corpus[n] for n in r.needs]) for r in rules)
    found = materialise(issues.dedupe(found), "issues")
    levels = [F.count_if(F.col("risk_level") == r).alias(r.lower()) for r in L.RISKS]
    counts = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("issues"), *levels)
    read = scan.report(scan.placed(files, ".java", most_files, most_chars)).drop("first_left")
    header = files.select("project_id").distinct().join(read, "project_id", "left").join(counts, "project_id", "left")
    header = header.fillna(0, ["total", "scanned", "skipped", "issues", *[r.lower() for r in L.RISKS]]).fillna(False, ["truncated"])
    seen = corpus.seen.get if "segments" in corpus._known else {}
    return Report(issues.ordered(found), header, seen)
