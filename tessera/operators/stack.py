"""Technologies from names: names (project_id, file_path, pos, name, version) and rules (prefix or name, stack)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import technologies as tech
from ..functions import text as X
from ..sources.tables import materialise
from . import manifests
from .ranks import ranked

SEEN = ["turn", "file_path", "line", "place"]


def by_longest_prefix(names: DataFrame, rules: DataFrame, sep: str = ".") -> DataFrame:
    """Names with the stack of the longest rule that is the name or ends at a separator in it; names are exploded into prefixes, so the join is an equi-join."""
    each = names.select("project_id", "name").distinct().withColumn("prefix", F.explode(X.prefixes(F.col("name"), sep)))
    best = each.join(rules, "prefix").groupBy("project_id", "name").agg(F.max_by("stack", F.length("prefix")).alias("stack"))
    return names.join(best, ["project_id", "name"], "left")


def by_name(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Names with the stack of the rule of that very name."""
    return names.join(rules, "name", "left")


def by_exact_or_prefix(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Names with every stack of the rule (key, stack) of that very name, else of the longest key that they begin with; a name is exploded into its beginnings, so the join is an equi-join."""
    each = names.select("name").distinct().filter("name <> ''")
    each = each.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substring("name", F.lit(1), k))))
    best = each.join(rules.select("key").distinct(), "key").groupBy("name").agg(F.max_by("key", F.length("key")).alias("key"))
    return names.join(best.join(rules, "key"), "name")


def by_category(found: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Per project its stacks, in the order given; stacks that are not listed come last, by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stack"))
    rank = F.when(place == 0, len(order) + 1).otherwise(place)
    rows = found.filter("stack is not null").groupBy("project_id").agg(F.sort_array(F.collect_set(F.struct(rank.alias("rank"), "stack"))).alias("s"))
    return rows.select("project_id", F.array_join(F.transform("s", lambda x: x["stack"]), ",").alias("stacks"))


def unrecognised(found: DataFrame) -> DataFrame:
    return found.filter("stack is null").select("project_id", "name").distinct()


def evidence(found: DataFrame) -> DataFrame:
    """Per project and stack: the first version that is not blank, and the names in the order they were first seen."""
    blank = F.coalesce(F.trim("version"), F.lit("")) == ""
    first = found.filter("stack is not null").groupBy("project_id", "stack", "name").agg(F.min("pos").alias("pos"), F.min_by(F.when(~blank, F.col("version")), F.when(~blank, F.col("pos"))).alias("version"), F.min(F.when(~blank, F.col("pos"))).alias("vpos"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return first.groupBy("project_id", "stack").agg(F.min_by("version", "vpos").alias("version"), F.array_join(listed, ",").alias("evidence"))


def capability(names: DataFrame, markers: tuple[str, ...] = L.MIDDLEWARE) -> DataFrame:
    """Per project HEAVY or LIGHT, and the markers its names hold, in the order of first hit."""
    hits = names.select("project_id", "pos", F.explode(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower("name"), m))).alias("marker"))
    first = hits.groupBy("project_id", "marker").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "marker"))), lambda x: x.marker), ",").alias("markers"))
    rows = names.select("project_id").distinct().join(listed, "project_id", "left")
    return rows.select("project_id", F.when(F.col("markers").isNotNull(), "HEAVY").otherwise("LIGHT").alias("capability"), F.coalesce("markers", F.lit("")).alias("markers"))


def rules(names: DataFrame) -> DataFrame:
    """The rules as a table (kind, key, stack), of fixed size."""
    rows = [(kind, key, says) for kind, key, known in tech.RULES for says in known]
    return names.sparkSession.createDataFrame(rows, "kind string, key string, stack string")


def matched(names: DataFrame) -> DataFrame:
    """Names (kind, name, others) with every technology that their rule says, null where none fits.

    kind is import, annotation, artifact, npm or python. An import takes the
    longest rule that it is or continues at a dot; an artifact the rule of its
    name, else the longest family that it begins with; the others the rule of
    their name. Each different name is looked up once, by all its keys at once:
    one equi-join with the rules, and the best key stays.
    """
    name, kind = F.col("name"), F.col("kind")
    key = lambda kind, key, rank: F.struct(F.lit(kind).alias("rule"), key.alias("key"), rank.cast("int").alias("rank"))
    dotted = F.transform(X.prefixes(name, "."), lambda p: key("import", p, F.length(p)))
    longest = max(len(k) for k in tech.FAMILIES)
    begun = F.transform(F.sequence(F.lit(1), F.least(F.length(name), F.lit(longest))), lambda n: key("family", F.substring(name, F.lit(1), n), n))
    whole = F.array(F.struct(kind.alias("rule"), name.alias("key"), F.lit(1 << 20).alias("rank")))
    keys = F.when(kind == "import", dotted).when(kind == "artifact", F.concat(whole, begun)).otherwise(whole)
    each = names.select("kind", "name").distinct().filter(name != "").select("kind", "name", F.explode(keys).alias("k")).select("kind", "name", "k.*")
    known = F.broadcast(rules(names).withColumnRenamed("kind", "rule"))
    best = each.join(F.broadcast(rules(names).select(F.col("kind").alias("rule"), "key").distinct()), ["rule", "key"]).groupBy("kind", "name").agg(F.max_by(F.struct("rule", "key"), "rank").alias("b"))
    says = best.select("kind", "name", "b.*").join(known, ["rule", "key"]).select("kind", "name", "stack")
    return names.join(says, ["kind", "name"], "left")


def names_of(types: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Names that tell technologies, in the order in which they are seen: (project_id, turn, file_path, line, place, kind, name, version, evidence).

    types and imports are facts of sources; files hold the manifests, whose
    names decide how they are read. turn is 0 for imports, 1 for annotations
    and 2 for manifests; place parts those of one line.
    """
    text = lambda *parts: F.concat(F.col("file_path"), F.lit(": "), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    row = lambda df, turn, kind, name, version, said, line="line", place=F.lit(0): df.select(
        "project_id", F.lit(turn).alias("turn"), "file_path", F.col(line).cast("long").alias("line"), place.cast("long").alias("place"), F.lit(kind).alias("kind"), name.alias("name"), version.alias("version"), said.alias("evidence")
    )
    none = F.lit(None).cast("string")
    own = row(imports, 0, "import", F.col("imported"), none, text("import ", F.col("imported")))
    each = types.select("*", F.posexplode("annotations").alias("at", "annotation"))
    own = own.unionByName(row(each, 1, "annotation", F.col("annotation"), none, text("@", F.col("annotation"), " on ", F.col("name")), "start_line", F.col("at")))
    base = F.lower(X.base_name(F.col("file_path")))
    of = lambda fits: files.filter(fits).select("project_id", "file_path", "content")
    poms = manifests.maven_coordinates(of(base.endswith(".xml")))
    version = F.when(manifests.is_resolved(F.col("version")), F.col("version"))
    said = F.concat_ws(":", "group_id", "artifact_id", version)
    artifact = row(poms, 2, "artifact", F.coalesce("artifact_id", F.lit("")), version, text(said), place=F.col("ordinal"))
    npm = manifests.npm_packages(of(base == "package.json")).withColumn("line", F.lit(0))
    npm = row(npm, 2, "npm", F.col("name"), F.col("version"), text(F.concat_ws("@", "name", "version")), place=F.array_position(F.array(*map(F.lit, manifests.NPM_BLOCKS)), F.col("block")))
    asked = manifests.requirements(of(base.endswith(".txt") & base.contains("requirement"))).filter("name <> ''")
    asked = row(asked, 2, "python", F.col("name"), manifests.pinned_version(F.col("constraint")), text(F.trim("raw")))
    return reduce(DataFrame.unionByName, (own, artifact, npm, asked))


def technologies(names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What names (of ``names_of``) say: technologies, their evidence, and dependencies that no rule knows.

    Technologies: (project_id, category, stack, version, evidences), the version
    being the first that is not blank. Evidence: (project_id, stack, nth,
    evidence), each different one once, in the order first seen. Unknown:
    (project_id, dependency), of manifests alone.
    """
    found = materialise(matched(names), "technology-names")
    seen = F.struct(*SEEN, "name")
    blank = F.coalesce(F.trim("version"), F.lit("")) == ""
    first = found.filter("stack is not null").groupBy("project_id", "stack", "evidence")
    first = materialise(first.agg(F.min(seen).alias("at"), F.min(F.when(~blank, F.struct(seen.alias("at"), F.col("version")))).alias("told")), "technology-evidence")
    category = F.create_map(*[F.lit(x) for pair in tech.CATEGORY_OF.items() for x in pair])
    known = first.groupBy("project_id", "stack").agg(F.min("told").alias("told"), F.count(F.lit(1)).alias("evidences"))
    known = known.select("project_id", category[F.col("stack")].alias("category"), "stack", "told.version", "evidences")
    unknown = found.filter("stack is null and turn = 2").select("project_id", F.expr("substring(evidence, length(file_path) + 3)").alias("dependency")).distinct()
    return known, ranked(first, ["project_id", "stack"], ["at", "evidence"]).select("project_id", "stack", "nth", "evidence"), unknown
