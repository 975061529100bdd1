"""Dependency declarations: coordinates (project_id, file_path, line, ordinal, dep_id, version) and their conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import dealt, ranked

ORDER = ("file_path", "ordinal")


def has_version(version: Column) -> Column:
    """Whether a version is written; one that is not may be managed elsewhere and is legal."""
    return F.coalesce(F.trim(version) != "", F.lit(False))


def is_unresolved(version: Column) -> Column:
    """Whether a version names a property that was not found."""
    return has_version(version) & F.trim(version).startswith("${")


def is_resolved(version: Column) -> Column:
    return has_version(version) & ~F.trim(version).startswith("${")


def in_file(coords: DataFrame) -> DataFrame:
    """Per file and dependency of several rows: rows, whether resolved versions differ, and the line of the second row.

    All of it comes from one sort of rows that are dealt by their key, whose
    second row carries the group's count and its extreme versions.
    """
    own = ["project_id", "file_path", "dep_id"]
    told = F.when(is_resolved(F.col("version")), F.col("version"))
    rows = dealt(coords.select(*own, "ordinal", "line", told.alias("told")), *own)
    group = Window.partitionBy(*own).orderBy("ordinal")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"nth": F.row_number().over(group), "n": F.count(F.lit(1)).over(whole), "differ": F.coalesce(F.min("told").over(whole) < F.max("told").over(whole), F.lit(False))})
    return rows.filter("nth = 2").select(*own, "n", "differ", "line")


def duplicates(coords: DataFrame) -> DataFrame:
    """A dependency declared twice in a file without differing versions: LOW, at the second."""
    return in_file(coords).filter("not differ").select("project_id", "file_path", "dep_id", "line", F.lit("LOW").alias("risk_level"))


def conflicts(coords: DataFrame) -> DataFrame:
    """Differing versions in one file: HIGH, at the second."""
    return in_file(coords).filter("differ").select("project_id", "file_path", "dep_id", "line", F.lit("HIGH").alias("risk_level"))


def divergence(coords: DataFrame) -> DataFrame:
    """Differing versions across files, if no file differs in itself: MEDIUM, at the first declaration, whatever its version.

    Counts decide which dependencies diverge before any place is looked at.
    """
    told = F.when(is_resolved(F.col("version")), F.col("version"))
    per_file = coords.groupBy("project_id", "dep_id", "file_path").agg(F.min(told).alias("low"), F.max(told).alias("high"), F.min(F.struct("ordinal", "line")).alias("at"))
    rows = per_file.groupBy("project_id", "dep_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("inside"),
        F.min(F.struct("file_path", F.col("at.ordinal").alias("ordinal"), F.col("at.line").alias("line"))).alias("at"),
    )
    rows = rows.filter("low <> high and not inside")
    return rows.select("project_id", "dep_id", "at.file_path", "at.line", F.lit("MEDIUM").alias("risk_level"))


def described(dep_id: Column, version: Column, file_path: Column, line: Column) -> Column:
    """A declaration as a text: id, version if there is one, and place."""
    return F.concat(dep_id, F.when(has_version(version), F.concat(F.lit(":"), version)).otherwise(""), F.lit(" ("), file_path, F.lit(":"), line.cast("string"), F.lit(")"))


def places(coords: DataFrame, found: DataFrame, key: tuple[str, ...] = ("project_id", "dep_id")) -> DataFrame:
    """Where the dependencies of ``found`` (``key``) stand: a row (key, nth, place) for each different text of a declaration, in order of file and ordinal."""
    place = described(F.col("dep_id"), F.col("version"), F.col("file_path"), F.col("line"))
    rows = coords.join(found.select(*key).distinct(), list(key), "left_semi").select(*dict.fromkeys((*key, *ORDER)), place.alias("place"))
    first = rows.groupBy(*key, "place").agg(F.min(F.struct(*[F.col(c) for c in ORDER])).alias("at"))
    return ranked(first, key, ["at", "place"]).select(*key, "nth", "place")


def locations(coords: DataFrame, found: DataFrame) -> DataFrame:
    """Findings with their places as one text, in order; for reports, where a finding's places fit into a line."""
    listed = places(coords, found).groupBy("project_id", "dep_id").agg(F.sort_array(F.collect_list(F.struct("nth", "place"))).alias("p"))
    listed = listed.select("project_id", "dep_id", F.array_join(F.transform("p", lambda x: x.place), " / ").alias("locations"))
    return found.join(listed, ["project_id", "dep_id"], "left")


def invalid(coords: DataFrame) -> DataFrame:
    """Declarations without a group, and others whose version names a property that is not there: MEDIUM, with the reason."""
    reason = F.when(F.col("dep_id").startswith("?:"), "no group").when(is_unresolved(F.col("version")), "unresolved version")
    rows = coords.withColumn("reason", reason).filter("reason is not null")
    return rows.select("project_id", "file_path", "dep_id", "line", F.lit("MEDIUM").alias("risk_level"), "reason")


def findings(coords: DataFrame) -> DataFrame:
    """All that is wrong with declarations, as issue rows: INVALID and CONFLICT, and DUPLICATE for what does not conflict in its file."""
    keep = lambda rows, rule: rows.select("project_id", F.lit(rule).alias("rule_id"), "risk_level", "file_path", "line", F.col("dep_id").alias("description"))
    parts = (keep(invalid(coords), "DEPENDENCY-INVALID"), keep(duplicates(coords), "DEPENDENCY-DUPLICATE"), keep(conflicts(coords), "DEPENDENCY-CONFLICT"), keep(divergence(coords), "DEPENDENCY-CONFLICT"))
    return reduce(DataFrame.unionByName, parts)


def maven_coordinates(files: DataFrame) -> DataFrame:
    """Dependencies of pom files (project_id, file_path, content): parent blocks first, then dependencies; properties of the same file filled in."""
    blocks = lambda tag: F.regexp_extract_all("content", F.lit(rf"(?s)<{tag}>.*?</{tag}>"), F.lit(0))
    rows = files.withColumn("block", F.concat(blocks("parent"), blocks("dependency")))
    rows = rows.select("project_id", "file_path", "content", F.posexplode("block").alias("ordinal", "block"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("block", rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    rows = rows.select(
        "project_id", "file_path", "content", "ordinal", tag("groupId").alias("group_id"), tag("artifactId").alias("artifact_id"), tag("version").alias("raw"), tag("scope").alias("scope"),
        F.regexp_count(F.substring("content", F.lit(1), F.expr("locate(block, content)")), F.lit("\n")).alias("line"),
    )
    name = F.nullif(F.regexp_extract("raw", r"^\$\{([^}]+)\}$", 1), F.lit(""))
    value = F.expr(r"regexp_extract(content, concat('<', regexp_replace(prop, '\\.', '\\\\.'), '>([^<]*)</'), 1)")
    rows = rows.withColumn("prop", name).withColumn("value", F.when(F.col("prop").isNotNull(), F.nullif(F.trim(value), F.lit(""))))
    dep = F.concat_ws(":", F.coalesce("group_id", F.lit("?")), F.coalesce("artifact_id", F.lit("?")))
    return rows.select("project_id", "file_path", (F.col("line") + 1).alias("line"), "ordinal", dep.alias("dep_id"), F.coalesce("value", "raw").alias("version"), "scope", "group_id", "artifact_id")


def requirements(files: DataFrame) -> DataFrame:
    """Requirements of text files (project_id, file_path, content): (line, name, constraint, marker), comments and options left out."""
    rows = files.select("project_id", "file_path", F.posexplode(F.split("content", "\n")).alias("line", "raw"))
    rows = rows.withColumn("body", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter("body <> '' and not startswith(body, '-')")
    main = F.trim(F.substring_index("body", ";", 1))
    marker = F.when(F.contains(F.col("body"), F.lit(";")), F.trim(F.regexp_extract("body", ";(.*)$", 1)))
    name = F.regexp_replace(F.lower(F.regexp_extract(main, r"^([A-Za-z0-9._-]+)", 1)), "[-_.]+", "-")
    constraint = F.nullif(F.trim(F.regexp_replace(main, r"^[A-Za-z0-9._-]+\s*(\[[^\]]*\])?", "")), F.lit(""))
    return rows.select("project_id", "file_path", (F.col("line") + 1).alias("line"), name.alias("name"), constraint.alias("constraint"), marker.alias("marker"), "raw")


# Operators of a version constraint, and the blocks that list packages.
OPERATORS = ("==", ">=", "<=", "~=", "!=", ">", "<")
NPM_BLOCKS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def pinned_version(constraint: Column) -> Column:
    """The version of a constraint that allows one only, else null."""
    return F.nullif(F.regexp_extract(F.trim(constraint), r"^==\s*([0-9][0-9.]*)$", 1), F.lit(""))


def legal_constraint(constraint: Column) -> Column:
    """Whether a constraint is absent or begins with an operator."""
    bare = F.trim(F.coalesce(constraint, F.lit("")))
    return (bare == "") | bare.rlike("^(" + "|".join(OPERATORS) + ")")


def requirement_findings(rows: DataFrame) -> DataFrame:
    """What is wrong with requirements (project_id, file_path, line, name, constraint, marker).

    MEDIUM for a line without a name or with an illegal operator; LOW for a
    name and constraint declared twice in a file, at the second; for pinned
    versions without a marker that differ HIGH in one file, at its second, or
    else MEDIUM across files, at the first. (project_id, rule_id, risk_level,
    file_path, line, name).
    """
    parsed = F.coalesce(F.col("name"), F.lit("")) != ""
    keep = lambda df, rule, level: df.select("project_id", F.lit(rule).alias("rule_id"), F.lit(level).alias("risk_level"), "file_path", "line", "name")
    wrong = rows.filter(~parsed | ~legal_constraint(F.col("constraint")))
    own = ["project_id", "file_path", "name"]
    good = dealt(rows.filter(parsed).select(*own, "line", "constraint", "marker"), *own)
    second = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("line")) == 2
    twice = good.withColumn("second", second(*own, F.coalesce("constraint", F.lit("")))).filter("second")
    pinned = good.withColumn("version", pinned_version(F.col("constraint"))).filter(F.col("version").isNotNull() & (F.coalesce(F.trim("marker"), F.lit("")) == ""))
    per_file = pinned.groupBy(*own).agg(F.min("version").alias("low"), F.max("version").alias("high"), F.min("line").alias("line"))
    per_name = per_file.groupBy("project_id", "name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.col("low") != F.col("high")).alias("inside"), F.min(F.struct("file_path", "line")).alias("at"))
    differ = per_name.filter("low <> high")
    across = differ.filter("not inside").select("project_id", "name", "at.*")
    clash = pinned.withColumn("second", second(*own)).filter("second").join(per_file.filter("low <> high").select(*own), own)
    return keep(wrong, "INVALID", "MEDIUM").unionByName(keep(twice, "DUPLICATE", "LOW")).unionByName(keep(clash, "CONFLICT", "HIGH")).unionByName(keep(across, "CONFLICT", "MEDIUM"))


def npm_packages(files: DataFrame) -> DataFrame:
    """Packages of package.json files (project_id, file_path, content): (block, name, version), versions without their prefix."""
    parsed = F.from_json("content", ", ".join(f"`{b}` map<string, string>" for b in NPM_BLOCKS))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.col(f"json.{b}").alias("packages")) for b in NPM_BLOCKS])
    rows = files.withColumn("json", parsed).select("project_id", "file_path", F.explode(blocks).alias("b"))
    rows = rows.select("project_id", "file_path", "b.block", F.explode("b.packages").alias("name", "raw"))
    return rows.select("project_id", "file_path", "block", "name", F.nullif(F.trim(F.regexp_replace(F.trim("raw"), r"^[\^~>=<v\s]+", "")), F.lit("")).alias("version"))
