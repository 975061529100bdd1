"""Architectural layers of types: signals, conflicts, counts. Types are (project_id, path, package, name, annotations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X


def assigned(types: DataFrame) -> DataFrame:
    """Types with the layer that wins (test path, annotation, package, name), the rule that gave it, and whether signals differ."""
    test = F.when(F.lower("path").rlike("(^|/)src/test/|(^|/)tests?/"), "TEST")
    signals = {"by_path": test, "by_annotation": X.annotation_layer(F.col("annotations")), "by_package": X.package_layer(F.col("package")), "by_name": X.name_layer(F.col("name"))}
    rows = types.withColumns(signals)
    roles = F.array_distinct(F.filter(F.array_compact(F.array("by_annotation", "by_package", "by_name")), lambda x: x != "TEST"))
    rule = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c[3:].upper())) for c in signals], F.lit("NONE"))
    return rows.withColumns({"layer": F.coalesce(*signals, F.lit("UNKNOWN")), "rule": rule, "conflict": F.size(roles) > 1})


def per_layer(rows: DataFrame) -> DataFrame:
    """Types of each project by layer."""
    return rows.groupBy("project_id", "layer").agg(F.count(F.lit(1)).alias("n"))


def mixed_packages(rows: DataFrame) -> DataFrame:
    """Packages whose types play more than one role."""
    roles = F.array_except(F.sort_array(F.collect_set("layer")), F.array(F.lit("TEST"), F.lit("UNKNOWN")))
    return rows.groupBy("project_id", "package").agg(roles.alias("layers")).filter(F.size("layers") > 1)


def overloaded(rows: DataFrame, more_than: int = 20) -> DataFrame:
    """Packages with more than so many types."""
    return rows.groupBy("project_id", "package").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def findings(rows: DataFrame, more_than: int = 20) -> DataFrame:
    """Layering findings: conflicting types MEDIUM, mixed packages LOW, overloaded packages MEDIUM, as (project_id, kind, subject, risk_level)."""
    name = F.col("qualified") if "qualified" in rows.columns else F.concat_ws(".", "package", "name")
    a = rows.filter("conflict").select("project_id", F.lit("CONFLICT").alias("kind"), name.alias("subject"), F.lit("MEDIUM").alias("risk_level")).distinct()
    b = mixed_packages(rows).select("project_id", F.lit("MIXED").alias("kind"), F.col("package").alias("subject"), F.lit("LOW").alias("risk_level"))
    c = overloaded(rows, more_than).select("project_id", F.lit("OVERLOADED").alias("kind"), F.col("package").alias("subject"), F.lit("MEDIUM").alias("risk_level"))
    return a.unionByName(b).unionByName(c)


def listing(rows: DataFrame, what: str, layer: str | None = None) -> DataFrame:
    """A listing of assigned types: packages or types of a layer, or types whose signals conflict or that no signal classifies."""
    if what == "packages":
        return rows.filter(F.col("layer") == layer).select("project_id", "package").distinct()
    if what == "types":
        return rows.filter(F.col("layer") == layer)
    return rows.filter("conflict" if what == "conflicts" else "layer = 'UNKNOWN'")


LAYERS = L.LAYERS
