"""File trees: rows (project_id, path, size, content)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def kept(files: DataFrame) -> DataFrame:
    """Files that an import takes."""
    return files.filter(~X.excluded(F.col("path"), F.col("size")))


def classified(files: DataFrame) -> DataFrame:
    """Files with name, parent, depth, extension, language and category."""
    p = F.col("path")
    return files.withColumns(
        {"name": X.base_name(p), "parent_path": X.parent(p), "depth": X.depth(p), "extension": X.extension(p), "language": X.language(p), "category": X.file_class(p)}
    )


def checksums(files: DataFrame) -> DataFrame:
    """SHA-256 of contents, and whether they are binary: a NUL among the first 8192 characters."""
    return files.withColumns({"checksum": F.sha2(F.col("content"), 256), "is_binary": F.instr(F.substring("content", 1, 8192), "\0") > 0})


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with their text: UTF-8, or GBK where the first 512 characters would not be valid; what neither can read is U+FFFD.

    Only bytes that are not UTF-8 go through Python, in batches.
    """

    @F.pandas_udf("string")
    def gbk(found: pd.Series) -> pd.Series:
        return found.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))

    text = F.make_valid_utf8(F.col(content).cast("string"))
    broken = F.contains(F.substring(text, 1, 512), F.lit("\ufffd"))
    return files.withColumn("text", F.coalesce(gbk(F.when(broken, F.col(content))), text))


def tree(files: DataFrame, deepest: int | None = None) -> DataFrame:
    """Folder and file nodes: (project_id, path, parent_path, name, node_type, depth), folders first, then by name, in ``nth`` among siblings."""
    folders = files.select("project_id", F.explode(X.prefixes(F.col("path"), keep_self=False)).alias("path")).distinct().withColumn("node_type", F.lit("DIR"))
    nodes = folders.unionByName(files.select("project_id", "path").distinct().withColumn("node_type", F.lit("FILE")))
    p = F.col("path")
    nodes = nodes.withColumns({"parent_path": X.parent(p), "name": X.base_name(p), "depth": X.depth(p)})
    if deepest is not None:
        nodes = nodes.filter(F.col("depth") <= deepest)
    siblings = Window.partitionBy("project_id", "parent_path").orderBy(F.col("node_type") != "DIR", "name")
    return nodes.withColumn("nth", F.row_number().over(siblings))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes beside the node of their folder (null at the top)."""
    up = nodes.filter("node_type = 'DIR'").select("project_id", F.col("path").alias("parent_path"), F.col("name").alias("parent_name"))
    return nodes.join(up, ["project_id", "parent_path"], "left")


def subtree(files: DataFrame, path: str) -> DataFrame:
    """A node and all below it."""
    top = path.replace("\\", "/").strip("/")
    return files.filter((F.col("path") == top) | F.col("path").startswith(top + "/"))


def matching(nodes: DataFrame, keyword: str) -> DataFrame:
    """Nodes whose name holds a keyword, with all their folders."""
    hits = nodes.filter(F.lower("name").contains(keyword.lower()))
    ways = hits.select("project_id", F.explode(X.prefixes(F.col("path"))).alias("path")).distinct()
    return nodes.join(ways, ["project_id", "path"], "left_semi")


def statistics(files: DataFrame) -> DataFrame:
    """Per project: nodes, folders, files, size, depth (of folders), files by class and by language. Files are counted before anything meets."""
    rows = classified(files)
    n = F.count(F.lit(1))
    each = rows.groupBy("project_id", "category", "language").agg(n.alias("n"), F.sum("size").alias("size"))
    total = each.groupBy("project_id").agg(F.sum("n").alias("files"), F.sum("size").alias("size"))
    folders = files.select("project_id", F.explode(X.prefixes(F.col("path"), keep_self=False)).alias("path")).distinct()
    folders = folders.groupBy("project_id").agg(n.alias("folders"), F.max(X.depth(F.col("path"))).alias("depth"))

    def by(column: str) -> DataFrame:
        sums = each.filter(F.col(column).isNotNull()).groupBy("project_id", column).agg(F.sum("n").alias("n"))
        pairs = F.sort_array(F.collect_list(F.struct(column, "n")))
        return sums.groupBy("project_id").agg(F.map_from_entries(pairs).alias(f"by_{column}"))

    rows = total.join(folders, "project_id", "left").join(by("category"), "project_id", "left").join(by("language"), "project_id", "left")
    return rows.withColumn("folders", F.coalesce("folders", F.lit(0))).withColumn("nodes", F.col("files") + F.col("folders"))


def leading(files: DataFrame, column: str = "language", most: int = 8) -> DataFrame:
    """Per project the most frequent values of a column as one text: ``value:count`` joined by commas."""
    sums = classified(files).filter(F.col(column).isNotNull()).groupBy("project_id", column).agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), column))
    rows = sums.withColumn("rn", rn).filter(F.col("rn") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rn", column, "n"))), lambda x: F.concat(x[column], F.lit(":"), x.n.cast("string")))
    return rows.groupBy("project_id").agg(F.array_join(listed, ",").alias("leading"))


def snippets(files: DataFrame, cut: int = 2800, budget: int = 9000) -> DataFrame:
    """Documents of a project in path order, each cut, as long as those before stay under a budget: joined as one text.

    At most ``budget`` / shortest piece rows are in a window's reach; the first
    ``budget`` non-empty files of a project always suffice, so they are picked
    by rank first and the running sum sees no more than that.
    """
    docs = classified(files).filter("category = 'DOC' and content <> ''").select("project_id", "path", F.substring("content", 1, cut).alias("piece"))
    order = Window.partitionBy("project_id").orderBy("path")
    docs = docs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= budget)
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.withColumn("before", before).filter(F.col("before") < budget)
    return docs.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "piece"))), lambda x: x.piece), "\n").alias("text"))


def samples(files: DataFrame, most: int = 3) -> DataFrame:
    """The first source files of a project outside test folders, in tree order."""
    rows = classified(files).filter((F.col("category") == "SOURCE") & ~F.lower("path").rlike("(^|/)tests?/"))
    rn = F.row_number().over(Window.partitionBy("project_id").orderBy("path"))
    return rows.withColumn("nth", rn).filter(F.col("nth") <= most)


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose checksum is not cached under their project and path."""
    return checksums(files).join(cached, ["project_id", "path", "checksum"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows replaced by new ones of the same key; the newest row of a key (column updated_at) wins."""
    rest = [c for c in old.columns if c not in keys]
    rows = old.unionByName(new)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at")).alias("r")).select(*keys, "r.*")


def missing_sections(docs: DataFrame, required: list[str]) -> DataFrame:
    """Which of the required section titles a document lacks."""
    lacks = F.filter(F.array(*map(F.lit, required)), lambda s: ~F.contains(F.col("content"), s))
    return docs.withColumn("missing", lacks)
