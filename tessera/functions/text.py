"""Column functions over paths, keys, names and urls."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a fixed table, else null."""
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])[key]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; empty if there is none."""
    return F.regexp_extract(F.lower(base_name(path)), r"\.([^.]+)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")).cast("long")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def prefixes(path: Column, sep: str = "/", keep_self: bool = True) -> Column:
    """All leading parts of a path, shortest first."""
    parts = F.split(path, "\\" + sep if sep == "." else sep)
    n = F.size(parts) if keep_self else F.size(parts) - 1
    steps = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), sep))


def language(path: Column) -> Column:
    return lookup(L.LANGUAGES, extension(path))


def file_class(path: Column) -> Column:
    """CONFIG, DOC, SOURCE or OTHER, in this order of rules: configuration names, documents, source languages, configuration extensions."""
    name, ext, lang = F.lower(base_name(path)), extension(path), language(path)
    stem = F.when(F.locate(".", name) > 1, F.substring_index(name, ".", 1)).otherwise(name)
    doc_name = ((ext == "") | ext.isin(*L.DOC_EXTENSIONS)) & stem.isin(*L.DOC_NAMES)
    return (
        F.when(name.isin(*L.CONFIG_NAMES), "CONFIG")
        .when(ext.isin(*L.DOC_EXTENSIONS) | doc_name, "DOC")
        .when(lang.isNotNull() & ~lang.isin(*L.NON_SOURCE), "SOURCE")
        .when(ext.isin(*L.CONFIG_EXTENSIONS), "CONFIG")
        .otherwise("OTHER")
    )


def excluded(path: Column, size: Column) -> Column:
    """Whether an import leaves a file out: a folder, name or extension on the lists, or too large."""
    folders = F.split(F.lower(parent(path)), "/")
    return (
        F.arrays_overlap(folders, F.array(*map(F.lit, L.EXCLUDED_DIRS)))
        | F.lower(base_name(path)).isin(*L.EXCLUDED_NAMES)
        | extension(path).isin(*L.EXCLUDED_EXTENSIONS)
        | (size > L.MAX_FILE_SIZE)
    )


def risk_rank(level: Column) -> Column:
    """0 for the most severe level."""
    return (F.array_position(F.array(*map(F.lit, L.RISKS)), level) - 1).cast("int")


def issue_key(rule: Column, path: Column, line: Column) -> Column:
    return F.concat_ws("|", rule, normal_path(path), line.cast("string"))


def short_path(path: Column, most: int = 44) -> Column:
    """Long paths with their middle written as an ellipsis."""
    head = max(8, int(most * 0.35))
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.substring(path, 1, head), F.lit("…"), F.right(path, F.lit(most - head - 1))))


def python_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def owner_of(method: Column) -> Column:
    """The part of a method id before its last ``#``."""
    return F.regexp_extract(method, "^(.*)#", 1)


def type_name(reference: Column) -> Column:
    """A type reference without annotations, type arguments and array marks."""
    bare = F.regexp_replace(reference, r"@\w+(\([^)]*\))?\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(bare, "<", 1), r"\[\s*\]", ""), r"\.\.\.$", ""))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path."""
    pattern = r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]*)(?::\d+)?([^?#]*)"
    return F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def repo_key(url: Column) -> Column:
    """Host and path of a repository, lower-cased, without ``.git`` and a slash at the end; empty if either is missing."""
    host, path = url_parts(F.regexp_replace(F.trim(url), r"\.git$", ""))
    path = F.regexp_replace(path, "/+$", "")
    return F.when((host == "") | (path == ""), "").otherwise(F.concat(host, F.lower(path)))


def project_name(url: Column) -> Column:
    """The last part of a repository's or archive's address without its ending; ``project`` if that is blank."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    name = F.regexp_extract(bare, r"([^/]*?)(\.git|\.zip)?$", 1)
    return F.when(F.trim(name) != "", name).otherwise("project")


def package_layer(package: Column) -> Column:
    """The layer of the rightmost package segment that has one."""
    found = F.transform(F.reverse(F.split(package, r"\.")), lambda s: lookup(L.PACKAGE_LAYERS, F.trim(s)))
    return F.try_element_at(F.array_compact(found), F.lit(1))


def name_layer(name: Column) -> Column:
    """The layer of the first suffix, in table order, that a type's name has."""
    out = None
    for suffix, layer in L.SUFFIX_LAYERS.items():
        fits = F.trim(name).endswith(suffix)
        out = F.when(fits, layer) if out is None else out.when(fits, layer)
    return out


def annotation_layer(annotations: Column) -> Column:
    """The layer of the first annotation that has one."""
    return F.try_element_at(F.array_compact(F.transform(annotations, lambda a: lookup(L.ANNOTATION_LAYERS, F.trim(a)))), F.lit(1))
