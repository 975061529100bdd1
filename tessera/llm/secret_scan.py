"""Secret scans with corpus-wide ownership of what is found.

Patterns give base spans: assignments to a key-like name, access keys, long
hexadecimal runs. The method looks at values: every candidate value, those of
the base spans and other high-entropy tokens, is hashed, and for each hash the
distinct repositories and owners that hold it are counted over the whole
corpus. A value that several owners share, or that stands in several
repositories of its one owner, is a copied example; one that a single owner
holds in few repositories looks live. High-entropy tokens that look live are
added to the spans (kind ``live``); base spans always stay, and their classes
are counted beside them.

Counting is one partial aggregate on (hash, owner, repository) and one on the
hash, so a value that a third of all documents hold meets no single task as
more than one row per owner and repository; frequent values are broadcast.

Cases: a null text is empty and has no spans; a null owner or repository
counts as one more of them; repeated rows are documents of their own; an empty
table gives no rows; other columns are ignored. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_key, materialise, slices

KINDS = ("assign", "access", "hex", "live")
#: The patterns of the contract.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A long token: what has letters of either case and digits, and enough entropy, is a candidate.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)
ENTROPY = 3.5
#: Owners, and repositories of one owner, from which on a value counts as a copied example.
SHARED, SPREAD = 2, 4


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the patterns, ordered by start, then kind as listed."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), m[1]))
    for m in ACCESS.finditer(text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end(), m[0]))
    return [(s, e, KINDS[k], v) for s, k, e, v in sorted(out)]


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """High-entropy tokens that overlap no base span."""
    out = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= ENTROPY:
            if all(m.end() <= s or m.start() >= e for s, e, *_ in base):
                out.append((m.start(), m.end(), "live", v))
    return out


def label(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SPAN = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("hash", "long"))
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hash", pa.int64())]))


def found_in(text: str) -> list[dict]:
    """All candidate spans of a text, with 64 bits of a hash of each value."""
    base = base_spans(text)
    rows = sorted(base + candidates(text, base), key=lambda x: (x[0], KINDS.index(x[2])))
    return [{"start": s, "end": e, "kind": k, "hash": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)} for s, e, k, v in rows]


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidate spans of every document: _row, doc_id, owner, repository and found (an array of spans). Values stay behind as hashes."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("\0")).alias("repository"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("found", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [found_in(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, ARROW_SPAN)], names=schema.names)

    return rows.mapInArrow(run, schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """For each candidate hash how many documents, repositories (of an owner) and owners hold it."""
    each = scanned.select("owner", "repository", F.explode("found.hash").alias("hash"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "lang", shared: int = SHARED, spread: int = SPREAD) -> DataFrame:
    """Secrets by document.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and
    n_example (base spans by class), n_added, and most_owners and
    most_repositories (of the most widely held value among its spans).
    """
    scanned = materialise(scan(docs, owner, repository), "secrets")
    live = (F.col("owners") < shared) & (F.col("repositories") < spread)
    held = materialise(ownership(scanned).select("hash", "occurrences", "owners", "repositories", live.alias("live")), "ownership")
    one = scanned.select("_row", F.explode("found").alias("x")).select("_row", "x.*")
    known = by_key(one, held, "hash", "occurrences").filter("kind <> 'live' or live")
    text = F.concat_ws(":", "kind", "start", "end")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    row = F.struct("start", rank.alias("rank"), text.alias("text"), "kind", "live")
    most = [F.max(c).alias(f"most_{c}") for c in ("owners", "repositories")]
    by_doc = known.groupBy("_row").agg(F.sort_array(F.collect_list(row)).alias("all"), *most)  # spans of one document
    joined = scanned.select("_row", "doc_id").join(by_doc, "_row", "left").withColumn("all", F.coalesce("all", F.array().cast(by_doc.schema["all"].dataType)))
    base = F.filter("all", lambda x: x.kind != "live")
    n = lambda kind: F.size(F.filter("all", lambda x: x.kind == kind)).cast("long")
    joins = lambda a: F.array_join(F.transform(a, lambda x: x.text), ",")
    return joined.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joins(base), 256).alias("base_sha256"),
        joins(F.col("all")).alias("spans"),
        F.size(F.filter(base, lambda x: x.live)).cast("long").alias("n_live"),
        F.size(F.filter(base, lambda x: ~x.live)).cast("long").alias("n_example"),
        n("live").alias("n_added"),
        *[F.coalesce(f"most_{c}", F.lit(0)).alias(f"most_{c}") for c in ("owners", "repositories")],
    )
