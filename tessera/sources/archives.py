"""Archives as tables: names screened by column functions, entries unpacked where the archive lies."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of an archive, bytes of all of them, and their ratio to the archive.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 20_000, 512 << 20, 200
ENTRY = "archive string, nth int, entry string, size long, content binary, reason string"


def entry_reason(name: Column) -> Column:
    """Why an entry must not be unpacked: its name is empty, has characters that are not allowed, is absolute, leaves the folder or is the folder itself; null if it may."""
    name = F.translate(name, "\\", "/")
    step = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    at = F.aggregate(F.split(name, "/"), start, lambda a, s: F.struct((a.depth + step(s)).alias("depth"), F.least(a.least, a.depth + step(s)).alias("least")))
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "empty")
        .when(name.startswith("/") | name.rlike("^[A-Za-z]:"), "absolute")
        .when(name.rlike(r'[\x00-\x1f:*?"<>|]'), "characters")
        .when(at.least < 0, "outside")
        .when(at.depth == 0, "folder")
    )


def entries(archives: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> DataFrame:
    """Entries of archives (path, content): (archive, nth, entry, size, content, reason).

    An archive that can't be read, holds too many entries or unpacks to more
    bytes than allowed is one row with a reason and no content; so is each
    entry with a name that is not safe. Folders are left out.
    """

    def unpacked(path: str, blob: bytes) -> Iterator[tuple]:
        left = min(most_bytes, len(blob) * most_ratio)
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                listed = [(nth, info) for nth, info in enumerate(z.infolist()) if not info.is_dir()]
                if len(z.infolist()) > most_entries:
                    yield path, -1, None, None, None, "too many entries"
                    return
                for _, info in listed:  # what is declared is not believed
                    with z.open(info) as f:
                        while left >= 0 and (part := f.read(1 << 20)):
                            left -= len(part)
                if left < 0:
                    yield path, -1, None, None, None, "too large"
                    return
                for nth, info in listed:
                    data = z.read(info)
                    yield path, nth, info.filename, len(data), data, None
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError):
            yield path, -1, None, None, None, "unreadable"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in ENTRY.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                for row in unpacked(batch.column("path")[k].as_py(), batch.column("content")[k].as_py() or b""):
                    held.append(row)
                    size += row[3] or 0
                    if size > 8 << 20:
                        yield table(held)
                        held, size = [], 0
        if held:
            yield table(held)

    found = archives.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ENTRY)
    unsafe = F.when(F.col("nth") >= 0, entry_reason(F.col("entry")))
    found = found.withColumn("reason", F.coalesce("reason", unsafe))
    return found.withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))
