"""Sessions: building one for local work, and handing this package to the executors of any."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
#: What a batch of rows for a Python worker may hold, in place of Spark's 64 MB: a batch is held several times, on both sides.
BATCH, SPARKS_OWN, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20
#: What a table may hold for Spark to broadcast it unasked, in place of Spark's 10 MB: Spark goes by the size of its files, and what is repeated in them takes hundreds of times as much in the driver.
UNASKED, SPARKS_UNASKED, UNASKED_BYTES = "spark.sql.autoBroadcastJoinThreshold", ("10485760b", "10485760", "10MB", "10m", "10M"), 256 << 10


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, as a zip file that Spark distributes; batches for Python and tables that are broadcast unasked are kept small."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == SPARKS_OWN:  # not if it was set to something else
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if spark.conf.get(UNASKED) in SPARKS_UNASKED:
        spark.conf.set(UNASKED, str(UNASKED_BYTES))
    if getattr(sc, "_tessera_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, f"tessera/{p.relative_to(HERE)}")
    sc.addPyFile(path)
    sc._tessera_shipped = True
    return spark


def local(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, in UTC, with settings that fit small data."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
