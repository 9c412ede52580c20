"""Session set-up shared by every operator: shipping the package, shared scratch space, Arrow batch bounds."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python; the second bound keeps batches of very long texts small.
ARROW_ROWS = 2000
ARROW_BYTES = 8 << 20
#: Rows that a scan decodes at a time: texts of kilobytes make wide batches.
SCAN_ROWS = 1024

#: Seconds between two collections of the driver's garbage, at least.
TIDY_S = 30

_shipped: set[str] = set()
_tidied = 0.0


def prepare(spark: SparkSession) -> SparkSession:
    """Give executors this package (as a zip through Spark's own file server), and set what every operator relies on for
    the rest of the session: bounded batches of scans and of Arrow, and UTC as its time zone."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(_package_zip())
        _shipped.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _package_zip() -> str:
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), "chronolith_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    return target


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine (tests) gets one made here; a cluster
    must name its own in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def _tidy(spark: SparkSession) -> None:
    """Have shuffle files deleted that nothing refers to any more. Spark does so when the driver collects its garbage, which
    may be long after the step that made them was written, while the next steps fill the disk."""
    global _tidied
    if time.monotonic() - _tidied >= TIDY_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()
