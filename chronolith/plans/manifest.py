"""Run manifests: a stage's output is committed by one row that is written last, and replayed if its inputs recur."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.values import dataset_fingerprint

_TYPES = {"stage": T.StringType(), "version": T.StringType(), "as_of": T.TimestampType(), "fingerprint": T.StringType(), "path": T.StringType(), "n_rows": T.LongType(), "finished_at": T.TimestampType()}
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _TYPES.items()])


def fingerprint(configuration: dict, *inputs: DataFrame) -> str:
    """A digest of a configuration and the content of the inputs, whatever their order and partitioning."""
    told = json.dumps(configuration, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256("\n".join([told, *(dataset_fingerprint(d) for d in inputs)]).encode()).hexdigest()


class Manifests:
    """Committed runs below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/manifest")
        except Exception as missing:  # noqa: BLE001  nothing was committed yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def find(self, stage: str, version: str, as_of: object, digest: str) -> DataFrame | None:
        """The output of a committed run with exactly these inputs."""
        same = (F.col("stage") == stage) & (F.col("version") == version) & (F.col("as_of") == F.lit(as_of)) & (F.col("fingerprint") == digest)
        found = self.rows().where(same).orderBy("finished_at").limit(1).collect()
        return self.spark.read.parquet(found[0].path) if found else None

    def run(self, stage: str, version: str, as_of: object, digest: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The stage's output and whether it was replayed. Output without a manifest row does not exist."""
        known = self.find(stage, version, as_of, digest)
        if known is not None:
            return known, True
        path = f"{self.root}/{stage}/{digest[:16]}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        out = self.spark.read.parquet(path)
        row = self.spark.createDataFrame([(stage, version, None, digest, path, out.count(), None)], SCHEMA)
        row.withColumns({"as_of": F.lit(as_of).cast("timestamp"), "finished_at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return out, False

    def latest(self, stage: str) -> DataFrame:
        """The run that a projection should show: later cutoffs win, so a late run of an earlier one changes nothing."""
        return self.rows().where(F.col("stage") == stage).orderBy(F.desc("as_of"), F.desc("finished_at"), F.desc("fingerprint")).limit(1)
