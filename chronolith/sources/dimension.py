"""A dimension that is changed by key: only the hash partitions that new rows fall into are written again.

The table is a log of versions. A version names, for each bucket of keys, the folder that holds it; an upsert reads and
writes the buckets that its keys fall into, under a folder of its own, and then appends one row to the log. Folders that no
version names don't exist for readers, so a write that breaks off changes nothing, and buckets that were not touched keep
their files. Of two upserts that began from the same version the one whose row came first counts; the other is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.operators.expectations import ExpectationError, require_empty, unique, upsert
from chronolith.session import materialize

LOG = "version long, base long, commit string, n_rows long, schema string, folders map<int,string>"


class ConflictError(RuntimeError):
    """Another upsert from the same version came first."""


@dataclass(frozen=True)
class Staged:
    """An upsert that is written but not yet in the log."""

    base: int
    commit: str
    n_rows: int
    schema: str
    folders: dict[int, str]


class Dimension:
    """A dimension below a root folder, with a unique key, in ``buckets`` hash partitions (fixed when it is made)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log")
            return rows.withColumn("_at", F.col("_metadata.file_modification_time"))
        except Exception as missing:  # noqa: BLE001  nothing was committed yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], f"{LOG}, _at timestamp")

    def _chain(self) -> list[T.Row]:
        """The versions that count, from the first: of those with one base, the row that came first."""
        by_base: dict[int, T.Row] = {}
        for row in self._log().orderBy("base", "_at", "commit").collect():  # a row for each upsert
            by_base.setdefault(row.base, row)
        chain, version = [], 0
        while version in by_base:
            chain.append(by_base[version])
            version = by_base[version].version
        return chain

    def version(self) -> int:
        """The newest version; 0 before the first."""
        chain = self._chain()
        return chain[-1].version if chain else 0

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        found = [r for r in self._chain() if version is None or r.version == version]
        if not found:
            raise ExpectationError("there is no such version")
        return self._open(found[-1].schema, sorted(found[-1].folders.values()))

    def _open(self, schema: str, folders: list[str]) -> DataFrame:
        kinds = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kinds).parquet(*folders) if folders else self.spark.createDataFrame([], kinds)

    def stage(self, fresh: DataFrame, prefer: list[Column], expected: int | None = None) -> Staged:
        """Write what an upsert makes of the buckets that it touches. Of several rows with one key the first by ``prefer``
        counts, and any new row before an old one. ``expected``: how many rows the whole table must have then."""
        chain = self._chain()
        last = chain[-1] if chain else None
        given = materialize(fresh.withColumn("_bucket", self._bucket()), "fresh")
        require_empty(given.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)), "a row without its key")
        touched = sorted(r[0] for r in given.select("_bucket").distinct().collect())  # at most a row for each bucket
        plain = given.drop("_bucket")
        schema = last.schema if last else plain.schema.json()
        kept = dict(last.folders) if last else {}
        if last and {(f["name"], str(f["type"])) for f in json.loads(schema)["fields"]} != {(f["name"], str(f["type"])) for f in plain.schema.jsonValue()["fields"]}:
            raise ExpectationError("new rows have other columns than the table")
        old = self._open(schema, [kept[b] for b in touched if b in kept])
        merged = upsert(old, plain.select(*old.columns), self.keys, prefer)
        commit = uuid.uuid4().hex
        folder = f"{self.root}/data/{commit}"
        merged.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(folder)
        folders = kept | {b: f"{folder}/bucket={b}" for b in touched}
        whole = self._open(schema, sorted(folders.values()))
        n = whole.count()
        require_empty(unique(self._open(schema, [folders[b] for b in touched]), self.keys), "a key was written twice")
        if expected is not None and n != expected:
            raise ExpectationError(f"{n} rows, {expected} expected")
        return Staged(last.version if last else 0, commit, n, schema, folders)

    def commit(self, staged: Staged) -> int:
        """Make a staged upsert the newest version, unless another one from the same version came first."""
        if self.version() != staged.base:
            raise ConflictError(f"version {staged.base} is no longer the newest")
        row = (staged.base + 1, staged.base, staged.commit, staged.n_rows, staged.schema, staged.folders)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        if next(r.commit for r in self._chain() if r.base == staged.base) != staged.commit:
            raise ConflictError(f"version {staged.base} is no longer the newest")
        return staged.base + 1

    def upsert(self, fresh: DataFrame, prefer: list[Column], expected: int | None = None) -> int:
        """Stage and commit; the new version."""
        return self.commit(self.stage(fresh, prefer, expected))
