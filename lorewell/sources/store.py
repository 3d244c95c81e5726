"""Tables by key in a folder, kept in buckets and published together.

A key's bucket is a hash of it.  A commit writes new files for the buckets that
it touches, into a folder of its own, and then one small pointer file that says
for every table which run holds each bucket.  The pointer gets its name by a
rename, so readers see all tables as of one commit, or as of the one before; a
commit that is lost on the way leaves files that no pointer names.  Buckets
that a commit does not touch stay as they are, whatever their number.

One writer commits at a time; a second one that publishes the same version
fails.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell.sources import scratch

#: Published versions that are kept, the newest among them.
KEPT = 3


class Change(NamedTuple):
    """Rows that come into a table, and a table of keys whose old rows go (those of the new rows, if none is given)."""

    rows: DataFrame
    replaced: DataFrame | None = None


class Store:
    """Bucketed tables under ``root``; ``keys`` names each table's key column.

    The number of buckets is fixed by the first commit.  Choose it so that a
    bucket of the largest table fits a task: one task writes a bucket.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        known = self.pointer()
        if known:
            self.buckets = known["buckets"]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """Published versions, in order."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def pointer(self, version: int | None = None) -> dict | None:
        """What a version (the newest, if none is given) consists of; None before the first commit."""
        if version is None:
            version = max(self.versions(), default=None)
            if version is None:
                return None
        stream = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tag(self) -> str:
        """What the last commit was marked with."""
        return (self.pointer() or {}).get("tag", "")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a table, of some buckets if asked for; None if it was never committed."""
        pointer = self.pointer(version)
        known = (pointer or {}).get("tables", {}).get(table)
        if known is None:
            return None
        schema = StructType.fromJson(known["schema"])
        wanted = {str(b) for b in only} if only is not None else None
        paths = [f"{self.root}/{table}/{run}/bucket={b}" for b, run in known["buckets"].items() if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _touched(self, keys: DataFrame, key: str) -> list[int]:
        return [r.b for r in keys.select(self.bucket(F.col(key)).alias("b")).distinct().collect()]  # a number a bucket at most

    def write(self, table: str, change: Change, run: str) -> dict:
        """Write the touched buckets as they will be; returns the table's entry for a pointer, which nobody reads yet."""
        key = self.keys[table]
        rows = scratch.kept(change.rows)  # read several times below
        replaced = rows.select(key).distinct() if change.replaced is None else scratch.kept(change.replaced.select(key).distinct())
        touched = self._touched(rows.select(key).unionByName(replaced), key)
        known = (self.pointer() or {}).get("tables", {}).get(table, {"schema": None, "buckets": {}})
        old = self.read(table, only=touched)
        after = rows if old is None else old.join(replaced, key, "left_anti").unionByName(rows, allowMissingColumns=True)
        placed = after.withColumn("bucket", self.bucket(F.col(key)))
        placed.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{table}/{run}")
        there = self._written(table, run)
        buckets = {b: r for b, r in known["buckets"].items() if int(b) not in set(touched)} | {b: run for b in there}
        return {"schema": json.loads(after.schema.json()), "buckets": buckets}

    def _written(self, table: str, run: str) -> list[str]:
        """Buckets that a run has files of."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{table}/{run}"))]
        return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]

    def commit(self, changes: dict[str, Change], tag: str = "") -> int:
        """Write all changes and publish them as one version, whose number is returned."""
        before = self.pointer() or {"version": 0, "tables": {}}
        run = f"run-{uuid.uuid4().hex}"
        tables = before["tables"] | {name: self.write(name, change, run) for name, change in changes.items()}
        version = before["version"] + 1
        self.publish({"version": version, "tag": tag, "buckets": self.buckets, "tables": tables})
        self.vacuum()
        return version

    def publish(self, pointer: dict) -> None:
        folder, name = "versions", f"{pointer['version']:012d}.json"
        waiting, final = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{name}")
        if self._fs.exists(final):
            raise RuntimeError(f"version {pointer['version']} of {self.root} was published by another writer")
        out = self._fs.create(waiting, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if not self._fs.rename(waiting, final):
            raise RuntimeError(f"version {pointer['version']} of {self.root} was published by another writer")

    def vacuum(self, keep: int = KEPT) -> None:
        """Delete versions but the last ``keep``, and runs that none of these names and that are older than the newest.

        A commit that is under way is not known here, so run it from the writer alone.
        """
        all_ = self.versions()
        held = [self.pointer(v) for v in all_[-keep:]]
        for v in all_[:-keep]:
            self._fs.delete(self._path(f"versions/{v:012d}.json"), False)
        for table in {t for p in held for t in p["tables"]}:
            used = {run for p in held for run in p["tables"].get(table, {"buckets": {}})["buckets"].values()}
            for status in self._fs.listStatus(self._path(table)):
                if status.getPath().getName() not in used:
                    self._fs.delete(status.getPath(), True)
