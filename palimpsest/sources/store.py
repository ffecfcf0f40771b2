"""A history on disk: immutable Parquet directories named by numbered manifests.

A commit writes one directory, partitioned by the month of valid_to: the versions that it closed, and in the last month all that are
open. Directories of closed versions are only added; the open ones are those of the newest. Then the next manifest is put into place; a
reader pins the manifest it found. A job that dies leaves unnamed directories and no visible change, and can be run again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.period import month
from palimpsest.operators.reader import BUCKET
from palimpsest.plans.spec import ConflictError, TemporalError


#: The month of the open end.
OPEN_MONTH = "9999-12"


class Files:
    """Small files through Hadoop's file systems: whatever store Spark reaches, these reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        p = self.path(folder) if folder else self._path(self.root)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> None:
        """All or nothing: fails if the name is taken, so of two writers one loses. On a local disk the finished file is linked to
        its name, elsewhere renamed: both refuse a name that exists, in one step. A store whose rename replaces files must be
        given a file system that commits conditionally."""
        tmp, to = self.path(f"{name}.{uuid.uuid4().hex}.tmp"), self.path(name)
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(content, indent=1).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                local = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.spark._jvm.java.nio.file.Files.createLink(local(to), local(tmp))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" not in str(e.java_exception):
                        raise
                    raise ConflictError(f"another writer published {self.root}/{name}") from None
            elif self.fs.exists(to) or not self.fs.rename(tmp, to):
                raise ConflictError(f"another writer published {self.root}/{name}")
        finally:
            self.fs.delete(tmp, False)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise TemporalError(f"cannot rename {old} to {new} in {self.root}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class HistoryStore:
    """The manifests and the data of one entity."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def manifest(self) -> dict | None:
        found = [n for n in self.files.names("") if n.startswith("manifest-") and n.endswith(".json")]
        return self.files.read(found[-1]) if found else None

    def commit(self, base: dict | None, **changed) -> dict:
        new = {"open": [], "closed": [], "horizon": None, "batches": [], "streams": {}, "sequence": 0, **(base or {}), **changed}
        new["version"] = (base or {}).get("version", 0) + 1
        self.files.publish(f"manifest-{new['version']:010d}.json", new)
        return new

    def write(self, df: DataFrame, folder: str, key: list[str], vt: str) -> str:
        """Sorted inside files, so that row groups can be skipped by key."""
        name = f"{folder}/{uuid.uuid4().hex}"
        out = df.drop(BUCKET).withColumn(BUCKET, month(F.col(vt))).sortWithinPartitions(BUCKET, *key)
        out.write.partitionBy(BUCKET).parquet(f"{self.files.root}/{name}")
        return name

    def read(self, folders: dict[str, list[str]], schema: T.StructType) -> DataFrame:
        """folders: of the parts "open" and "closed". Both may name one folder, whose last month holds its open rows. Columns that older
        files lack are null; the partition bucket stays text and prunes directories.

        folder@month names the part of a folder that lies after that month: what pruning has left of it.
        """
        full = T.StructType([*schema.fields, T.StructField(BUCKET, T.StringType())])
        out = None
        for part, names in folders.items():
            for name in names:
                folder, _, floor = name.partition("@")
                rows = self.spark.read.schema(full).parquet(f"{self.files.root}/{folder}")
                rows = rows.where(F.col(BUCKET) == OPEN_MONTH if part == "open" else F.col(BUCKET) < OPEN_MONTH)
                rows = rows.where(F.col(BUCKET) > floor) if floor else rows
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], full) if out is None else out

    def vacuum(self) -> int:
        """Removes directories that the newest manifest does not name. Not while readers of older manifests run."""
        base, gone = self.manifest() or {"open": [], "closed": []}, 0
        closed = {name.partition("@")[0]: name.partition("@")[2] for name in base["closed"]}
        for top in ("open", "closed", "data"):
            for name in (f"{top}/{n}" for n in self.files.names(top)):
                old = [name] if name not in closed and name not in base["open"] else []
                for n in [] if old else self.files.names(name):
                    month_ = n.partition("=")[2]
                    if n.startswith(BUCKET) and (month_ == OPEN_MONTH and name not in base["open"] or month_ < OPEN_MONTH and (name not in closed or month_ <= closed[name])):
                        old.append(f"{name}/{n}")
                for x in old:
                    self.files.delete(x)
                gone += len(old)
        return gone
