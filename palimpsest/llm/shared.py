"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SPACED = r"[^\x20\x09-\x0D]+"
#: The paths that each open scratch() has to remove, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context. Where neither is set, a temporary one on a single machine, as in
    tests; on a cluster executors would not see it, and that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stashed inside goes at the end, but for what is kept for the caller; the shuffle files of the steps go with it, as
    Spark drops them once nothing refers to them."""
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for p in paths:
            remove(spark, p)
        sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer held."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed at the end of the open scratch(), with keep of the one around it, and at the
    latest when the driver exits."""
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    scopes = _OPEN.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet and read again: it is computed once, and a lost executor costs only a read. See fresh() for how long."""
    spark = df.sparkSession
    path = fresh(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, for workers that read it without Spark."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", path)))


class Shipped:
    """An object broadcast with its classes by value, which broadcasts alone send by name."""

    def __init__(self, spark: SparkSession, value):
        self._sent, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._sent.value)
        return self._value
