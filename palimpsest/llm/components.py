"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import scratch, stash

#: Edges that a task contracts at once.
CHUNK = 200_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(r)


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as (a, b): each node but a component's smallest with the smallest."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(names)))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for i in range(len(root)):
        root[i] = root[root[i]]  # a root is smaller than its nodes, and so is final already
    r = np.array(root, np.int64)
    moved = np.flatnonzero(r != np.arange(len(r)))
    return names[moved], names[r[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            n += batch.num_rows
            if n >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _contract(*map(np.concatenate, zip(*held, strict=True)))], ["a", "b"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _contract(*map(np.concatenate, zip(*held, strict=True)))], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), in any direction, repeats and loops allowed. Returns (node, root) for every node of an edge that
    is no loop, root being the component's smallest node. Each round is written to the shared folder; a node's neighbours are
    only ever reduced to their minimum, with partial aggregation, so a node may have any number of them. First, tasks contract the edges
    they hold, in bounded chunks; where that joins all there is, one round confirms it."""
    with scratch(edges.sparkSession):
        e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        e = stash(_contracted(e), "edges")
        state = _state(e)
        while True:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a")
            small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
            e = stash(small, "edges")
            new = _state(e)
            if new == state:
                break
            state = new
        out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return stash(out, "components", keep=True)
