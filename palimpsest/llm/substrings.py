"""Exact substring deduplication over a log-structured index of fingerprints.

Every window of SIZE words is represented by the smallest hash of its K-word grams, so equal windows have equal fingerprints
and about one word in seven has one. The index holds the fingerprints of earlier batches as immutable runs, bucketed and
sorted; a batch's fingerprints are merge-joined with each run, become a run themselves, and runs are compacted into one when there
are more than `fan`. Windows with a fingerprint that occurs again, in the batch or in history, are candidates; they are verified by
two independent hashes of all their words, 96 bits together, and all but the first occurrence are removed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.links import membership
from palimpsest.llm.shared import fresh, remove, scratch, stash, sweep

SIZE, K = 20, 8
_MAX = np.uint64((1 << 64) - 1)
_LAST = (1 << 63) - 1


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n values in a row."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word hashes, row of each word, first words, fingerprint of each window, whether it lies in one row, starts and ends of words)."""
    s, e, wo = W.spans(data, off, W.NON_SPACE)
    h = W.hashes(data, s, e)
    least = _slide(W.ngrams(h, K), SIZE - K + 1, np.minimum) if len(h) >= SIZE else np.zeros(0, np.uint64)
    return h, W.row_of(wo), wo, least, W.within_rows(wo, SIZE, len(h)), s, e


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, c): the fingerprints of all windows, and at how many places they stand."""

    def run(batches):
        for batch in batches:
            data, off = W.buffers(batch.column(0))
            for i, j in W.slices(off):
                h, _, _, least, ok, _, _ = _windows(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(least):
                    continue
                grams = W.ngrams(h, K)
                chosen = np.concatenate([np.zeros(SIZE - K, np.uint64), np.where(ok, least, 0), np.zeros(SIZE - K, np.uint64)])
                at = _slide(chosen, SIZE - K + 1, np.maximum) == grams
                u, c = np.unique(grams[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["fp", "c"])

    return docs.select("text").mapInArrow(run, "fp long, c long").groupBy("fp").agg(F.sum("c").alias("c"))


class Index:
    """Runs of fingerprints as bucketed, sorted tables in the shared folder. A merge join reads a run without exchange or sort."""

    def __init__(self, spark: SparkSession, buckets: int = 32, fan: int = 4):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.runs: list[str] = []
        self._paths: dict[str, str] = {}

    def seen(self, fps: DataFrame) -> DataFrame:
        """Those of fps (fp) that some run holds."""
        out = fps.limit(0)
        for run in self.runs:
            out = out.unionByName(fps.join(self.spark.table(run), "fp", "left_semi"))
        return out.distinct()

    def add(self, fps: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        self._paths[name] = fresh(self.spark, name, keep=True)
        fps.select("fp").repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", self._paths[name]).saveAsTable(name)
        self.runs.append(name)
        if len(self.runs) > self.fan:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one; the old ones, and their files, go once the new one is written."""
        old, self.runs = self.runs, []
        merged = self.spark.table(old[0])
        for run in old[1:]:
            merged = merged.unionByName(self.spark.table(run))
        self.add(merged.distinct())
        self._drop(old)

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")
            remove(self.spark, self._paths.pop(run))

    def close(self) -> None:
        """Drops the runs: the index ends with the job that made it."""
        self._drop(self.runs)
        self.runs = []


def _candidates(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(w, v, id, start) of the windows whose fingerprint may be one of those repeated; of a row's equal windows the first, and
    the others apart."""
    wanted = membership(repeated)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = W.buffers(batch.column(1))
            for i, j in W.slices(off):
                part = data[off[i] : off[j]]
                h, row, wo, least, ok, s, e = _windows(part, off[i : j + 1] - off[i])
                at = np.flatnonzero(ok)
                at = at[wanted.value(least[at].view(np.int64))] if len(at) else at
                if not len(at):
                    continue
                inside = np.zeros(len(h) + 1, np.int64)
                np.add.at(inside, at, 1)
                np.add.at(inside, at + SIZE, -1)
                mine = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                other = np.zeros(len(h), np.uint64)
                other[mine] = W.hashes(part, s[mine], e[mine], 0x5851F42D4C957F2D)
                w, v = W.ngrams(h, SIZE)[at], W.ngrams(other, SIZE)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), pa.array((v >> W.U64(32)).astype(np.int64).astype(np.uint32).view(np.int32)), pa.array(ids[i + row[at]]), pa.array((at - wo[row[at]]).astype(np.int64))],
                    ["w", "v", "id", "start"],
                )

    return docs.select("id", "text").mapInArrow(run, "w long, v int, id long, start long")


def add_batch(index: Index, batch: DataFrame, history: DataFrame) -> DataFrame:
    """(id, starts): the windows of the batch that stand earlier, in it or in history; and the batch joins the index. Both
    frames hold (id, text), every id of history below those of the batch."""
    with scratch(batch.sparkSession):
        fps = stash(fingerprints(batch), "fingerprints")
        old = stash(index.seen(fps.select("fp")), "seen")
        repeated = stash(fps.where("c > 1").select("fp").unionByName(old).distinct(), "repeated")
        index.add(fps)
        rows = _candidates(batch, repeated).withColumn("new", F.lit(True))
        if old.head(1):
            rows = rows.unionByName(_candidates(history, old).withColumn("new", F.lit(False)))
        sweep(batch.sparkSession)
        rows = stash(rows, "windows")
        first = rows.groupBy("w", "v").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        first = stash(first, "repeats")  # a table of its own: the join can then split a window that has very many rows
        again = rows.where("new").join(first, ["w", "v"]).where(F.struct("id", "start") != F.col("first"))
        return stash(again.groupBy("id").agg(F.collect_set("start").alias("starts")), "removals", keep=True)


def removals(docs: DataFrame, batches: int = 2, fan: int = 4) -> DataFrame:
    """(id, starts) for all documents, taken in `batches` batches of rising doc_id; an id has one row. Runs are compacted when there
    are more than `fan`."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "text")
    cuts = d.select(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    with scratch(docs.sparkSession):
        index, out = Index(docs.sparkSession, fan=fan), None
        try:
            for i in range(len(cuts) + 1):
                new = d.where(F.col("id") > cuts[i - 1]) if i else d
                new = new.where(F.col("id") <= cuts[i]) if i < len(cuts) else new
                part = add_batch(index, new, d.where(F.col("id") <= cuts[i - 1]) if i else d.limit(0))
                out = part if out is None else out.unionByName(part)
        finally:
            index.close()
        return stash(out.withColumn("starts", F.array_sort("starts")), "removals", keep=True)


def dedup(docs: DataFrame, *, batches: int = 2, fan: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space).

    Words are runs between ASCII white space, unchanged. A word goes if a window of 20 words that covers it stands earlier too: in a
    document of smaller id, or earlier in the same one; windows are judged on the input. A null or empty text has no words. Null
    ids come last and count as one id; rows of one id count as one document, so repeated rows do not remove each other.
    """
    gone = removals(docs, batches, fan).select(F.col("id").alias("gone_id"), "starts")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.join(gone, F.coalesce("doc_id", F.lit(_LAST)) == F.col("gone_id"), "left").select("doc_id", "text", "starts")

    def run(batches):
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            lists = batch.column(2)
            at = np.append(0, np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)))).astype(np.int64)
            starts = lists.flatten().to_numpy(zero_copy_only=False)
            for i, j in W.slices(off):
                part = data[off[i] : off[j]]
                s, e, wo = W.spans(part, off[i : j + 1] - off[i], W.NON_SPACE)
                n = np.diff(wo)
                row = np.repeat(np.arange(j - i), at[i + 1 : j + 1] - at[i:j])
                mine = starts[at[i] : at[j]]
                mine, row = mine[mine + SIZE <= n[row]], row[mine + SIZE <= n[row]]
                marks = np.zeros(len(s) + 1, np.int64)
                np.add.at(marks, wo[row] + mine, 1)
                np.add.at(marks, wo[row] + mine + SIZE, -1)
                keep = np.cumsum(marks[:-1]) == 0
                size = (e - s + 1)[keep]  # with a space after each
                to = np.append(0, np.cumsum(size))
                flat = np.full(to[-1], 32, np.uint8)
                inside = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
                flat[np.repeat(to[:-1], size - 1) + inside] = part[np.repeat(s[keep], size - 1) + inside]
                left = np.append(0, np.cumsum(keep))[wo]
                a, b = to[left[:-1]], np.maximum(to[left[1:]] - 1, to[left[:-1]])
                raw = flat.tobytes()
                kept = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(n - np.diff(left)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return d.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
