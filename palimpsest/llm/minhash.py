"""Near duplicates by b-bit MinHash.

Documents of one shingle set are one node. A node has HASHES minima; bands of the first POOL of them make buckets, and all
of them keep their low four bits, packed. In a bucket every node is compared with a leader, the node that meets most others over all
its buckets; nodes of different components that are left in a bucket are then compared with each other. A comparison first
corrects the share of equal low bits for chance collisions, and drops pairs more than five standard deviations below the
threshold; the rest is decided on the full sets, whatever their size. So no link is lost but those that share no band (one in two million at the
threshold of 0.85), and a group of copies costs a star, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.links import grouped, membership
from palimpsest.llm.shared import free, scratch, stash

HASHES, POOL, BITS = 256, 128, 4
LONGS = HASHES * BITS // 64
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SEEDS = _RNG.integers(0, 1 << 63, POOL, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each lower-cased text, and where each text's begin. A text of fewer
    words, but at least one, has one shingle: all its words."""
    low = W.LOWER[data]
    s, e, wo = W.spans(low, off, W.NON_SPACE)
    h = W.hashes(low, s, e)
    n = np.diff(wo)
    parts, rows = [], []
    for m in range(1, k + 1):
        g = W.ngrams(h, m) ^ W.mix(np.array([m], np.uint64))
        ok = W.within_rows(wo, m, len(h))
        row = W.row_of(wo)[: len(g)]
        ok &= n[row] == m if m < k else n[row] >= k
        parts.append(g[ok])
        rows.append(row[ok])
    g, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(off)))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _set_hash(g: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return W.mix(np.add.reduceat(W.mix(g), start) + W.mix(sizes.astype(np.uint64)))


def _signatures(g: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set hash, packed low bits, band keys) of the texts that have shingles."""
    full = np.flatnonzero(np.diff(at))
    start = at[:-1][full]
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros((0, LONGS), np.uint64), np.zeros((0, POOL // rows), np.uint64)
    sets = _set_hash(g, start, np.diff(at)[full])
    packed = np.zeros((len(full), LONGS), np.uint64)
    bands = np.zeros((len(full), POOL // rows), np.uint64)
    for i in range(HASHES):
        least = np.minimum.reduceat(g * _MUL[i] + _ADD[i], start)
        bits = W.mix(least) & np.uint64((1 << BITS) - 1)
        packed[:, i * BITS // 64] |= bits << np.uint64(i * BITS % 64)
        if i // rows < bands.shape[1]:
            bands[:, i // rows] = W.mix(bands[:, i // rows] ^ least) if i % rows else W.mix(least ^ _SEEDS[i // rows])
    return sets, packed, bands


def _sketched(docs: DataFrame, k: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            for i, j in W.slices(off):
                g, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                full = np.diff(at) > 0
                sets, packed, bands = _signatures(g, at, rows)
                idx = np.cumsum(full) - 1
                pick = pa.array(idx, mask=~full)
                cols = [pa.FixedSizeListArray.from_arrays(pa.array(_signed(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (packed, bands)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(_signed(sets)).take(pick), *[c.take(pick) for c in cols]], ["doc_id", "n_shingles", "node", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sig array<long>, bands array<long>")


def _sets(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(node, set) of the nodes asked for. A filter of their hashes picks the texts, so no text is shuffled."""
    wanted = membership(asked)

    def run(batches):
        for batch in batches:
            data, off = W.buffers(batch.column(1))
            pick = np.flatnonzero(wanted.value(batch.column(0).to_numpy(zero_copy_only=False)))
            for r in pick:
                g, at = shingles(data[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]), k)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(_set_hash(g, at[:1], at[1:]))), pa.array([_signed(g)], pa.list_(pa.int64()))], ["node", "set"])

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(ids.alias("doc_id"), "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def _estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures, corrected for low bits that agree by chance."""
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(HASHES)) - chance) / (1 - chance)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return two.where(_alike(F.col("sa"), F.col("sb"), percent)).select("a", "b")


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union, said by the intersection alone so that it is made once."""
    return F.size(F.array_intersect(a, b)) * (100 + percent) >= percent * (F.size(a) + F.size(b))


def groups(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """Documents by component: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct shingles of k lower-cased words (see shingles()); documents are linked if 100 times the
    size of the intersection of their sets is at least percent times that of the union. component_id: the smallest doc_id
    reachable over links; kept: whether it is the document's own. A null or empty text has no set and is a component of its own.
    A null id takes part, and is not the smallest unless there is no other; repeated ids with one text are kept or not
    together. Other columns are not read. percent is at least 80.
    """
    if percent < 80:
        raise ValueError("bands are laid out for 80 % or more")
    with scratch(docs.sparkSession):
        return stash(_groups(docs, k, percent), "minhash-groups", keep=True)


def _groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    rows = 5 if percent >= 85 else 4
    sketched = stash(_sketched(docs, k, rows), "minhash")
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    nodes = stash(nodes, "minhash-nodes")
    sd = float(np.sqrt((percent / 100) * (1 - percent / 100 + 1 / 16) / HASHES) / (15 / 16))
    least = percent / 100 - 5 * sd

    def near(x: Column, y: Column) -> Column:
        return (F.least(x["n"], y["n"]) * 100 >= percent * F.greatest(x["n"], y["n"])) & (_estimate(x["sig"], y["sig"]) >= least)

    def sets(asked: DataFrame) -> DataFrame:
        found = _sets(docs, asked.join(nodes.select("node", "doc"), "node").select(F.coalesce("doc", F.lit(-(1 << 63)))), k)
        return found.join(asked, "node", "left_semi")  # the filter lets strangers pass

    def confirm(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return _linked(pairs, sets(stash(asked, "minhash-asked")), percent)

    member = nodes.select("node", F.explode("bands").alias("key"))
    bands = range(POOL // rows)
    first = lambda g, h: F.coalesce(*[F.when(F.get(g, F.lit(i)) == F.get(h, F.lit(i)), F.get(g, F.lit(i))) for i in bands])
    held = (lambda asked: sets(stash(asked, "minhash-asked")).select("node", F.col("set").alias("full")), lambda x, y: _alike(x, y, percent))
    label = grouped(member, nodes.select("node", F.struct("n", "sig").alias("f")), near, confirm, "minhash", held, (nodes.select("node", F.col("bands").alias("g")), first))
    node = nodes.select("node", "doc").join(label, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    least_doc = node.groupBy("root").agg(F.min("doc").alias("component_id"))
    node = node.join(least_doc, "root").select("node", "component_id")
    out = sketched.select("doc_id", "n_shingles", "node").join(node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each of groups(), with all its columns. A null or empty text stays; of rows that share the smallest id, each
    with its own text stays; an empty table stays empty; further columns, whatever they are called, come through."""
    (name,) = free(docs, "kept_id")
    kept = groups(docs, k=k, percent=percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
