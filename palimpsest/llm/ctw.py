"""A language model of bytes by context-tree weighting, beside a base of single tokens.

A byte is eight binary decisions; each of the 255 prefixes has a context tree over the preceding DEPTH bytes, whose nodes keep the
Krichevsky-Trofimov estimate of their counts. A node's weighted probability is the mean of its own estimate and of the
product of its children's, so the trees of all depths are mixed; learned counts fix the share with which each depth
predicts. Where a context was never seen, its share goes to the deepest one that was. Every context of the training texts is kept,
so the model grows with the corpus, and lies in the shared folder alone: the distinct (DEPTH + 1)-grams of bytes are dealt by
the two nearest bytes of their context, a task holds the subtrees of a few such pairs at a time, and only the 65280 sums above
them come together on the driver. What comes out is a table of grams in order with the probability of each one's last byte; a task of the
scoring gathers the grams of some megabytes of text and goes through that table, file by file, once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.labelled import remainder
from palimpsest.llm.shared import Shipped, fresh, open_fs, scratch, stash

DEPTH = 5
#: Tokens with at least this share of the training tokens are shipped to the scorers; there are at most 1 / FREQUENT.
FREQUENT = 1 / (1 << 17)
#: The token that ends a text, and the byte that does: UTF-8 has none such.
END = np.uint64(0xE0DE0DE0DE0DE0D1)
STOP = 255
#: Grams whose subtrees a task builds at once, unless one pair of bytes has more (some 1.1 KB each), and bytes of text that it scores
#: at once.
FOREST, CHUNK = 100_000, 1 << 24
#: Rows of the table of grams that a lookup holds at once.
ROWS = 1 << 16
_LN2 = float(np.log(2))


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last DEPTH + 1 bytes at each byte of each text and at its end, as numbers, and where each text's begin. Before a
    text stand STOP bytes."""
    n = len(off) - 1
    sizes = np.diff(off)
    buf = np.full(len(data) + n * (DEPTH + 1), STOP, np.int64)
    row = np.repeat(np.arange(n), sizes)
    buf[np.arange(len(data)) + row * (DEPTH + 1) + DEPTH] = data
    key = np.zeros(len(buf) - DEPTH, np.int64) if n else np.zeros(0, np.int64)
    for j in range(DEPTH + 1):
        key = (key << 8) | buf[j : len(buf) - DEPTH + j]
    first = off[:-1] + np.arange(n) * (DEPTH + 1)
    keep = np.zeros(len(key) + 1, np.int32)
    np.add.at(keep, first, 1)
    np.add.at(keep, first + sizes + 1, -1)
    return key[np.cumsum(keep[:-1]) > 0], np.append(off[:-1] + np.arange(n), len(data) + n)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _counted(docs: DataFrame, of, name: str) -> DataFrame:
    """(name, c): how often the numbers that of(data, off) gives stand in texts that are not held out, summed within tasks first; 0
    for those of held-out texts alone. docs: (text, held_out); of() gives numbers and the row of each."""

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            data, off = W.buffers(batch.column(0))
            learn = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in W.slices(off):
                k, row = of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                order = np.argsort(k)
                k = k[order]
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                u, c = k[first], np.add.reduceat(learn[i:j][row[order]].astype(np.int64), first) if len(first) else first
                keys.append(u)
                counts.append(c)
                held += len(u)
                if held > 4_000_000:
                    keys, counts = ([x] for x in _summed(keys, counts))
                    if len(keys[0]) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], [name, "c"])
                        keys, counts = [], []
                    held = sum(map(len, keys))
        if keys:
            k, c = _summed(keys, counts)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], [name, "c"])

    return docs.select("text", "held_out").mapInArrow(run, f"{name} long, c long").groupBy(name).agg(F.sum("c").alias("c"))


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = W.LOWER[data]
    s, e, wo = W.spans(low, off, W.NON_SPACE)
    return np.concatenate([W.hashes(low, s, e), np.full(len(off) - 1, END)]), np.concatenate([W.row_of(wo), np.arange(len(off) - 1)])


def _gram_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, begin = _grams(data, off)
    return keys, np.repeat(np.arange(len(off) - 1), np.diff(begin))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series at x + 7."""
    shift = np.zeros_like(x)
    for i in range(7):
        shift += np.log(x + i)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - shift


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 where nothing was counted, as at most nodes; the rest in pieces that stay in the processor's cache."""
    out = np.zeros(a.shape)
    seen = np.flatnonzero(a.ravel() + b.ravel())
    fa, fb, flat = a.ravel(), b.ravel(), out.ravel()
    for i in range(0, len(seen), 16384):
        at = seen[i : i + 16384]
        x, y = fa[at], fb[at]
        flat[at] = _lgamma(x + 0.5) + _lgamma(y + 0.5) - 1.1447298858494002 - _lgamma(x + y + 1.0)
    return out


def _weighted(own: np.ndarray, below: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the weighted probability of nodes with children, and the share that a node keeps to itself."""
    lw = np.where(seen, np.logaddexp(own, below) - _LN2, 0.0)
    return lw, np.where(seen, np.exp(np.minimum(0.0, own - _LN2 - lw)), 1.0)


def _subtrees(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys: the distinct grams of some pairs of nearest bytes, all of each. Returns (grams, 8): the probability of each bit of the last
    byte by the contexts of two bytes or more, NaN where not even that of two was seen; and for the prefixes under one byte of
    context, as byte << 8 | prefix, the sum of the logarithms of their children's weighted probabilities."""
    level = np.arange(8)
    byte = keys & 255
    prefix = (1 << level) | (byte[:, None] >> (8 - level))
    bit = (byte[:, None] >> (7 - level)) & 1
    q = parent = lw = None
    for d in range(DEPTH, 1, -1):  # one depth is held at a time: they are what takes memory
        ids = ((keys >> 8) & ((1 << (8 * d)) - 1))[:, None] << 8 | prefix
        names, at = np.unique(ids.ravel(), return_inverse=True)
        del ids
        at = at.reshape(bit.shape).astype(np.int32)
        ones = np.bincount(at.ravel(), (bit * count[:, None]).ravel(), len(names))
        zeros = np.bincount(at.ravel(), np.repeat(count, 8), len(names)) - ones
        seen, own = zeros + ones > 0, _log_kt(zeros, ones)
        if d == DEPTH:
            lw, stay = own, np.ones(len(own))
        else:
            lw, stay = _weighted(own, np.bincount(np.searchsorted(names, parent), lw, len(names)), seen)
        one = (ones + 0.5) / (zeros + ones + 1)
        parent = ((names >> 8) & ((1 << (8 * (d - 1))) - 1)) << 8 | names & 255
        p = np.where(bit == 1, one[at], 1 - one[at])
        if q is not None:
            p = np.where(np.isnan(q), p, stay[at] * p + (1 - stay[at]) * q)
        p[~seen[at]] = np.nan
        q = p
    top, at = np.unique(parent, return_inverse=True)
    return q, top, np.bincount(at, lw, len(top))


class Root:
    """The nodes without context and with one byte of it, for all 255 prefixes; 256 * 256 numbers whatever the corpus."""

    def __init__(self, counts: np.ndarray, below: np.ndarray):
        """counts: (byte of context, byte): how often; below: (byte of context, prefix): what _subtrees() gave, summed."""
        zeros, ones = np.zeros((256, 256)), np.zeros((256, 256))
        for level in range(8):
            c = counts.reshape(256, 1 << level, 2, 128 >> level).sum(-1)
            zeros[:, 1 << level : 2 << level], ones[:, 1 << level : 2 << level] = c[:, :, 0], c[:, :, 1]
        own, seen = _log_kt(zeros, ones), zeros + ones > 0
        lw, self.stay = _weighted(own, below, seen)
        self.seen, self.one = seen, (ones + 0.5) / (zeros + ones + 1)
        a, b = zeros.sum(0), ones.sum(0)
        self.seen0, self.one0 = a + b > 0, (b + 0.5) / (a + b + 1)
        _, self.stay0 = _weighted(_log_kt(a, b), lw.sum(0), self.seen0)

    def log10(self, keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of the grams' last bytes; q as _subtrees() gives it."""
        level = np.arange(8)
        byte, ctx = keys & 255, (keys >> 8) & 255
        prefix = (1 << level) | (byte[:, None] >> (8 - level))
        bit = (byte[:, None] >> (7 - level)) & 1
        at = (ctx[:, None], prefix)
        p = np.where(bit == 1, self.one[at], 1 - self.one[at])
        q = np.where(self.seen[at], np.where(np.isnan(q), p, self.stay[at] * p + (1 - self.stay[at]) * q), np.nan)
        p = np.where(bit == 1, self.one0[prefix], 1 - self.one0[prefix])
        q = np.where(self.seen0[prefix], np.where(np.isnan(q), p, self.stay0[prefix] * p + (1 - self.stay0[prefix]) * q), 0.5)
        return np.log10(np.maximum(q, 1e-12)).sum(axis=1)


def _forest(grams: DataFrame) -> DataFrame:
    """(gram, q) of all grams, and rows whose gram is -1 - (byte << 8 | prefix) with the sums of _subtrees(). Grams are dealt by the two
    nearest bytes and come in their order, so that a task holds some whole pairs at a time."""

    def out(keys, counts):
        k, c = np.concatenate(keys), np.concatenate(counts)
        q, top, sums = _subtrees(k, c.astype(float))
        rows = np.zeros((len(top), 8))
        rows[:, 0] = sums
        both = np.concatenate([q, rows])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), 8).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, -1 - top])), lists], ["gram", "q"])

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            k, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            pair = (k >> 8) & 0xFFFF
            if held + len(k) > FOREST:  # cut before the last pair, which may go on
                cut = int(np.searchsorted(np.cumsum(np.append(0, pair[1:] != pair[:-1])), np.count_nonzero(pair[1:] != pair[:-1])))
                if cut or (keys and (keys[-1][-1] >> 8) & 0xFFFF != pair[0]):
                    done = keys + [k[:cut]] if cut else keys
                    yield out(done, counts + [c[:cut]] if cut else counts)
                    keys, counts, held, k, c = [], [], 0, k[cut:], c[cut:]
            keys.append(k)
            counts.append(c)
            held += len(k)
        if keys:
            yield out(keys, counts)

    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.select("gram", "c").withColumn("pair", pair).repartition("pair").sortWithinPartitions("pair").drop("pair").mapInArrow(run, "gram long, q array<double>")


def train(docs: DataFrame) -> tuple[list[str], Root]:
    """docs: (text, held_out). Learns from the texts that are not held out, and writes the grams of all texts, in order, with the
    logarithm of the probability of their last bytes: the files, in order, and the nodes nearest the root."""
    spark = docs.sparkSession
    path = fresh(spark, "ctw-model", keep=True)
    with scratch(spark):
        grams = stash(_counted(docs, _gram_rows, "gram"), "grams")
        forest = stash(_forest(grams), "ctw-forest")
        counts, below = np.zeros((256, 256)), np.zeros((256, 256))
        low = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("g")).agg(F.sum("c").alias("c")).toArrow()
        counts.ravel()[low.column("g").to_numpy()] = low.column("c").to_numpy()
        sums = forest.where("gram < 0").groupBy("gram").agg(F.sum(F.col("q")[0]).alias("s")).toArrow()
        below.ravel()[-1 - sums.column("gram").to_numpy()] = sums.column("s").to_numpy()
        root = Root(counts, below)
        shipped = Shipped(spark, root)

        def run(batches):
            for batch in batches:
                keys = batch.column(0).to_numpy()
                for i in range(0, len(keys), 8192):
                    k = keys[i : i + 8192]
                    q = batch.column(1).slice(i, 8192).flatten().to_numpy(zero_copy_only=False).reshape(len(k), 8)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(shipped.value.log10(k, q).astype(np.float32))], ["gram", "p"])

        table = forest.where("gram >= 0").mapInArrow(run, "gram long, p float")
        table.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(path)
    return sorted(spark.read.schema("gram long, p float").parquet(path).inputFiles()), root


def _looked_up(files: list[str], grams: np.ndarray) -> np.ndarray:
    """The numbers of the grams, which rise, from the table; ROWS of it are held at a time, whatever the size of its row groups."""
    out = np.zeros(len(grams))
    for name in files:
        fs, path = open_fs(name)
        with fs.open_input_file(path) as f:
            for part in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(ROWS, columns=["gram", "p"]):
                key = part.column("gram").to_numpy()
                if not len(key):
                    continue
                a, b = np.searchsorted(grams, key[0], "left"), np.searchsorted(grams, key[-1], "right")
                if a < b:
                    at = np.minimum(np.searchsorted(key, grams[a:b]), len(key) - 1)
                    hit = key[at] == grams[a:b]
                    out[a:b][hit] = part.column("p").to_numpy()[at[hit]]
    return out


def scores(docs: DataFrame, *, divisor: int = 7, kept_back: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    The model and the base learn from the documents whose crc32 of the id as text does not leave kept_back modulo divisor (a
    null id is not held out). Tokens are lower-cased words between ASCII white space, then one end. base_score: the sum of
    log10((c + 1) / (N + V + 1)) over the tokens; score: the model's log10 probability of the text's bytes and its end, so
    -score * log2(10) / bytes is its code length per byte. A null text is empty and has only its end. Repeated documents count and
    score each. Without documents to learn from, c, N and V are 0, and every bit has probability one half. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", divisor) == kept_back, F.lit(False)).alias("held_out"), "text")
    with scratch(docs.sparkSession):
        return stash(_scores(base), "ctw-scores", keep=True)


def _scores(base: DataFrame) -> DataFrame:
    tokens = stash(_counted(base.where("NOT held_out"), _tokens, "token"), "tokens")
    n, v = tokens.agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    often = tokens.where(F.col("c") >= max(2.0, FREQUENT * n)).orderBy("token").toArrow() if n >= 1 / FREQUENT else tokens.where("c < 0").toArrow()
    found = often.column("token").to_numpy().view(np.uint64)
    order = np.argsort(found)
    logs = np.log10(often.column("c").to_numpy()[order].astype(float) + 1)
    shipped = Shipped(base.sparkSession, (train(base)[0], found[order], logs))

    def chunks(batches):
        """Some batches, and of each slice of their rows (batch, first, after, places of its grams among the chunk's); the chunk's grams."""
        held, parts, size = [], [], 0
        for batch in batches:
            data, off = W.buffers(batch.column(2))
            for i, j in W.slices(off):
                keys, begin = _grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                u, inv = np.unique(keys, return_inverse=True)
                held.append(u)
                parts.append((batch, data, off, i, j, begin, inv.astype(np.uint16 if len(u) <= 1 << 16 else np.int32)))
                size += int(off[j] - off[i])
                if size >= CHUNK:
                    yield held, parts
                    held, parts, size = [], [], 0
        if parts:
            yield held, parts

    def run(batches):
        files, freq, logs = shipped.value
        task, at = TaskContext.get().partitionId() << 33, 0
        for held, parts in chunks(batches):
            every = np.unique(np.concatenate(held))
            for k, u in enumerate(held):  # 4 bytes a gram from here
                held[k] = np.searchsorted(every, u).astype(np.int32)
            del u
            p = _looked_up(files, every)
            del every
            for place_of, (batch, data, off, i, j, begin, inv) in zip(held, parts, strict=True):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                score = np.add.reduceat(p[place_of][inv], begin[:-1])
                low = W.LOWER[part]
                s, e, wo = W.spans(low, o, W.NON_SPACE)
                h, row = W.hashes(low, s, e), W.row_of(wo)
                h, row = np.append(h, np.full(j - i, END)), np.append(row, np.arange(j - i))
                place = np.minimum(np.searchsorted(freq, h), max(len(freq) - 1, 0))
                hit = freq[place] == h if len(freq) else np.zeros(len(h), bool)
                sums, known = np.bincount(row[hit], logs[place[hit]], j - i).astype(float), np.bincount(row[hit], minlength=j - i)
                rare, rrow = h[~hit], row[~hit]
                order = np.argsort(rrow, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(rrow, minlength=j - i))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rare[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task + at + np.arange(j - i)), *(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(np.diff(wo) + 1), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(score), lists],
                    ["uid", "doc_id", "held_out", "n_tokens", "found", "sums", "score", "rare"],
                )
                at += j - i
            held.clear()  # before the next chunk is gathered
            parts.clear()
            del p

    d = stash(base.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, found long, sums double, score double, rare array<long>"), "scored")
    rare = d.select("uid", F.explode("rare").alias("token")).groupBy("uid", "token").agg(F.count("*").alias("t")).join(tokens, "token")
    rare = rare.groupBy("uid").agg(F.sum("t").alias("more"), F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("logs"))
    out = d.drop("rare").join(rare, "uid", "left")
    total = F.lit(float(np.log10(n + v + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
        "score",
    )
