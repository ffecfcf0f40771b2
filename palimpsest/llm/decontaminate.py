"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents (a slice of an Arrow batch) gets a suffix array over its words; every suffix of every test item is
looked up in it by binary search. The shards need no exchange: an item's matches are unions over shards, a document's lie in
its own shard. Test items are shipped in blocks of a fixed number of words and searched one block after the other, so neither
side is bounded by memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.shared import Shipped

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "doc_id long, item_id string, doc_start long, item_start long, n_words long"


class SuffixArray:
    """Suffixes of the rows' words in order of their first depth words. Built by packing ranks: words into keys of as many as
    fit 63 bits, their ranks again, until depth words are ordered."""

    def __init__(self, h: np.ndarray, word_off: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        row = W.row_of(word_off)
        self.home = np.arange(len(h)) + row  # a 0 after each row ends its suffixes
        rank = np.zeros(len(h) + len(word_off), np.int64)
        rank[self.home] = ids + 1
        self.levels: list[tuple[int, int, np.ndarray]] = []
        top, length = len(self.vocabulary), 1
        while True:
            bits = max(1, int(top).bit_length())
            k = min(63 // bits, -(-depth // length))
            key = np.zeros(len(rank), np.int64)
            for j in range(k):
                key <<= bits
                key[: max(0, len(rank) - j * length)] |= rank[j * length :]
            self.order = np.argsort(key)
            key = key[self.order]
            new = np.empty(len(key), bool)
            new[:1] = True
            new[1:] = key[1:] != key[:-1]
            self.first = np.flatnonzero(new)
            self.levels.append((bits, k, key[self.first]))
            length *= k
            if length >= depth:
                break
            rank = np.empty(len(key), np.int64)
            rank[self.order] = np.cumsum(new) - 1
            top = len(self.first)
        self.first = np.append(self.first, len(key))

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word hashes, the range [a, b) of the suffixes in order that begin with it."""
        at = np.searchsorted(self.vocabulary, patterns)
        known = (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == patterns) if len(self.vocabulary) else np.zeros(patterns.shape, bool)
        ok = known.all(axis=1)
        lo, last = at.astype(np.int64) + 1, at.astype(np.int64) + 1
        for bits, k, keys in self.levels:
            los, lasts = [], []
            for g in range(0, lo.shape[1], k):
                a, b = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
                for j in range(g, g + k):
                    a, b = a << bits, b << bits
                    if j < lo.shape[1]:
                        a |= lo[:, j]
                        b |= last[:, j]
                    else:
                        b |= (1 << bits) - 1
                los.append(np.searchsorted(keys, a, "left"))
                lasts.append(np.searchsorted(keys, b, "right") - 1)
                ok &= lasts[-1] >= los[-1]
            lo, last = (np.stack([np.minimum(x, len(keys)) for x in y], axis=1).astype(np.int64) for y in (los, lasts))
            lo[~ok] = last[~ok] = 0
        a, b = self.first[lo[:, 0]], self.first[last[:, 0] + 1]
        return np.where(ok, a, 0), np.where(ok, b, 0)


@dataclass
class Block:
    """Distinct windows of some test items, by their number of words, and where they occur: (window, item, start)."""

    ids: list[str]
    windows: dict[int, np.ndarray]
    base: dict[int, int]
    at_window: np.ndarray
    at_item: np.ndarray
    at_start: np.ndarray


def _block(rows: list[tuple[str, str]], size: int, min_words: int) -> Block:
    ids = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(ids)}
    raw = pa.array([r[1] for r in rows], pa.large_string())
    data, off = W.buffers(raw)
    data = W.LOWER[data]
    s, e, wo = W.spans(data, off, W.ALNUM)
    h = W.hashes(data, s, e)
    found: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    for i in range(len(rows)):
        mine = h[wo[i] : wo[i + 1]]
        m = min(size, len(mine))
        for j in range(len(mine) - m + 1 if m and len(mine) >= min_words else 0):
            found.setdefault(m, []).append((mine[j : j + m], number[rows[i][0]], j))
    windows, base, at, total = {}, {}, ([], [], []), 0
    for m, xs in sorted(found.items()):
        windows[m], inv = np.unique(np.stack([x[0] for x in xs]), axis=0, return_inverse=True)
        base[m] = total
        for out, new in zip(at, (inv.ravel() + total, [x[1] for x in xs], [x[2] for x in xs]), strict=True):
            out.append(np.asarray(new, np.int64))
        total += len(windows[m])
    z = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in at]
    order = np.argsort(z[0], kind="stable")
    return Block(ids, windows, base, *(x[order] for x in z))


def blocks(items: DataFrame, size: int = 8, block_words: int = 1_000_000, min_words: int = 1) -> Iterator[Block]:
    """The test items as blocks of about block_words words; one pass over the items, a block in memory at a time."""
    rows, n = [], 0
    for r in items.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        rows.append((r[0], r[1]))
        n += len(r[1]) // 2 + 1
        if n >= block_words:
            yield _block(rows, size, min_words)
            rows, n = [], 0
    if rows:
        yield _block(rows, size, min_words)


def _occurrences(sa: SuffixArray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, window, words in it) of each place where a window of the block stands in the shard."""
    outs = []
    back = np.full(int(sa.home[-1]) + 2 if len(sa.home) else 1, -1, np.int64)
    back[sa.home] = np.arange(len(sa.home))
    for m, patterns in block.windows.items():
        a, b = sa.find(patterns)
        n = b - a
        which = np.repeat(np.arange(len(patterns)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        outs.append((back[sa.order[a[which] + inside]], which + block.base[m], np.full(len(which), m)))
    return tuple(np.concatenate([o[i] for o in outs]) if outs else np.zeros(0, np.int64) for i in range(3))


def _expand(block: Block, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each given window with all its places in the items: (index into window, index of the place)."""
    a, b = np.searchsorted(block.at_window, window, "left"), np.searchsorted(block.at_window, window, "right")
    n = b - a
    return np.repeat(np.arange(len(window)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def _shards(batch: pa.RecordBatch, size: int):
    data, off = W.buffers(batch.column(batch.schema.get_field_index("text")))
    for a, b in W.slices(off, 1 << 20):
        part = W.LOWER[data[off[a] : off[b]]]
        s, e, wo = W.spans(part, off[a : b + 1] - off[a], W.ALNUM)
        yield a, b, wo, SuffixArray(W.hashes(part, s, e), wo, size)


def _report(batch: pa.RecordBatch, shipped: list, size: int, min_items: int) -> dict[str, list]:
    out: dict[str, list] = {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": []}
    for a, b, wo, sa in _shards(batch, size):
        n = int(wo[-1])
        marks = np.zeros(n + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(b - a)]
        row = W.row_of(wo)
        for sent in shipped:
            block = sent.value
            at, window, m = _occurrences(sa, block)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + m, -1)
            pairs = np.unique(np.stack([row[at], window], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            i, place = _expand(block, pairs[:, 1])
            both = np.unique(np.stack([pairs[i, 0], block.at_item[place]], axis=1), axis=0)
            for r, item in both.tolist():
                items[r].add(block.ids[item])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        out["n_words"] += np.diff(wo).tolist()
        out["n_hit"] += (hit[wo[1:]] - hit[wo[:-1]]).tolist()
        out["n_items"] += [len(x) for x in items]
        out["items_sha256"] += [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        out["contaminated"] += [len(x) >= min_items for x in items]
    return out


def _ship(docs: DataFrame, items: DataFrame, size: int, min_words: int = 1) -> list:
    return [Shipped(docs.sparkSession, b) for b in blocks(items, size, min_words=min_words)]


def contamination(docs: DataFrame, items: DataFrame, *, size: int = 8, min_items: int = 2) -> DataFrame:
    """How much of each document stands in the test items.

    Words are runs of letters, digits and non-ASCII code points, lower-cased over A-Z. A window is size consecutive words of
    an item; an item of fewer words, but at least one, is one window. n_hit counts the document's words inside an occurrence of
    a window, n_items the items with an occurring window, items_sha256 digests their ids. contaminated: n_items >= min_items.

    A null or empty text has no words and no items. Items with a null id or text are not searched; items of one id count as
    one. Repeated documents are reported row by row, a null doc_id as null. Other columns are not read. Without items, or
    without documents, nothing is contaminated.
    """
    shipped = _ship(docs, items, size)

    def run(batches):
        for batch in batches:
            out = _report(batch, shipped, size, min_items)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())))], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, REPORT)


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = 8, min_items: int = 2, min_words: int = 1) -> DataFrame:
    """The documents that contamination() does not call contaminated, with all their columns; in one pass, no exchange.
    Items of fewer than min_words words are not searched."""
    shipped = _ship(docs, items, size, min_words)

    def run(batches):
        for batch in batches:
            bad = _report(batch, shipped, size, min_items)["contaminated"]
            yield batch.filter(pa.array([not x for x in bad], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, items: DataFrame, *, size: int = 8) -> DataFrame:
    """Maximal verbatim matches of at least one window: (doc_id, item_id, doc_start, item_start, n_words), starts in words.
    A match cannot be lengthened on either side; the longest match of a test suffix is the one that holds its start."""
    shipped = _ship(docs, items, size)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, wo, sa in _shards(batch, size):
                row = W.row_of(wo)
                for sent in shipped:
                    block = sent.value
                    at, window, m = _occurrences(sa, block)
                    i, place = _expand(block, window)
                    item, start, pos, m = block.at_item[place], block.at_start[place], at[i], m[i]
                    order = np.lexsort((pos, pos - start, item, row[pos]))
                    item, start, pos, m = item[order], start[order], pos[order], m[order]
                    head = np.ones(len(pos), bool)
                    head[1:] = (item[1:] != item[:-1]) | (pos[1:] - start[1:] != pos[:-1] - start[:-1]) | (pos[1:] != pos[:-1] + 1) | (row[pos[1:]] != row[pos[:-1]])
                    h = np.flatnonzero(head)
                    n = np.diff(np.append(h, len(pos))) - 1 + m[h]
                    r = row[pos[h]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[a + x] for x in r], pa.int64()), pa.array([block.ids[x] for x in item[h]], pa.string()), pa.array(pos[h] - wo[r]), pa.array(start[h]), pa.array(n)],
                        ["doc_id", "item_id", "doc_start", "item_start", "n_words"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)
