import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import ctw as C


def toks(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute(docs):
    held = [held_out(d) for d, _ in docs]
    c = Counter(x for (_, t), h in zip(docs, held) if not h for x in toks(t))
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (d, t), h in zip(docs, held) for w in (toks(t),)), key=str)


def coded(t):
    """(context, byte) of each byte and the end; the context's nearest byte first."""
    b = bytes([C.STOP] * C.DEPTH) + (t or "").encode() + bytes([C.STOP])
    return [(b[i - C.DEPTH : i][::-1], b[i]) for i in range(C.DEPTH, len(b))]


class Tree:
    """Context-tree weighting by its definition: dictionaries, every depth, one node after the other."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for ctx, byte in (x for t in texts for x in coded(t)):
            for level in range(8):
                node = 1 << level | byte >> (8 - level)
                for d in range(C.DEPTH + 1):
                    self.counts[ctx[:d], node][byte >> (7 - level) & 1] += 1
                    if d < C.DEPTH:
                        self.children[ctx[:d], node].add(ctx[: d + 1])
        self.kept = {}

    def kt(self, at):
        a, b = self.counts[at]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, at):
        if at not in self.kept:
            own = self.kt(at)
            if len(at[0]) < C.DEPTH:
                below = sum(self.weighted((c, at[1])) for c in self.children[at])
                own = np.logaddexp(own, below) - math.log(2)
            self.kept[at] = own
        return self.kept[at]

    def bit(self, ctx, node, bit, d=0):
        if (ctx[:d], node) not in self.counts:
            return None
        n = self.counts[ctx[:d], node]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        below = self.bit(ctx, node, bit, d + 1) if d < C.DEPTH else None
        if below is None:
            return own
        stay = math.exp(self.kt((ctx[:d], node)) - math.log(2) - self.weighted((ctx[:d], node)))
        return stay * own + (1 - stay) * below

    def log10(self, ctx, byte):
        return sum(math.log10(self.bit(ctx, 1 << k | byte >> (8 - k), byte >> (7 - k) & 1) or 0.5) for k in range(8))

    def score(self, t):
        return sum(self.log10(*x) for x in coded(t))


def test_base_and_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = C.scores(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 for r in got)


def test_held_out_texts_are_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    held = C.scores(docs).where("held_out").collect()
    assert len(held) > 300 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_equals_context_tree_weighting_at_full_depth(spark, monkeypatch):
    data = [(1, "abracadabra abracadabra"), (2, None), (19, "abra cadaver"), (3, "Éa é a\n" * 9), (4, "the cat sat on the mat, the rat sat too"), (None, "the cat"), (25, "zebra the"), (3, "")]
    tree = Tree([t for d, t in data if not held_out(d)])
    want = sorted((str(d), round(tree.score(t), 3)) for d, t in data)
    assert any(held_out(d) for d, _ in data)
    df = spark.createDataFrame(data, "doc_id long, text string")
    for forest, chunk in ((C.FOREST, C.CHUNK), (7, 20)):  # small pieces give the same
        monkeypatch.setattr(C, "FOREST", forest)
        monkeypatch.setattr(C, "CHUNK", chunk)
        assert sorted((str(r.doc_id), round(r.score, 3)) for r in C.scores(df).collect()) == want
    ctx = coded("the cat")[4][0]
    assert sum(10 ** tree.log10(ctx, b) for b in range(256)) == pytest.approx(1)


def test_root_is_a_kt_mixture():
    """Without contexts below them the nodes are the binary-decomposed KT estimates of the counts."""
    counts = np.zeros((256, 256))
    counts[7, [97, 98]] = [3, 1]
    want = 1.0
    for bit, (a, b) in zip("01100001", [(4, 0), (0, 4), (0, 4), (4, 0), (4, 0), (4, 0), (3, 1), (0, 3)]):
        want *= ((b if bit == "1" else a) + 0.5) / (a + b + 1)
    root = C.Root(counts, np.zeros((256, 256)))
    assert root.log10(np.array([7 << 8 | 97]), np.full((1, 8), np.nan))[0] == pytest.approx(math.log10(want), abs=1e-9)
    assert (10 ** root.log10(9 << 8 | np.arange(256), np.full((256, 8), np.nan))).sum() == pytest.approx(1)


def test_edge_cases(spark):
    data = [(1, None), (2, ""), (None, "a b a"), (3, "É a  b"), (3, "É a  b"), (4, "x " * 100000)]
    for d in (data, [], data[:1], [(19, "only")]):
        got = C.scores(spark.createDataFrame(d, "doc_id long, text string").selectExpr("*", "1 AS score")).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(d)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lookup_holds_few_rows(tmp_path):
    """A row group of any size passes in batches, and every gram is found, at their edges too."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 1_000_000
    path, gram = tmp_path / "grams.parquet", np.arange(n, dtype=np.int64) * 3
    pq.write_table(pa.table({"gram": gram, "p": (gram % 1000).astype(np.float32)}), path, row_group_size=n)
    asked = np.unique(np.concatenate([gram[::7], gram[65535::65536], gram[::65536], gram[:1000] + 1]))
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = C._looked_up([f"file://{path}"], asked)
    finally:
        pa.set_memory_pool(before)
    assert np.array_equal(got, np.where(asked % 3 == 0, asked % 1000, 0))
    assert pool.max_memory() < 12 * n / 2


def test_subtrees_hold_one_depth(monkeypatch):
    """What a task builds at once takes less than 200 MB."""
    import tracemalloc

    rng = np.random.default_rng(1)
    signs = np.frombuffer(b"etaoinshrdlu ,.\nbcfgmpwyvk\xff", np.uint8).astype(np.int64)
    keys = np.zeros(C.FOREST * 2, np.int64)
    for _ in range(C.DEPTH + 1):
        keys = keys << 8 | signs[np.minimum(rng.geometric(0.12, len(keys)) - 1, 26)]
    keys = np.unique(keys)[: C.FOREST]
    tracemalloc.start()
    q, top, sums = C._subtrees(keys, np.ones(len(keys)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q) == len(keys) and len(top) == len(sums) and most < 200e6
