import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import fingerprint as P


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*parts):
    h = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else (p.to_bytes(4, "little", signed=True) if isinstance(p, Int) else int(p).to_bytes(8, "little", signed=True))
        h = xxhash.xxh64(raw, seed=h & (2**64 - 1)).intdigest()
    return signed(h)


class Int(int):
    """Hashed as four bytes, as Spark does an int."""


def signature(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    km = [xx(a, b) for a, b in zip(w, w[1:])] or ([xx(" ".join(w))] if w else [])
    seen, parts = {}, {}
    for i, h in enumerate(km):
        h >>= 30
        n = seen[h] = seen.get(h, -1) + 1
        v = xx(h, Int(n)) >> 30
        parts.setdefault((v >> 28) + 32, []).append((v, i))
    out = []
    for p in range(64):
        m = sorted(sorted(parts.get(p, []))[:2], key=lambda x: x[1])
        out.append(xx(*[v for v, _ in m]) % 65535 + 1 if m else 0)
    return out


def near(a, b):
    on = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in on) / len(on) if on else 1.0


def brute(docs):
    order = sorted(docs, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = signature(t), signature(e), signature(nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{x:04X}" for x in a), "".join(f"{x:04X}" for x in b), near(a, b), near(a, c)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("sig"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(P.fingerprints(docs, rows=16)) == want
    assert sum(r[5] > r[6] for r in want) > 0.8 * len(want)


def test_edge_cases(spark):
    data = [(5, "a b a b a b 😀é"), (9, None), (-3, ""), (1 << 40, "one"), (7, "x " * 5000), (None, "tail of the list")]
    for d in (data, data[:1], []):
        assert rows(P.fingerprints(spark.createDataFrame(d, "doc_id long, text string"), rows=2)) == brute(d)
    twice = spark.createDataFrame([(1, "p q r s t"), (1, "p q r s t"), (2, "p q r s t")], "doc_id long, text string")
    assert {(r.fingerprint, r.near_next) for r in P.fingerprints(twice).collect()} == {(rows(P.fingerprints(twice))[0][3], 1.0)}


def test_order_matters(spark):
    w = [f"w{i}" for i in range(400)]
    moved = spark.createDataFrame([(2, " ".join(w)), (1, " ".join(w[200:] + w[:200]))], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in P.fingerprints(moved).collect()}
    assert 0.2 < near[2] < 0.8


def test_no_python_in_the_plan(spark, sf):
    plan = P.fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_buckets_are_even_ranges(spark):
    docs = spark.range(1000).selectExpr("id * id AS doc_id")
    bucket, table = P._buckets(docs, 10, 1000)
    counts = [r["count"] for r in docs.groupBy(bucket).count().collect()]
    assert len(counts) == table.count() > 80 and max(counts) < 20
