import hashlib

from palimpsest.llm import substrings as S


def brute(docs):
    seen, gone = {}, {}
    key = lambda d: (1 << 63) - 1 if d is None else d
    words = [(key(d), (t or "").encode().split()) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            seen[x] = min((d, i), seen.get(x, (d, i)))
    out = []
    for (d0, _), (d, w) in zip(docs, words):
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] != (d, i):
                keep[i : i + 20] = [False] * 20
        k = [x for x, y in zip(w, keep) if y]
        out.append((d0, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.drop("kept").collect()), key=str)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[2] for r in want)
    assert rows(S.dedup(docs)) == want


def test_batches_compaction_and_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(30))
    data = [(1, p), (2, "x " * 50), (3, f"a b {p} c"), (4, None), (5, ""), (None, p), (6, " ".join(p.split()[:19])), (7, "x " * 20), (8, p.replace("p15", "q")), (9, "y é\t" * 30000), (10, p.replace("p25", "z") + "\n" + p)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS starts", "2 AS id")
    want = brute(data)
    for n in (1, 6):
        assert rows(S.dedup(df, batches=n)) == want
    assert S.dedup(df.limit(0)).count() == 0
