import hashlib
import re

from palimpsest.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=8):
    windows = {}
    for i, t in items:
        w = words(t) if i is not None else []
        m = min(size, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for j in range(len(w) - m + 1):
                if (x := tuple(w[j : j + m])) in windows:
                    hit.update(range(j, j + m))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = rows(D.contamination(docs, items))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[3] for r in got)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in got if not r[5]}


def test_edge_cases(spark):
    bench = [(1, "One two THREE four five six seven eight nine"), (2, "short Éa"), (2, "another one"), (3, None), (4, ""), (None, "lost words"), (5, "one two three four five six seven eight x")]
    docs = [(1, None), (2, ""), (3, "zero one two three four five six seven eight nine ten"), (3, "a SHORT éa b"), (4, "short Éa short Éa"), (5, "two three four five six seven eight nine!"), (6, "one two three four five six seven"), (None, "another, one lost words")]
    for d in (docs, [], docs * 3):
        df = spark.createDataFrame(d, "doc_id long, text string").selectExpr("*", "'x' AS n_words", "1 AS item_id")
        for b in (bench, []):
            items = spark.createDataFrame(b, "item_id long, text string")
            assert rows(D.contamination(df, items)) == brute(d, b)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = rows(D.longest_matches(df, items).distinct())
    assert (3, "1", 1, 0, 9) in got and (5, "1", 0, 1, 8) in got and (4, "2", 2, 0, 2) in got


def test_many_blocks(spark):
    items = spark.createDataFrame([(i, f"w{i} a b c d e f g h") for i in range(50)], "item_id long, text string")
    assert len(list(D.blocks(items, 8, block_words=60))) > 3
