import random
import re

import pytest

from palimpsest.llm import minhash as M
from palimpsest.llm.components import components


def brute(docs, k, percent):
    sets = []
    for _, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    e = [(1, 2), (3, 2), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 5 and got[140] == 100 and got[21] == 20
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k, percent", [(3, 85)])
def test_equals_brute_force(spark, sf, k, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(M.groups(docs, k=k, percent=percent))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert any(not r[3] for r in got)


def test_chains_and_edge_cases(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs, now = [], base
    for i in range(12):  # a chain: neighbours alike, ends not
        docs.append((50 - i, " ".join(now)))
        now = [x if r.random() > 0.02 else f"x{i}{r.random()}" for x in now]
    docs += [(900 + i, " ".join(x if r.random() > 0.03 else "y" for x in base)) for i in range(40)]
    docs += [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (4, "one TWO"), (5, "one"), (None, "one two"), (None, "solo text"), (6, " ".join(base) + " z" * 40000), (7, " ".join(base) + " z" * 39999)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' AS kept")
    assert rows(M.groups(df, k=3, percent=85)) == brute(docs, 3, 85)
    assert M.groups(df.limit(0)).count() == 0
    kept = M.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {d for d, _, _, keep in brute(docs, 5, 80) if keep}
    assert {x.doc_id for x in kept.collect()} == want
