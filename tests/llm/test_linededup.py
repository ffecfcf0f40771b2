import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from palimpsest.llm import linededup as L
from palimpsest.llm import words as W
from palimpsest.llm.edits import within


def norm(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def sim(words):
    data, off = W.buffers(pa.array([" ".join(words)]))
    s, e, _ = W.spans(data, off, W.NON_SPACE)
    h = W.hashes(data, s, e)
    return sum(int(2 * ((h >> np.uint64(i)) & np.uint64(1)).sum() > len(h)) << i for i in range(64))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(docs, least=5):
    nodes = {}
    for d, t in docs:
        for i, line in enumerate(t.split("\n") if t is not None else []):
            w = norm(line)
            if len(w) >= least:
                nodes.setdefault(" ".join(w), set()).add(((1 << 63) - 1 if d is None else d, i))
    names = list(nodes)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sims = {x: sim(x.split(" ")) for x in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if (sims[a] ^ sims[b]).bit_count() <= L.DISTANCE and find(a) != find(b) and distance(a, b) * 5 <= max(len(a), len(b)):
                root[find(a)] = find(b)
    keep = {}
    for x in names:
        keep[find(x)] = min(min(nodes[x]), keep.get(find(x), (1 << 64, 0)))
    gone = {o for x in names for o in nodes[x]} - set(keep.values())
    out = []
    for d, t in docs:
        k = (1 << 63) - 1 if d is None else d
        ls = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(ls) if (k, i) not in gone]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(L.report(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in got) > 0


def test_edge_cases(spark):
    base = " ".join(f"word{i}" for i in range(60))
    data = [(5, f"{base}\nshort one\n{base}"), (2, base.upper() + "!\n\nshort one"), (3, base.replace("word30", "wort30")), (4, None), (6, ""), (None, base), (7, "\n" * 3), (8, base.replace("word7 ", "wor7 ")), (9, "x " * 50000 + "\n" + "y " * 50000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "CAST(7 AS bigint) AS n_chars", "1 AS lines")
    want = brute(data)
    assert rows(L.report(df)) == want and sum(r[2] for r in want) >= 3
    kept = L.dedup_lines(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got[4] is None and got[7] == "\n" * 3 and got[2] == data[1][1] and len(got) == len(data)
    assert L.report(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, base), (1, base), (0, "a")], "doc_id long, text string")
    assert {r.n_removed for r in L.report(twice).collect()} == {0}


def test_links_by_edit_similarity_alone(spark):
    """A tenth of the words changed, one at least, in lines of 6 to 30 words is found, whatever their SimHashes."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    data, want = [], {}
    for i, n in enumerate([6, 8, 10, 10, 15, 20, 20, 30, 30, 30]):
        w = [words[x] for x in rng.choice(400, n, replace=False)]
        new = w.copy()
        for x in rng.choice(n, max(1, n // 10), replace=False):
            new[x] = "qqqqqq"
        a, b = " ".join(w), " ".join(new)
        assert distance(a, b) * 5 <= max(len(a), len(b))
        data += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i: 0, 2 * i + 1: 1}
    far = [(100 + i, " ".join(words[x] for x in rng.choice(400, 12, replace=False))) for i in range(20)]
    df = spark.createDataFrame(data + far, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in L.report(df, bits=None).collect()}
    assert got == want | {d: 0 for d, _ in far}


def test_most_similar_lines_are_met(spark):
    """On real lines, the bands meet nearly all pairs within the edit distance."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    names = sorted({" ".join(w) for r in docs for x in r.text.split("\n") for w in (norm(x),) if w and len(" ".join(w)) < 400}, key=len)
    data, off = W.buffers(pa.array(["\n".join(names)]))
    line, _, n, h, s, e, low = L._nodes(data, *L._lines(data, off)[:2], 1)
    assert len(line) == len(names)
    keys = [set() for _ in names]
    for pick, k in L._keys(n, h, s, e, low, 80)[1]:
        for i, row in zip(pick, k.tolist()):
            keys[i].update(row)
    bags = [{x[i : i + 4] for i in range(len(x) - 3)} for x in names]
    alike = [(i, j) for j in range(len(names)) for i in range(j) if len(names[i]) * 5 >= len(names[j]) * 4 and len(bags[i] & bags[j]) * 3 >= len(bags[j]) > 0 and distance(names[i], names[j]) * 5 <= len(names[j])]
    assert len(alike) > 20 and sum(not keys[i].isdisjoint(keys[j]) for i, j in alike) >= 0.95 * len(alike)


def test_short_lines(spark):
    data = [(1, "short one\n- - -\nä"), (2, "Short, one!\n---\nä\n \n- - -"), (3, "ä\n\n \n"), (None, "short one")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(df, least=0, bits=None).collect()} == {1: data[0][1], 2: "---\n ", 3: "\n \n", None: ""}


def test_bit_vectors_equal_the_table():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choice("abcdé😀 ") for _ in range(r.choice([0, 1, 5, 63, 64, 65, 130])))
        b = list(a)
        for _ in range(r.randrange(0, len(a) // 3 + 3)):
            p = r.randrange(len(b) + 1)
            b[p : p + r.randrange(2)] = r.choice(["", "x", "yé"])
        b = "".join(b) if r.random() > 0.1 else "".join(r.choice("abcd") for _ in range(r.randrange(90)))
        d = distance(a, b)
        assert all(within(a, b, m) == (d <= m) for m in (0, d - 1, d, d + 1, max(len(a), len(b)) // 5))


def test_recall_of_edit_similarity(spark, sf):
    """Over all lines and by edit similarity alone: nothing is cut that brute force keeps, and nearly all is that it cuts."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    nodes = {}
    for d, t in docs.items():
        for i, line in enumerate((t or "").split("\n")):
            if x := " ".join(norm(line)) or line.strip() and "\0" + line.strip():
                nodes.setdefault(x, []).append((d, i))
    names = sorted(nodes, key=len)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(names):
        for a in reversed(names[:j]):
            if len(a) * 5 < len(b) * 4:
                break
            if "\0" not in (a[0], b[0]) and find(a) != find(b) and within(a, b, len(b) // 5):
                root[find(a)] = find(b)
    groups = {}
    for x in names:
        groups.setdefault(find(x), []).extend(nodes[x])
    want = {o for g in groups.values() for o in g if o != min(g)}
    got = {(r.doc_id, i) for r in L.removals(spark.read.parquet(f"{sf}/documents.parquet"), least=0, bits=None).collect() for i in r.lines}
    assert got <= want and len(got) >= 0.97 * len(want) > 100


def test_letters_bound_edits():
    """Letters never tell more edits than there are, for code points of one to four bytes."""
    rng, signs = random.Random(5), "abcdeé ßж漢😀x "
    for _ in range(300):
        a = "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = [rng.choice(signs)] if rng.random() < 0.7 else []
        b, most = "".join(b), 0
        data, off = W.buffers(pa.array([f" {a} ", f" {b} "]))
        x, y = L._letters(off, data, np.ones(2, bool)).view(np.uint64)
        most = max(int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()))
        assert most <= distance(a, b)
        assert L._strings(off, data, np.ones(2, bool)).to_pylist() == [a, b]


def test_short_lines_that_meet_leave_no_pairs(spark, monkeypatch):
    """Short lines of a few common words meet by the square of their number; links alone are left to confirm."""
    rng = random.Random(3)
    words = ["thing", "ation", "there", "other", "ingly", "ouren", "blesh", "oning", "thert", "eaten"]
    lines = [" ".join(rng.choice(words) for _ in range(7)) for _ in range(300)]
    lines += [line[:20] + "x" + line[21:] for line in lines[:20]]
    told, real = [], L.grouped

    def grouped(member, features, near, confirm, name):
        def seen(pairs):
            told.extend((r.a, r.b) for r in pairs.collect())
            return confirm(pairs)

        return real(member, features, near, seen, name)

    monkeypatch.setattr(L, "grouped", grouped)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in L.removals(docs, least=0, bits=None).collect()}
    n = {norm_: {i for i, x in enumerate(lines) if " ".join(norm(x)) == norm_} for norm_ in {" ".join(norm(x)) for x in lines}}
    links = sum(within(a, b, max(len(a), len(b)) // 5) for a in n for b in n if a < b)
    assert 0 < len(set(told)) <= links and set(range(300, 320)) <= gone


def test_many_pairs_at_once_equal_one_by_one():
    from palimpsest.llm.edits import Texts, near

    r = random.Random(4)
    a, b = [], []
    for _ in range(600):
        x = "".join(r.choice("abcdé😀 ") for _ in range(r.choice([0, 1, 64, 65, 128, 190])))
        y = list(x)
        for _ in range(r.randrange(0, len(x) // 3 + 2)):
            p = r.randrange(len(y) + 1)
            y[p : p + r.randrange(2)] = r.choice(["", "x", "yé"])
        a.append(x)
        b.append("".join(y))
    at = np.arange(len(a))
    want = [within(x, y, max(len(x), len(y)) // 5) for x, y in zip(a, b, strict=True)]
    assert near(Texts(pa.array(a)), at, Texts(pa.array(b)), at, 80).tolist() == want and 100 < sum(want) < 500


def test_long_lines_that_are_alike_but_not_enough_leave_no_pairs(spark, monkeypatch):
    """Of a large group whose lines are all about 30 % apart, pairs with leaders alone are left to confirm; links within it are found."""
    from palimpsest.llm import links

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)]
    base, lines = rng.sample(words, 40), []
    for _ in range(200):
        w = base.copy()
        for i in rng.sample(range(4, 40), 8):
            w[i] = rng.choice(words)
        lines.append(" ".join(w))
    lines += [x[:-1] + "z" for x in lines[:10]]
    told, real = [], links.Met.__call__

    def seen(self, pairs):
        told.append(pairs.count())
        return real(self, pairs)

    monkeypatch.setattr(links.Met, "__call__", seen)
    monkeypatch.setattr(links, "PART", 16)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in L.removals(docs, least=0, bits=None).collect()}
    assert len(told) == len(links.LEADERS) and sum(told) <= 14 * len(lines) * sum(links.LEADERS) and gone >= set(range(200, 210))
    root = list(range(len(lines)))
    for j in range(len(lines)):
        for i in range(j):
            if within(lines[i], lines[j], max(len(lines[i]), len(lines[j])) // 5):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert gone <= {i for i in range(len(lines)) if root[i] != i}


def test_texts_that_lose_nothing_are_not_joined(spark):
    """The filter tells all that lose lines, null ids too, and few others."""
    docs = spark.createDataFrame([(i, f"line {i} of its own, number {i * i}") for i in range(300)] + [(1000, "twice here\nonce"), (1001, "twice here"), (None, "twice here\nx")], "doc_id long, text string")
    joined, gone, _ = L._cut(docs, 0, 80, None)
    got = {r.doc_id for r in joined.where(gone.isNotNull()).collect()}
    assert {1001, None} <= got and joined.count() == 303
    ids = spark.createDataFrame([(1001,), (None,)], "doc_id long")
    kept = docs.join(L._filter(ids, "cell", "bits"), L._cell(L.F.xxhash64("doc_id")) == L.F.col("cell")).where(L.F.col("bits").bitwiseAND(L._bit(L.F.xxhash64("doc_id"))) != 0)
    assert {1001, None} <= {r.doc_id for r in kept.collect()} and kept.count() <= 12


def test_few_pairs_side_by_side_equal_one_by_one():
    from palimpsest.llm import edits

    r, a, b = random.Random(6), [], []
    for n in [0, 1, 7, 8, 9, 63, 64, 65, 200, 700] * 12:
        x = "".join(r.choice("abcdefé😀 ") for _ in range(n))
        y = list(x)
        for _ in range(r.randrange(0, len(x) // 2 + 2)):
            p = r.randrange(len(y) + 1)
            y[p : p + r.randrange(2)] = r.choice(["", "x", "yé"])
        a.append(x)
        b.append("".join(y))
    most = np.array([max(len(x), len(y)) // 5 for x, y in zip(a, b, strict=True)])
    want = [within(x, y, int(m)) for x, y, m in zip(a, b, most, strict=True)]
    assert edits._side_by_side(a, b, most).tolist() == want and 20 < sum(want) < 110


def test_pairs_joined_already_are_not_tested():
    """80 places in four groups, all pairs of which are links: far fewer tests than pairs, the same components."""
    from palimpsest.llm import links

    i, j = np.triu_indices(80, 1)
    told = []

    def test(p, q):
        told.extend(zip(p.tolist(), q.tolist(), strict=True))
        return p % 4 == q % 4

    close = i % 4 == j % 4
    team = np.arange(80)
    found = [x for x in links._joining(i[close], j[close], np.random.default_rng(1).integers(0, 20, int(close.sum())), team, test)]
    assert len(told) < 400 < int(close.sum()) and all((p % 4 == q % 4).all() for p, q in found) and len(set(team.tolist())) == 4
    told.clear()
    list(links._joining(i, j, np.zeros(len(i), int), np.arange(80), test))
    assert {(p, q) for p, q in told if p % 4 != q % 4} and len(told) == len(set(told))


def test_nodes_that_can_be_linked_with_none_leave_the_buckets(spark, monkeypatch):
    from palimpsest.llm import links
    from palimpsest.llm.shared import scratch

    rows = [(k, [k % 50, 1000 + k // 3], k * 10) for k in range(-100, 200)] * 2 + [(500, [7], 5), (501, None, 5)]
    lists = spark.createDataFrame(rows, "node long, keys array<long>, chars long").where("keys IS NOT NULL")
    for part in (2, 100):
        monkeypatch.setattr(links, "PART", part)
        bucket, want = {}, set()
        for node, keys, chars in rows:
            for key in keys or []:
                bucket.setdefault(key, {})[node] = chars
        for key, x in bucket.items():
            want |= {(key, n, len(x)) for n, c in x.items() if len(x) > 1 and (len(x) > part or any(m != n and abs(c - d) <= 10 for m, d in x.items()))}
        with scratch(spark):
            got = {tuple(r) for r in links._meeting(lists, lambda col, i, j: abs(col["chars"][i] - col["chars"][j]) <= 10, "test").collect()}
        assert got == want and want


def test_filter_of_lines_takes_one_worker(spark, monkeypatch):
    """Each Python function that reads another's rows takes a further worker in every task."""
    real, plans = L.membership, []
    monkeypatch.setattr(L, "membership", lambda ids, *how: plans.append(ids._jdf.queryExecution().toString()) or real(ids, *how))
    docs = spark.createDataFrame([(1, "one line of words here\nother"), (None, "x\none line of words here")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, 1, 0), (1, (1 << 63) - 1, 1)], "node long, d long, line long")
    L._texts(docs, asked, 0).collect()
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
