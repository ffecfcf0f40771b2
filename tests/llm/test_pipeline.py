import corpus_pipeline as P
from test_decontaminate import brute as leaks
from test_minhash import brute as near

from palimpsest.llm import linededup as L
from palimpsest.llm.shared import stash


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = stash(stage(spark, docs, sf), name)
        assert out.columns == columns
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()})
        docs = out
    before, after = seen["line_dedup"]
    report = L.report(spark.createDataFrame(list(before.items()), "doc_id long, text string"), least=0, bits=None)
    want = {r.doc_id: r.n_removed for r in report.collect()}
    gone = before.keys() - after.keys()  # all their lines were cut, or all but blank ones
    assert after.keys() <= before.keys() and all(want[d] >= sum(bool(x.strip()) for x in before[d].split("\n")) > 0 for d in gone)
    assert all(after[d].strip() or not before[d].strip() for d in after)
    assert all(len(before[d].split("\n")) - want[d] == len(after[d].split("\n")) for d in after)
    before, after = seen["near_dedup"]
    assert after.keys() == {d for d, _, _, kept in near(list(before.items()), 5, 80) if kept}
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert after.keys() == {d for d, _, _, n, _, _ in leaks(list(before.items()), items) if not n}
    mixed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in mixed} == after.keys() and all(r.copies <= 3 for r in mixed)


def test_short_benchmark_items_are_searched(spark, tmp_path):
    spark.createDataFrame([("a", "four words of benchmark"), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "it holds four words of benchmark inside"), (2, "it holds four words of the benchmark"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in P.STAGES[3][1](spark, docs, str(tmp_path)).collect()} == {2, 3}


def test_documents_without_lines_of_their_own_go(spark, sf):
    line = " ".join(f"w{i}" for i in range(30))
    data = [(1, f"{line}\nfirst text of its own"), (2, f"{line}\nfirst text of its own"), (3, line + "\n \n"), (4, line.replace("w7 ", "w8 ") + "\nanother line, quite unlike"), (5, ""), (6, None), (7, " \n")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", "2 AS gone_id", "3 AS kept_id")
    cut = P.STAGES[1][1](spark, docs, sf)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: data[0][1], 4: "another line, quite unlike", 5: "", 6: None, 7: " \n"}
    assert P.STAGES[2][1](spark, docs, sf).columns == docs.columns


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
