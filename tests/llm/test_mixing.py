import pytest
from oracle import same
from pyspark.sql import functions as F

from palimpsest.llm import mixing as M


@pytest.mark.parametrize("name", ["op9_mixing"])
def test_equals_sql(spark, name):
    from palimpsest.llm import queries as q

    d = "/root/testdata/sf0.01"
    same(q.queries()[name](spark, d), q.oracle_sql()[name], d)


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 5), (None, 85)], "source string, source_size long")
    t = {r.source: r.target for r in M.targets(sizes).collect()}
    assert t["b"] == 30 and t["c"] == 15 and sum(t.values()) == pytest.approx(1100) and t[None] == 255


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (i % 37 + 1), "abc"[i % 3] if i % 5 else None, 1.0 + i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, like double").withColumn("size", F.lit("x"))
    for how in ({}, {"preference": "like"}):
        out = M.mix(df, **how)
        for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.max("copies").alias("c")).collect():
            assert abs(r.t - r.want) <= 19 and r.c <= 3
        assert sorted(out.collect()) == sorted(M.mix(df.repartition(7), **how).collect())


def test_edge_cases(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, None, "a", 0), (1, "x y", "a", 0), (1, "x y", "a", 0), (None, "z", None, 0), (2, "", "b", 0), (3, "long " * 50000, "é", 0)]
    for i, r in enumerate((rows, [], rows[4:5])):
        spark.createDataFrame(r, "doc_id long, text string, source string, copies int").write.parquet(f"{d}/{i}/documents.parquet")
        got = M.mix(spark.read.parquet(f"{d}/{i}/documents.parquet"))
        same(got, M.sql(f"read_parquet('{d}/{i}/documents.parquet/*.parquet')"), d)
        assert got.count() == len(r)
