import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality as Qu
from palimpsest.llm import toxicity as Tx
from palimpsest.llm import trees

MID = "/root/testdata/sf0.1"  # at sf0.01 only 51 toxic rows are left to learn from


def auc(s, y):
    s, y = np.asarray(s), np.asarray(y)
    pos, neg = s[y == 1], s[y == 0]
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


@pytest.mark.parametrize("module, label, least", [(Tx, "toxic", 0.95), (Qu, "quality", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    out = module.score(docs, labels)
    got = out.join(labels, "doc_id").where("held_out").collect()
    assert auc([r.score for r in got], [r[label] for r in got]) > least
    every = out.collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in every)
    # Held-out labels, source and language of others change nothing.
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.score(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in every)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0.1), (2, "", "en", "s", 0, 0.1), (None, "you IDIOT! " * 3, "en", "s", 3, 0.1), (4, "st0p1d " * 60000, "é", "s", 5, 0.1), (4, "fine", "en", "s", 4, 0.1)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 0, 1), (4, 0, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (Tx, Qu):
        for labels in (empty, some, some.where("doc_id = 1")):
            got = module.score(docs, labels).collect()
            assert len(got) == 5 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
            assert module.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in Tx.score(docs, empty).collect()} == {0.0}
    kept = Tx.drop_toxic(docs, empty)
    assert kept.columns == docs.columns and kept.count() == 5


def test_features_see_hidden_insults():
    import pyarrow as pa

    from palimpsest.llm import words as W

    data, off = W.buffers(pa.array(["you 1d10t", "you idiot", "a fine day", ""]))
    x = Tx.features(data, off, Tx.lexicon(Tx.INSULTS), np.zeros(0, np.uint64), Tx.lexicon(Tx.YOU))
    assert x[0, 5] > 0 and x[1, 1] > 0 and x[1, 7] == 1 and x[2, 1] == 0 and not x[3].any()


def test_isotonic_rises():
    z, y = np.random.default_rng(0).normal(size=500), np.random.default_rng(1).integers(0, 2, 500).astype(float)
    p = trees.isotonic(z, y)(np.sort(z))
    assert (np.diff(p) >= -1e-12).all()
