import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import warc as W


def brute(pages, least=0):
    first = {}
    for p, h in pages:
        b = (h or "").encode()
        if len(b) >= least and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, h in pages:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= least else None
        again = f is not None and p != f
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows(W.round_trip(pages)) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_edge_cases(spark):
    data = [(3, "a\nb", "<p>é</p>"), (1, None, "<p>é</p>"), (1, "u", "<p>é</p>"), (7, "u", None), (8, "u", ""), (None, "u", "x"), (9, "u", "x"), (None, "u", "only"), (11, "u", "z" * 3_000_000)]
    for d in (data, []):
        pages = spark.createDataFrame(d, "page_id long, url string, html string").withColumn("payload", F.lit(1))
        for least in (0, 5):
            assert rows(W.round_trip(pages, min_payload=least)) == brute([(p, h) for p, _, h in d], least)


def test_pushdown_and_foreign_files(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.archive(spark.createDataFrame([(i, f"http://h{i % 2}/%41?a=%250A{i}", "same" if i % 3 else f"page {i}") for i in range(60)], "page_id long, url string, html string"), path)
    df = W.read(spark, path, ["record_type", "target_uri", "payload"]).where("record_type = 'response' AND startswith(target_uri, 'http://h1/') AND length(target_uri) > 3")
    plan = df._jdf.queryExecution().toString()
    assert "record_type" in plan
    assert {r.target_uri for r in df.collect()} == {f"http://h1/%41?a=%250A{i}" for i in range(1, 60) if i % 2 and (i % 3 == 0 or i == 1)}
    skipped = W.read(spark, path, ["record_type", "payload_length"]).groupBy("record_type").agg(F.sum("payload_length").alias("n")).collect()
    assert {r.record_type: r.n for r in skipped}["revisit"] == 39 * 4
    block = W.record("response", "urn:page:1", "u", "2024-01-01T00:00:00Z", None, None, 2, b"hi")
    (tmp_path / "plain.warc").write_bytes(block * 3)
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(block) * 2 + W.member(block))
    for name in ("plain.warc", "other.warc.gz"):
        got = W.read(spark, f"{tmp_path}/{name}", ["offset", "payload"]).collect()
        assert [bytes(r.payload) for r in got] == [b"hi"] * 3
        assert W.read(spark, f"{tmp_path}/{name}", ["record_type"]).where("record_type = 'request'").count() == 0
    bare = block.replace(b"X-Payload-Length: 2\r\n", b"").replace(b"Target-URI: u", b"Target-URI: http://x/%0A%25")
    (tmp_path / "bare.warc").write_bytes(bare)
    got = W.read(spark, f"{tmp_path}/bare.warc", ["target_uri", "payload_length"]).where("payload_length = 2").collect()
    assert [(r.target_uri, r.payload_length) for r in got] == [("http://x/%0A%25", 2)]
    (tmp_path / "breaks.warc").write_bytes(W.record("response", "urn:page:1", "a\r\nb", "2024-01-01T00:00:00Z", None, None, 2, b"hi"))
    assert W.read(spark, f"{tmp_path}/breaks.warc", ["target_uri"]).first().target_uri == "a%0D%0Ab"
    (tmp_path / "cut.warc.gz").write_bytes(W.member(block)[:-20])
    with pytest.raises(Exception, match="cut off|no WARC header|incomplete"):
        W.read(spark, f"{tmp_path}/cut.warc.gz", ["payload"]).collect()


def test_reader_takes_filters_and_skips_payloads():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import BinaryType, StringType, StructType

    r = W.WarcReader({"path": "x"}, StructType().add("record_type", StringType()).add("payload", BinaryType()))
    left = GreaterThan(("payload_length",), 3)
    assert list(r.pushFilters([EqualTo(("record_type",), "response"), left])) == [left]
    assert r._wanted({"warc-type": "revisit"}) is False and r._wanted({"warc-type": "response"}) is True
