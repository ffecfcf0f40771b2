"""Times the headline queries: prints one JSON line. Each is run once to warm up and once for the figure."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINES = ["asof_count_by_type", "asof_user_state", "history_full", "derive_noop_suppressed", "diff_timeline", "from_to_month", "history_latest_per_key", "asof_event_join"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from palimpsest import Engine
    from palimpsest import queries as core

    def timed(f) -> float:
        t = time.perf_counter()
        f()
        return round(time.perf_counter() - t, 3)

    took = {}
    for name in HEADLINES:
        run = lambda q=core.queries()[name]: q(spark, sf).write.format("noop").mode("overwrite").save()
        run()
        took[name] = timed(run)
    # The bulk path against a stored history: versions a second, reads with the partition bound, an increment of 1 %.
    with tempfile.TemporaryDirectory() as root:
        table = Engine(spark, root).table(core.USER)
        events = spark.read.parquet(f"{sf}/events.parquet")
        from pyspark.sql import functions as F

        from palimpsest.operators.writer import with_operations

        log = with_operations(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
        cut = events.count() * 99 // 100
        part = log.withColumn("seq", F.col("event_id"))
        took["bulk_apply"] = timed(lambda: table.apply_changes(part.where(F.col("event_id") < cut), order=["ts", "seq"], ts="ts", dangling_deletes="drop"))
        took["increment_apply"] = timed(lambda: table.apply_changes(part.where(F.col("event_id") >= cut), order=["ts", "seq"], ts="ts", dangling_deletes="drop"))
        took["stored_as_of"] = timed(lambda: table.as_of(core.T1).write.format("noop").mode("overwrite").save())
        versions = table.frame().count()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "versions_per_sec": round(versions / took["bulk_apply"]), "sf": sf}))


if __name__ == "__main__":
    main()
