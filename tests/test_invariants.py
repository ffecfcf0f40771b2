"""What must hold whatever the session's zone, however many writers and streams there are."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F
from test_temporal import H, T0, log, spec

from palimpsest import ConflictError, Engine, TemporalError
from palimpsest.functions import period as P
from palimpsest.operators import reader as R
from palimpsest.operators.joins import as_of_many
from palimpsest.operators.writer import derive_history
from palimpsest.sources.store import Files

GAP = dt.datetime(2026, 3, 8, 2, 30)  # an hour that New York's clocks skip


@pytest.fixture(params=["America/New_York", "UTC"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_periods_are_free_of_the_zone(spark, zone):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), GAP, GAP + dt.timedelta(microseconds=7), dt.datetime(2026, 11, 1, 1, 30), P.SENTINEL, dt.datetime(1, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select("t", P.to_us(F.col("t")).alias("us"))
    rows = df.select("t", "us", P.from_us(F.col("us")).alias("again"), P.month(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r.us == (r.t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) and r.again == r.t and r.m == f"{r.t.year:04d}-{r.t.month:02d}"
    assert P.SENTINEL_US in {r.us for r in rows}


def test_histories_in_any_zone(spark, tmp_path, zone):
    t = Engine(spark, str(tmp_path)).table(spec())
    for i, (s, at) in enumerate([("a", GAP - H), ("b", GAP), ("c", GAP + H)]):
        t.apply_changes(log(spark, [(1, s, 1, at, 1 if not i else 2)]))
    assert [(r.status, r.valid_from) for r in t.all_versions().collect()] == [("c", GAP + H), ("b", GAP), ("a", GAP - H)]
    assert [r.status for r in t.current().collect()] == ["c"] and [r.status for r in t.as_of(GAP).collect()] == ["b"]
    assert t.history().where("is_current").count() == 1


def test_a_second_insert(spark, tmp_path):
    t = Engine(spark, str(tmp_path)).table(spec())
    t.apply_changes(log(spark, [(1, "a", 1, T0, 1)]))
    with pytest.raises(TemporalError, match="insert of a key that is live"):
        t.apply_changes(log(spark, [(1, "b", 1, T0 + H, 1)]))
    with pytest.raises(TemporalError, match="no live row"):
        t.apply_changes(log(spark, [(2, None, None, T0 + H, 3)]))
    assert [r.status for r in t.current().collect()] == ["a"]
    t.apply_changes(log(spark, [(1, "b", 1, T0 + H, 1)]), duplicate_inserts="update")
    assert [(r.status, r.operation) for r in t.history().select("entity.status", "operation").collect()] == [("b", 2), ("a", 1)]
    assert derive_history(log(spark, [(1, "a", 1, T0, 1), (1, "b", 1, T0 + H, 1)]), spec()).where(P.is_open(F.col("valid_to"))).count() == 1


def test_history_ids_go_on_without_gaps(spark, tmp_path):
    t = Engine(spark, str(tmp_path)).table(spec())
    for i in range(5):
        t.apply_changes(log(spark, [(k, f"s{i}", i, T0 + i * H, 2 if i else 1) for k in range(5)]).withColumn("seq", F.col("seq") + 1000))
    assert t.store.manifest()["sequence"] == 25
    assert [r.history_id for r in t.frame().where("id = 3").orderBy("valid_from").collect()] == [3, 8, 13, 18, 23]


def test_one_of_many_publishers_wins(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.fs.mkdirs(files.path(""[:0] or "."))
    won, lost = [], []

    def go(i):
        try:
            files.publish("m.json", {"by": i})
            won.append(i)
        except ConflictError:
            lost.append(i)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(50)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(won) == 1 and len(lost) == 49 and files.read("m.json") == {"by": won[0]}
    assert files.names("") == ["m.json"]


def test_concurrent_updates_leave_one_chain(spark, tmp_path):
    t = Engine(spark, str(tmp_path)).table(spec())
    t.apply_changes(log(spark, [(1, "start", 0, T0, 1)]))
    errors = []

    def go(i):
        try:
            t.apply_changes(log(spark, [(1, f"w{i}", i, T0 + dt.timedelta(seconds=random.randrange(60)), 2)]), attempts=50)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    rows = t.frame().orderBy("valid_from").collect()
    assert len(rows) == 9 and {r.status for r in rows} == {"start", *(f"w{i}" for i in range(8))}
    assert all(a.valid_to == b.valid_from for a, b in zip(rows, rows[1:])) and rows[-1].valid_to == P.SENTINEL
    assert len({r.history_id for r in rows}) == 9


def test_commits_compact_by_count(spark, tmp_path):
    t = Engine(spark, str(tmp_path), compact_after=3).table(spec())
    for i in range(5):
        t.apply_changes(log(spark, [(1, f"s{i}", i, T0 + i * H, 2 if i else 1)]))
    assert len(t.store.manifest()["closed"]) <= 3 and t.all_versions().count() == 5
    assert t.store.vacuum() > 0 and t.all_versions().count() == 5 and t.current().count() == 1


def test_contained_in_bounds_both_months(spark, tmp_path):
    t = Engine(spark, str(tmp_path)).table(spec())
    t.apply_changes(log(spark, [(1, "a", 1, T0, 1), (1, "b", 1, T0 + H, 2)]))
    plan = t.contained_in(T0, T0 + 2 * H)._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2026-01" in plan and "<= 2026-01" in plan and [r.status for r in t.contained_in(T0, T0 + 2 * H).collect()] == ["a"]


def test_many_instants_share_a_plan(spark):
    h = derive_history(log(spark, [(1, "a", 1, T0, 1), (1, "b", 1, T0 + H, 2), (1, None, None, T0 + 2 * H, 3)]), spec())
    at = spark.createDataFrame([(T0,), (T0 + H,), (T0 + 2 * H,)], "t timestamp_ntz")
    assert [(r.t, r.status) for r in as_of_many(at, h, F.col("t")).orderBy("t").collect()] == [(T0, "a"), (T0 + H, "b")]
    with pytest.raises(ValueError):
        R.single(h)
