import datetime as dt
import random
from decimal import Decimal as X

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import (
    ChangeContext,
    Engine,
    HistoricalSnapshotError,
    HistoryHorizonError,
    NotTemporalError,
    RetentionNotEnabledError,
    SchemaEvolutionError,
    TemporalModelError,
    TemporalSpec,
    UnsupportedTemporalQuery,
)
from palimpsest.operators import reader as R
from palimpsest.operators.joins import as_of_join
from palimpsest.operators.writer import derive_history, expand_key_changes

T0 = dt.datetime(2026, 1, 1, 8)
H, US = dt.timedelta(hours=1), dt.timedelta(microseconds=1)
POLICY = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("premium", T.DecimalType(18, 4)), T.StructField("updated_at", T.TimestampNTZType())])
CHANGES = "id int, status string, premium decimal(18,4), commit_ts timestamp_ntz, op int, seq long"


def spec(**more):
    return TemporalSpec("policies", POLICY, ("id",), exclude=("updated_at",), **more)


def log(spark, rows):
    return spark.createDataFrame([(k, s, X(p) if p is not None else None, t, op, i) for i, (k, s, p, t, op) in enumerate(rows)], CHANGES)


def periods(h):
    return [(r.valid_from, r.valid_to, r.operation) for r in h.orderBy("history_id").collect()]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "t"), clock=lambda: dt.datetime(2030, 1, 1))


@pytest.fixture
def policies(spark, engine):
    t = engine.table(spec(retention=True))
    for i, (s, p, op) in enumerate([("Draft", 100, 1), ("Active", 250, 2), ("Cancelled", 250, 2)]):
        t.apply_changes(log(spark, [(1, s, p, T0 + i * H, op)]))
    return t


def test_window_table(policies):
    def names(df):
        return [r.status for r in df.collect()]

    assert names(policies.from_to(T0 + H / 2, T0 + 1.5 * H)) == ["Active", "Draft"]
    assert names(policies.from_to(T0 + H, T0 + 1.5 * H)) == ["Active"]
    assert names(policies.from_to(T0, T0 + H)) == ["Draft"]
    assert names(policies.from_to(T0 + 3 * H, T0 + 4 * H)) == ["Cancelled"]
    assert names(policies.from_to(T0 + H / 2, T0 + H / 2)) == []
    assert names(policies.contained_in(T0, T0 + 2 * H)) == ["Active", "Draft"]
    assert names(policies.contained_in(T0 + US, T0 + 2 * H)) == ["Active"]
    assert names(policies.contained_in(T0, T0 + 4 * H)) == ["Active", "Draft"]
    assert names(policies.contained_in(T0, dt.datetime.max)) == ["Cancelled", "Active", "Draft"]
    assert names(policies.all_versions()) == ["Cancelled", "Active", "Draft"]
    assert names(policies.as_of(T0 + H)) == ["Active"] and names(policies.as_of(T0 - US)) == []
    assert names(policies.as_of((T0 + H).replace(tzinfo=dt.timezone(2 * H)))) == []
    with pytest.raises(ValueError):
        policies.from_to(T0 + H, T0)
    with pytest.raises(TypeError):
        policies.as_of(None)


def test_clock_steps_back(spark):
    h = derive_history(log(spark, [(1, "a", 1, T0, 1), (1, "b", 1, T0 - H, 2), (1, None, None, T0 - 2 * H, 3)]), spec())
    assert periods(h) == [(T0, T0 + US, 1), (T0 + US, T0 + 2 * US, 2), (T0 + 2 * US, T0 + 2 * US, 3)]
    assert [r.status for r in h.orderBy("history_id").collect()] == ["a", "b", "b"]
    h = derive_history(log(spark, [(1, "a", 100, T0, 1), (1, "a", 200, T0 + H, 2), (1, "a", 300, T0 + H / 2, 2)]), spec())
    for t, p in ((T0 + H / 2, 100), (T0 + H, 200), (T0 + H + US, 300)):
        assert [r.premium for r in R.as_of(h, spec(), t).collect()] == [X(p)]


def test_noop_and_empty(spark):
    rows = [(1, "a", 1, T0, 1), (1, "a", 1, T0 + H, 2), (1, "b", 1, T0 + 2 * H, 2)]
    assert len(periods(derive_history(log(spark, rows), spec()))) == 2
    assert len(periods(derive_history(log(spark, rows), spec(), writer="interceptor"))) == 3
    untouched = log(spark, rows).withColumn("__touched", F.col("seq") != 1)
    assert len(periods(derive_history(untouched, spec(), writer="interceptor"))) == 2
    assert derive_history(log(spark, []), spec()).count() == 0


def test_json_is_compared_by_content(spark):
    s = TemporalSpec("j", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("m", T.StringType())]), ("id",), json_columns=("m",))
    df = spark.createDataFrame([(1, '{"a":1,"b":2}', T0, 1, 0), (1, '{"b": 2, "a": 1}', T0 + H, 2, 1), (1, '{"a":2}', T0 + 2 * H, 2, 2)], "id int, m string, commit_ts timestamp_ntz, op int, seq long")
    assert [r.history_id for r in derive_history(df, s).orderBy("history_id").collect()] == [0, 2]


def random_log(n, seed):
    r, live, out = random.Random(seed), set(), []
    for i in range(n):
        k = r.randrange(12)
        op = r.choice([2, 2, 2, 3]) if k in live else 1
        (live.discard if op == 3 else live.add)(k)
        out.append((k, r.choice("abc"), r.randrange(3), T0 + dt.timedelta(microseconds=r.randrange(-5, 40)), op))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_batch_and_chains_hold(spark, engine, seed):
    rows = random_log(120, seed)
    want = derive_history(log(spark, rows), spec()).collect()
    t = engine.table(spec())
    cuts = [0, 30, 31, 80, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        t.apply_changes(log(spark, rows[a:b]), batch_id=str(a))
        t.apply_changes(log(spark, rows[a:b]), batch_id=str(a))  # a replay changes nothing
    got = t.frame().drop(R.BUCKET).collect()
    key = ["id", "status", "premium", "valid_from", "valid_to", "operation"]
    assert sorted(tuple(r[c] for c in key) for r in got) == sorted(tuple(r[c] for c in key) for r in want)
    for k in {r.id for r in want}:
        mine = sorted((r for r in want if r.id == k), key=lambda r: r.history_id)
        for a, b in zip(mine, mine[1:]):
            assert a.operation == 3 or a.valid_to == b.valid_from
        assert all(r.valid_from < r.valid_to or r.operation == 3 for r in mine)


def test_retention_is_exact_from_the_cutoff(policies):
    probes = [T0 + i * H + e for i in range(1, 4) for e in (-US, dt.timedelta(0), US)]
    before = {t: policies.as_of(t).collect() for t in probes}
    assert policies.horizon() is None
    assert policies.prune(T0 + H) == 1 and policies.horizon() == T0 + H
    for t in probes:
        if t < T0 + H:
            with pytest.raises(HistoryHorizonError):
                policies.as_of(t)
        else:
            assert policies.as_of(t).collect() == before[t]
    assert policies.prune(T0) == 0 and policies.horizon() == T0 + H
    assert policies.store.vacuum() > 0 and policies.all_versions().count() == 2
    with pytest.raises(ValueError):
        policies.prune(dt.datetime(2031, 1, 1))
    with pytest.raises(ValueError):
        policies.prune(T0, batch_size=0)
    with pytest.raises(HistoryHorizonError):
        policies.contained_in(T0, T0 + H)


def test_retention_needs_declaring(spark, engine):
    with pytest.raises(RetentionNotEnabledError):
        engine.table(spec()).prune(T0)


def test_partition_filter_is_planned(policies):
    plan = policies.as_of(T0 + H)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(valid_to_month" in plan and "PushedFilters: [IsNotNull(valid_from" in plan


def test_guards(spark, engine, policies):
    with pytest.raises(HistoricalSnapshotError):
        policies.apply_changes(policies.as_of(T0).withColumn("op", F.lit(2)).withColumn("seq", F.lit(0)))
    with pytest.raises(NotTemporalError):
        engine["notes"]
    assert engine["policies"] is policies
    for bad in (dict(key=()), dict(key=("nope",)), dict(key=("updated_at",)), dict(period=("a", "a")), dict(period=("reason", "b"))):
        with pytest.raises(TemporalModelError):
            TemporalSpec(**{"name": "p", "schema": POLICY, "key": ("id",), "exclude": ("updated_at",), **bad})
    with pytest.raises(UnsupportedTemporalQuery):
        TemporalSpec("p", T.StructType().add("id", T.IntegerType()).add("m", T.MapType(T.StringType(), T.StringType())), ("id",))
    s = spec(filters={"f": lambda: F.col("updated_at").isNotNull()}, filter_columns={"f": ("updated_at",)})
    with pytest.raises(UnsupportedTemporalQuery):
        R.as_of(policies.frame(), s, T0, ignore_filters=True)


def test_context_and_reason(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "c"), change_context=lambda: ChangeContext("u1", "Ann", None, "base", None))
    t = e.table(spec(session_user=True))
    t.apply_changes(log(spark, [(1, "a", 1, T0, 1)]))
    with e.reason("outer"), e.reason("inner"):
        t.apply_changes(log(spark, [(1, "b", 1, T0 + H, 2)]))
    rows = {r.operation: r for r in t.history().collect()}
    assert (rows[1].reason, rows[2].reason, rows[2].changed_by) == ("base", "inner", "u1") and rows[1].db_session_user


def test_evolution_keeps_orphans(spark, engine, policies):
    less = TemporalSpec("policies", T.StructType(POLICY.fields[:2]), ("id",), retention=True)
    t = engine.table(less)
    assert "premium" not in t.as_of(T0).columns and "premium" in t.frame().columns
    t.apply_changes(log(spark, [(1, "Back", None, T0 + 5 * H, 2)]))
    again = engine.table(spec(retention=True))
    assert {r.premium for r in again.all_versions().collect()} == {X(100), X(250), None}
    with pytest.raises(SchemaEvolutionError):
        engine.table(TemporalSpec("policies", T.StructType().add("id", T.IntegerType()).add("status", T.IntegerType()), ("id",), retention=True))
    with pytest.raises(SchemaEvolutionError):
        engine.table(spec())
    engine.remove("policies")
    with pytest.raises(NotTemporalError):
        engine["policies"]
    assert engine.table(spec(retention=True)).all_versions().count() == 4


def test_nested_members(spark):
    schema = T.StructType().add("id", T.IntegerType()).add("address", T.StructType().add("street", T.StringType()).add("city", T.StringType())).add("billing", T.StructType().add("iban", T.StringType()).add("day", T.IntegerType()))
    s = TemporalSpec("n", schema, ("id",), required={"billing": "iban"})
    df = spark.createDataFrame([(1, ("x", "Minsk"), None, T0, 1, 0), (1, ("x", "Paris"), ("I", None), T0 + H, 2, 1), (1, None, (None, 3), T0 + 2 * H, 2, 2)], "id int, address struct<street:string,city:string>, billing struct<iban:string,day:int>, commit_ts timestamp_ntz, op int, seq long")
    rows = R.all_versions(derive_history(df, s), s).collect()
    assert [r.address and r.address.city for r in rows] == [None, "Paris", "Minsk"]
    assert [r.billing and tuple(r.billing) for r in rows] == [None, ("I", None), None]


def test_key_change_and_as_of_join(spark):
    df = spark.createDataFrame([(1, "a", X(1), T0, 1, 0, None), (2, "a", X(1), T0 + H, 2, 1, 1)], CHANGES + ", old_id int")
    h = derive_history(expand_key_changes(df, spec()), spec())
    assert periods(h) == [(T0, T0 + H, 1), (T0 + H, dt.datetime(9999, 12, 31, 23, 59, 59, 999999), 2)]
    facts = spark.createDataFrame([(1, T0 + US), (1, T0 + H)], "fid int, at timestamp_ntz")
    assert as_of_join(facts, h, F.col("fid") == F.col("id"), F.col("at")).count() == 1


def test_seed_then_stream(spark, engine, tmp_path):
    from palimpsest.streaming.ingest import ingest

    t = engine.table(spec())
    t.seed(spark.createDataFrame([(1, "s", X(1), None), (2, "s", X(1), None)], POLICY), T0)
    log(spark, [(1, "t", 2, T0 + H, 2), (2, None, None, T0 + H, 3)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark, []).schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(stream, t, str(tmp_path / "ck")).awaitTermination(120)
    assert [(r.id, r.status) for r in t.current().collect()] == [(1, "t")]
    assert t.history().count() == 4
    t.compact()
    assert t.history().count() == 4
