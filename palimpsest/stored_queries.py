"""Queries over tables that the engine has stored, pruned, evolved and streamed, and over its errors, each with its equal in SQL.

The tables are applied in two batches, each sent twice, from the events that the other queries derive in one go, so both must agree.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.engine import Engine, TemporalTable
from palimpsest.functions import period as P
from palimpsest.operators import diff as D
from palimpsest.operators import joins as J
from palimpsest.operators import reader as R
from palimpsest.operators import writer as Wr
from palimpsest.plans.spec import (
    ChangeContext,
    HistoricalSnapshotError,
    HistoryHorizonError,
    NotTemporalError,
    RetentionNotEnabledError,
    SchemaEvolutionError,
    TemporalError,
    TemporalModelError,
    TemporalSpec,
    UnsupportedTemporalQuery,
)
from palimpsest.queries import CUSTOMER, END, ENT, INF, O1, T1, T2, U, USER, VER, F8, L, S, _asof, _at, _struct, _table, user_history
from palimpsest.streaming.ingest import ingest

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_BUILT: dict[tuple[str, str], tuple[Engine, dict[str, TemporalTable]]] = {}


def _query(sql: str):
    def register(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, on one machine alone, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    return f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return Wr.with_operations(_table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


def _apply(engine: Engine, table: TemporalTable, log: DataFrame) -> None:
    for i, part in enumerate((log.where(F.col("ts") < P.ntz(T1)), log.where(F.col("ts") >= P.ntz(T1)))):
        with engine.reason("outer"), engine.reason(f"batch {i}"):
            for _ in range(2):  # the second time it is known
                table.apply_changes(part, order=["ts", "event_id"], ts="ts", batch_id=f"b{i}", dangling_deletes="drop")


def _spec(name: str, **more) -> TemporalSpec:
    return TemporalSpec(name, USER.schema, ("user_id",), **more)


def stored(spark: SparkSession, sf: str) -> tuple[Engine, dict[str, TemporalTable]]:
    """The tables of a folder of data, made once a session: whole, and pruned up to T1 and compacted."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        context = lambda: ChangeContext("loader", "Nightly load", None, "base", None)
        engine = Engine(spark, workspace(spark), clock=lambda: dt.datetime(2030, 1, 1), change_context=context)
        tables = {n: engine.table(_spec(n, retention=True)) for n in ("whole", "pruned")}
        for t in tables.values():
            _apply(engine, t, _log(spark, sf))
        tables["pruned"].prune(T1)
        tables["pruned"].prune(dt.datetime(2024, 1, 2))  # the horizon does not step back
        tables["pruned"].compact()
        tables["pruned"].store.vacuum()
        _BUILT[key] = (engine, tables)
    return _BUILT[key]


def _whole(s: SparkSession, d: str) -> TemporalTable:
    return stored(s, d)[1]["whole"]


def _pruned(s: SparkSession, d: str) -> TemporalTable:
    return stored(s, d)[1]["pruned"]


def _shown(t: TemporalTable) -> DataFrame:
    return t.history(ordered=False).select("entity.*", "valid_from", "valid_to", "is_current", "operation")


def _raised(spark: SparkSession, tries: dict[str, tuple[type[BaseException], Callable]]) -> DataFrame:
    """(guard, raised): whether each call raises its error."""
    rows = []
    for name, (kind, call) in tries.items():
        try:
            call()
            rows.append((name, False))
        except kind:
            rows.append((name, True))
    return spark.createDataFrame(rows, "guard string, raised boolean")


def _all_raise(*names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in names) + ") x(guard, raised)"


_HIST = f"SELECT {ENT}, valid_from, {END}, operation FROM u"


@_query(f"{U} {_asof(T2)}")
def stored_as_of(s, d):
    return _whole(s, d).as_of(T2)


@_query(f"{U} {VER} AND valid_from < TIMESTAMP '{T2}' AND valid_to > TIMESTAMP '{T1}'")
def stored_from_to(s, d):
    return _whole(s, d).from_to(T1, T2)


@_query(f"{U} {VER} AND valid_from >= TIMESTAMP '{T1}' AND valid_to <= TIMESTAMP '{T2}'")
def stored_contained_in(s, d):
    return _whole(s, d).contained_in(T1, T2)


@_query(f"{U} {VER}")
def stored_all_versions(s, d):
    return _whole(s, d).all_versions()


@_query(f"{U} {_HIST}")
def stored_history(s, d):
    return _shown(_whole(s, d))


@_query(f"{U} SELECT {ENT} FROM u WHERE valid_to = {INF}")
def stored_current(s, d):
    return _whole(s, d).current()


@_query(f"{U} SELECT strftime(valid_to, '%Y-%m') AS month, count(*) AS n FROM u GROUP BY 1")
def stored_partitions(s, d):
    """The partition column is the month of valid_to, 9999-12 for open rows."""
    return _whole(s, d).frame().groupBy(F.col(R.BUCKET).alias("month")).agg(F.count("*").alias("n"))


@_query(f"{U} SELECT changed_by, changed_by_name, correlation_id, reason, operation, count(*) AS n FROM (SELECT 'loader' AS changed_by, 'Nightly load' AS changed_by_name, NULL::VARCHAR AS correlation_id, CASE WHEN e.ts < TIMESTAMP '{T1}' THEN 'batch 0' ELSE 'batch 1' END AS reason, operation FROM u JOIN events e ON e.event_id = u.history_id) GROUP BY ALL")
def stored_context(s, d):
    """The provider's context, and over it the innermost reason."""
    return _whole(s, d).history(ordered=False).groupBy("changed_by", "changed_by_name", "correlation_id", "reason", "operation").agg(F.count("*").alias("n"))


@_query(f"{U} SELECT count(*) AS n, count(*) AS ids, 0::BIGINT AS falling FROM u")
def stored_history_ids(s, d):
    """Ids are distinct and rise along each key."""
    from pyspark.sql import Window as W

    h = _whole(s, d).frame()
    before = F.lag("history_id").over(W.partitionBy("user_id").orderBy("valid_from", "valid_to"))
    return h.select("history_id", (F.col("history_id") <= before).alias("falls")).agg(F.count("*").alias("n"), F.count_distinct("history_id").alias("ids"), F.count_if("falls").alias("falling"))


def _diffs(rows: str, keep: str) -> str:
    text = {"user_id": "user_id::VARCHAR", "event_type": "event_type", "value": "NULL::VARCHAR", "props": "props"}
    return " UNION ALL ".join(f"SELECT {keep}, {i} AS ordinal, '{c}' AS path, {x.replace(c, 'o_' + c, 1) if 'NULL' not in x else x} AS old_value, {x} AS new_value FROM {rows} WHERE first OR {c} IS DISTINCT FROM o_{c}" for i, (c, x) in enumerate(text.items()))


def _text(df: DataFrame) -> DataFrame:
    """Doubles are written differently by the two engines."""
    return df.withColumns({c: F.when(F.col("path") != "value", F.col(c)) for c in ("old_value", "new_value")})


_LAG = ", ".join(f"lag({c}) OVER w AS o_{c}" for c in ("user_id", "event_type", "value", "props"))


@_query(f"{U}, v AS (SELECT *, lag(history_id) OVER w IS NULL AS first, {_LAG} FROM u WHERE operation <> 3 WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, history_id)) {_diffs('v', 'user_id, valid_from')}")
def stored_diff_timeline(s, d):
    """Deletes are stepped over: what is inserted again is compared with what was deleted."""
    return _text(_whole(s, d).diff_timeline())


@_query(f"""{U}, a AS ({_asof(T1)}), b AS ({_asof(T2)}), v AS (SELECT b.*, a.user_id IS NULL AS first, a.user_id AS o_user_id, a.event_type AS o_event_type, a.value AS o_value, a.props AS o_props
FROM b LEFT JOIN a USING (user_id)) {_diffs('v', 'user_id')}""")
def stored_diff_between(s, d):
    return _text(_whole(s, d).diff_between(T1, T2))


@_query(f"{U} {_asof(T2)}")
def pruned_as_of(s, d):
    return _pruned(s, d).as_of(T2)


@_query(f"{U} {_asof(T1)}")
def pruned_as_of_horizon(s, d):
    return _pruned(s, d).as_of(T1)


@_query(f"{U} {_HIST} WHERE valid_to > TIMESTAMP '{T1}'")
def pruned_history(s, d):
    return _shown(_pruned(s, d))


@_query(f"SELECT TIMESTAMP '{T1}' AS horizon, true AS before_fails")
def pruned_horizon(s, d):
    """The horizon, which never steps back, and that reads before it fail."""
    t = _pruned(s, d)
    fails = [_raised(s, {"r": (HistoryHorizonError, call)}).first().raised for call in (lambda: t.as_of(T1 - dt.timedelta(microseconds=1)), lambda: t.from_to(dt.datetime(2024, 1, 1), T2), lambda: t.contained_in(dt.datetime(2024, 1, 1), T2))]
    return s.range(1).select(P.ntz(t.horizon()).alias("horizon"), F.lit(all(fails)).alias("before_fails"))


@_query(f"{U} SELECT count(*) FILTER (valid_to <= TIMESTAMP '{T1}') AS pruned, 0::BIGINT AS again, count(*) FILTER (valid_to > TIMESTAMP '{T1}') AS kept FROM u")
def prune_counts(s, d):
    e = Engine(s, workspace(s), clock=lambda: dt.datetime(2030, 1, 1))
    t = e.table(_spec("counted", retention=True))
    _apply(e, t, _log(s, d))
    first, again = t.prune(T1), t.prune(T1)
    return t.frame().agg(F.lit(first).cast("long").alias("pruned"), F.lit(again).cast("long").alias("again"), F.count("*").alias("kept"))


@_query(f"{U} SELECT user_id, event_type, value, props AS lost_props FROM u WHERE {_at(T2)}")
def evolved_as_of(s, d):
    """A column that the entity lost stays in the history; declared anew with its name, the table is read under another one."""
    e = Engine(s, workspace(s))
    _apply(e, e.table(_spec("evolving")), _log(s, d))
    less = TemporalSpec("evolving", _struct(user_id=L, event_type=S, value=F8), ("user_id",))
    t = e.table(less)
    assert "props" not in t.as_of(T2).columns
    moved = e.rename("evolving", TemporalSpec("renamed", less.schema, ("user_id",), entity_id=less.identity))
    h = moved.frame()
    return h.where(P.contains_instant(F.col("valid_from"), F.col("valid_to"), T2)).select("user_id", "event_type", "value", F.col("props").alias("lost_props"))


@_query(f"{U} SELECT {ENT} FROM u WHERE valid_to = {INF}")
def reconnected_current(s, d):
    """An entity that stops being temporal and returns finds its history."""
    e = Engine(s, workspace(s))
    _apply(e, e.table(_spec("back")), _log(s, d))
    e.remove("back")
    return e.table(_spec("back")).current()


@_query(f"{U} {_HIST}")
def streamed_history(s, d):
    """Two streams, one after the other and each started twice, into one table."""
    root = workspace(s)
    t = Engine(s, f"{root}/t").table(_spec("streamed"))
    log = _log(s, d)
    for i, part in enumerate((log.where(F.col("ts") < P.ntz(T1)), log.where(F.col("ts") >= P.ntz(T1)))):
        part.write.parquet(f"{root}/in{i}")
        for _ in range(2):
            ingest(s.readStream.schema(log.schema).parquet(f"{root}/in{i}"), t, f"{root}/ck{i}", order=["ts", "event_id"], ts="ts").awaitTermination()
    return _shown(t)


@_query(f"SELECT c_custkey, c_name, c_nationkey, c_mktsegment, TIMESTAMP '{O1}' AS valid_from, true AS is_current, 1::SMALLINT AS operation FROM customer")
def seeded_history(s, d):
    t = Engine(s, workspace(s)).table(CUSTOMER)
    t.seed(_table(s, d, "customer"), O1)
    return t.history(ordered=False).select("entity.*", "valid_from", "is_current", "operation")


# ---- errors, one row each


@_query(_all_raise("from_after_to", "null_instant", "not_temporal", "filter_on_excluded", "filter_ignored_on_excluded", "removed_entity"))
def guard_reads(s, d):
    t, h = _whole(s, d), user_history(s, d)
    lost = TemporalSpec("lost", USER.schema, ("user_id",), exclude=("props",), filters={"f": lambda: F.col("props").isNotNull()})
    e = Engine(s, workspace(s))
    gone = e.table(_spec("gone"))
    e.remove("gone")
    return _raised(s, {
        "from_after_to": (ValueError, lambda: t.from_to(T2, T1)),
        "null_instant": (TypeError, lambda: t.as_of(None)),
        "not_temporal": (NotTemporalError, lambda: stored(s, d)[0]["notes"]),
        "filter_on_excluded": (UnsupportedTemporalQuery, lambda: R.as_of(h.drop("props"), lost, T1)),
        "filter_ignored_on_excluded": (UnsupportedTemporalQuery, lambda: R.as_of(h, lost, T1, ignore_filters=True)),
        "removed_entity": (NotTemporalError, lambda: gone.as_of(T1)),
    })


@_query(_all_raise("save_as_of", "save_entity", "save_union", "duplicate_insert", "missing_row", "provider_fails"))
def guard_writes(s, d):
    t = _whole(s, d)

    def fails():
        raise KeyError("no user")

    e, broken = Engine(s, workspace(s)), Engine(s, workspace(s), change_context=fails)
    w, x = e.table(_spec("w")), broken.table(_spec("x"))
    row = lambda op, seq: s.createDataFrame([(1, "a", 1.0, "p", T1, op, seq)], "user_id long, event_type string, value double, props string, commit_ts timestamp_ntz, op int, seq long")
    mark = lambda df: df.withColumns({"op": F.lit(2), "seq": F.lit(0), "commit_ts": P.ntz(T2)})
    w.apply_changes(row(1, 0))
    return _raised(s, {
        "save_as_of": (HistoricalSnapshotError, lambda: w.apply_changes(mark(t.as_of(T1)))),
        "save_entity": (HistoricalSnapshotError, lambda: w.apply_changes(mark(t.history().select("entity.*")))),
        "save_union": (HistoricalSnapshotError, lambda: w.apply_changes(mark(t.as_of(T1).unionByName(t.as_of(T2))))),
        "duplicate_insert": (TemporalError, lambda: w.apply_changes(row(1, 1))),
        "missing_row": (TemporalError, lambda: w.apply_changes(row(3, 1).withColumn("user_id", F.lit(2).cast("long")))),
        "provider_fails": (KeyError, lambda: x.apply_changes(row(1, 0))),
    })


@_query(_all_raise("no_key", "unknown_key", "excluded_key", "same_period", "reserved_period", "reserved_column", "map_member", "type_change", "key_change", "retention_withdrawn"))
def guard_model(s, d):
    e = Engine(s, workspace(s))
    e.table(_spec("m", retention=True))
    spec = lambda **more: lambda: TemporalSpec(**{"name": "m", "schema": USER.schema, "key": ("user_id",), **more})
    return _raised(s, {
        "no_key": (TemporalModelError, spec(key=())),
        "unknown_key": (TemporalModelError, spec(key=("nope",))),
        "excluded_key": (TemporalModelError, spec(exclude=("user_id",))),
        "same_period": (TemporalModelError, spec(period=("a", "a"))),
        "reserved_period": (TemporalModelError, spec(period=("reason", "b"))),
        "reserved_column": (TemporalModelError, spec(schema=_struct(user_id=L, operation=S))),
        "map_member": (UnsupportedTemporalQuery, spec(schema=_struct(user_id=L, m=T.MapType(S, S)))),
        "type_change": (SchemaEvolutionError, lambda: e.table(spec(schema=_struct(user_id=L, event_type=L), retention=True)())),
        "key_change": (SchemaEvolutionError, lambda: e.table(spec(key=("user_id", "event_type"), retention=True)())),
        "retention_withdrawn": (SchemaEvolutionError, lambda: e.table(_spec("m"))),
    })


@_query(_all_raise("no_retention", "future_cutoff", "batch_size", "null_cutoff", "diff_order", "pair_keys", "pair_order", "pair_tombstone"))
def guard_retention_and_diff(s, d):
    e, tables = stored(s, d)
    plain = Engine(s, workspace(s)).table(_spec("plain"))
    t = tables["whole"]
    v = {"user_id": 1, "event_type": "a", "value": 1.0, "props": None, "valid_from": T1, "operation": 1}
    return _raised(s, {
        "no_retention": (RetentionNotEnabledError, lambda: plain.prune(T1)),
        "future_cutoff": (ValueError, lambda: t.prune(dt.datetime(2031, 1, 1))),
        "batch_size": (ValueError, lambda: t.prune(T1, batch_size=0)),
        "null_cutoff": (TypeError, lambda: t.prune(None)),
        "diff_order": (ValueError, lambda: t.diff_between(T2, T1)),
        "pair_keys": (ValueError, lambda: t.diff(v, {**v, "user_id": 2, "valid_from": T2})),
        "pair_order": (ValueError, lambda: t.diff({**v, "valid_from": T2}, v)),
        "pair_tombstone": (ValueError, lambda: t.diff(v, {**v, "operation": 3, "valid_from": T2})),
    })


# ---- derivation and composition


@_query(f"{U} SELECT history_id, user_id, nullif(CASE WHEN e.event_type = 'click' THEN '' ELSE e.event_type END, '') AS changed_by, NULL::VARCHAR AS reason FROM u JOIN (SELECT event_id, event_type FROM events) e ON e.event_id = history_id")
def derive_context(s, d):
    """An empty context is null, a missing one too."""
    log = _log(s, d).withColumn("changed_by", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")))
    h = Wr.derive_history(log, USER, order=["ts", "event_id"], ts="ts", history_id="event_id")
    return h.select("history_id", "user_id", "changed_by", "reason")


_MOVE = dt.datetime(2002, 1, 1)


@_query(f"""SELECT c_custkey, c_name, TIMESTAMP '{O1}' AS valid_from, CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '{_MOVE}' END AS valid_to, 1::SMALLINT AS operation FROM customer
UNION ALL SELECT c_custkey + 1000000000, c_name, TIMESTAMP '{_MOVE}', NULL, 2::SMALLINT FROM customer WHERE c_mktsegment = 'BUILDING'""")
def key_change(s, d):
    """An update that changes the key closes the old chain without a tombstone and goes on under the new key."""
    c = _table(s, d, "customer")
    none = F.lit(None).cast("long")
    born = c.select(*CUSTOMER.columns, F.lit(1).alias("op"), P.ntz(O1).alias("at"), F.col("c_custkey").alias("seq"), none.alias("old_c_custkey"))
    moved = c.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), "c_name", "c_nationkey", "c_mktsegment", F.lit(2).alias("op"), P.ntz(_MOVE).alias("at"), (F.col("c_custkey") + 1_000_000_000).alias("seq"), F.col("c_custkey").alias("old_c_custkey"))
    h = Wr.derive_history(Wr.expand_key_changes(born.unionByName(moved), CUSTOMER), CUSTOMER, order=["at", "seq"], ts="at", history_id="seq")
    return h.select("c_custkey", "c_name", "valid_from", P.closed_or_null(F.col("valid_to")).alias("valid_to"), "operation")


@_query(f"{U} {_asof(T1 - dt.timedelta(hours=2))}")
def asof_zoned_instant(s, d):
    """An instant with a zone is taken to UTC."""
    return R.as_of(user_history(s, d), USER, T1.replace(tzinfo=dt.timezone(dt.timedelta(hours=2))))


TAGGED = TemporalSpec("tagged", _struct(user_id=L, tags=T.ArrayType(S), doc=S, raw=T.BinaryType()), ("user_id",), json_columns=("doc",))


@_query("""WITH a AS (SELECT user_id, event_id, ts, [event_type, 'x'] AS tags, CASE WHEN event_id % 2 = 0 THEN '{"b": 1, "t": "' || event_type || '"}' ELSE '{"t":"' || event_type || '","b":1}' END AS doc, event_type, event_type AS raw,
lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
SELECT user_id, path, count(*) AS n FROM (SELECT user_id, unnest(CASE WHEN last IS NULL THEN ['user_id', 'tags', 'doc', 'raw'] WHEN last <> event_type THEN ['tags', 'doc', 'raw'] ELSE []::VARCHAR[] END) AS path FROM a) GROUP BY 1, 2""")
def diff_value_kinds(s, d):
    """Arrays and binaries are compared by their elements and bytes, JSON by its content, in the derivation and in the diff."""
    t = F.col("event_type")
    doc = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b": 1, "t": "'), t, F.lit('"}'))).otherwise(F.concat(F.lit('{"t":"'), t, F.lit('","b":1}')))
    e = _table(s, d, "events").select("user_id", "event_id", "ts", F.array(t, F.lit("x")).alias("tags"), doc.alias("doc"), t.cast("binary").alias("raw"))
    log = Wr.with_operations(e, ["user_id"], ["ts", "event_id"], F.lit(False))
    h = Wr.derive_history(log, TAGGED, order=["ts", "event_id"], ts="ts", history_id="event_id")
    return D.diff_timeline(h, TAGGED).groupBy("user_id", "path").agg(F.count("*").alias("n"))


@_query(f"{U}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from, history_id) AS k FROM u WHERE operation <> 3), x AS (SELECT * FROM p WHERE user_id = (SELECT min(user_id) FROM p WHERE k = 2)), a AS (SELECT * FROM x WHERE k = 1), b AS (SELECT * FROM x WHERE k = 2) "
        "SELECT path FROM (SELECT unnest([CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN 'event_type' END, CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value' END, CASE WHEN a.props IS DISTINCT FROM b.props THEN 'props' END]) AS path FROM a, b) WHERE path IS NOT NULL")
def diff_version_pair(s, d):
    """Two versions of one key, compared on the driver."""
    v = user_history(s, d).where("operation <> 3")
    key = v.groupBy("user_id").count().where("count >= 2").agg(F.min("user_id")).first()[0]
    a, b = (r.asDict() for r in v.where(F.col("user_id") == key).orderBy("valid_from", "history_id").limit(2).collect())
    return s.createDataFrame([(p,) for p, _, _ in D.diff_pair(a, b, USER)], "path string")


@_query(f"{U}, a AS ({_asof(T1)}) SELECT c_custkey, event_type FROM customer LEFT JOIN a ON user_id = c_custkey")
def asof_outer_join(s, d):
    a = R.as_of(user_history(s, d), USER, T1)
    return _table(s, d, "customer").join(a, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "event_type")


@_query(f"{U}, a AS ({_asof(T1)}) SELECT a.user_id, b.user_id AS other FROM a JOIN a b ON a.event_type = b.event_type AND a.value < b.value AND a.props = b.props")
def asof_theta_join(s, d):
    a = R.as_of(user_history(s, d), USER, T1)
    b = a.select(F.col("user_id").alias("other"), F.col("event_type").alias("t2"), F.col("value").alias("v2"), F.col("props").alias("p2"))
    return a.join(b, (F.col("event_type") == F.col("t2")) & (F.col("props") == F.col("p2")) & (F.col("value") < F.col("v2"))).select("user_id", "other")


@_query(f"{U} SELECT user_id, event_type FROM u WHERE {_at(T1)} AND user_id = (SELECT min(user_id) FROM u WHERE {_at(T1)})")
def asof_single(s, d):
    """Exactly one row, or an error."""
    a = R.as_of(user_history(s, d), USER, T1)
    least = a.agg(F.min("user_id")).first()[0]
    return R.single(a.where(F.col("user_id") == least)).select("user_id", "event_type")


@_query(f"{U} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(round(value * 100)::BIGINT)::BIGINT AS cents, round(avg(round(value * 100)::BIGINT), 6) AS mean_cents FROM u WHERE operation <> 3 GROUP BY event_type")
def version_totals(s, d):
    cents = F.round(F.col("value") * 100).cast("long")
    v = R.all_versions(user_history(s, d), USER, ordered=False)
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(cents).alias("cents"), F.round(F.avg(cents), 6).alias("mean_cents"))


@_query(f"{U} SELECT event_type, operation, count(*) AS n FROM u GROUP BY CUBE (event_type, operation)")
def history_cube(s, d):
    return user_history(s, d).cube("event_type", "operation").agg(F.count("*").alias("n"))


@_query(f"{U} SELECT event_type, operation, count(*) AS n FROM u GROUP BY ROLLUP (event_type, operation)")
def history_rollup(s, d):
    return user_history(s, d).rollup("event_type", "operation").agg(F.count("*").alias("n"))


@_query(f"{U} {VER} ORDER BY value, user_id, valid_from LIMIT 25")
def versions_reordered(s, d):
    """A sort of one's own replaces the default order."""
    return R.all_versions(user_history(s, d), USER).orderBy("value", "user_id", "valid_from").limit(25)


@_query(f"{U} SELECT user_id FROM u WHERE {_at(T2)} INTERSECT SELECT user_id FROM u WHERE {_at(T1)}")
def intersect_users(s, d):
    h = user_history(s, d)
    return R.as_of(h, USER, T2).select("user_id").intersect(R.as_of(h, USER, T1).select("user_id"))


@_query(f"{U} SELECT user_id, upper(event_type) AS kind, length(props) AS size, coalesce(value, 0) > 10 AS large, year(valid_from) AS y, substr(event_type, 1, 2) || '-' || user_id::VARCHAR AS tag FROM u WHERE operation <> 3")
def scalar_functions(s, d):
    v = R.all_versions(user_history(s, d), USER, ordered=False)
    return v.select("user_id", F.upper("event_type").alias("kind"), F.length("props").cast("long").alias("size"), (F.coalesce("value", F.lit(0.0)) > 10).alias("large"), F.year("valid_from").cast("long").alias("y"), F.concat_ws("-", F.substring("event_type", 1, 2), F.col("user_id").cast("string")).alias("tag"))


@_query(f"{U} {_asof(T1)} AND list_contains(['click', 'purchase'], event_type)")
def asof_array_contains(s, d):
    return R.as_of(user_history(s, d), USER, T1).where(F.array_contains(F.array(F.lit("click"), F.lit("purchase")), F.col("event_type")))


@_query(f"{U} SELECT user_id, (props::JSON ->> 'k')::BIGINT AS k, (props::JSON ->> 'none') IS NULL AS absent FROM u WHERE {_at(T1)}")
def asof_json_member(s, d):
    a = R.as_of(user_history(s, d), USER, T1)
    return a.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").isNull().alias("absent"))


@_query(f"{U}, t AS (SELECT unnest([TIMESTAMP '{T1}', TIMESTAMP '{T2}', TIMESTAMP '2024-01-05']) AS instant) SELECT instant, event_type, count(*) AS n FROM t JOIN u ON operation <> 3 AND valid_from <= instant AND valid_to > instant GROUP BY 1, 2")
def asof_many_instants(s, d):
    """One plan for many instants, which come as rows."""
    at = s.createDataFrame([(T1,), (T2,), (dt.datetime(2024, 1, 5),)], "instant timestamp_ntz")
    out = J.as_of_many(at, user_history(s, d), F.col("instant"))
    return out.groupBy("instant", "event_type").agg(F.count("*").alias("n"))


_SHAPE = [("history_id", "bigint"), *[(c, t) for c, t in (("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))], ("valid_from", "timestamp_ntz"), ("valid_to", "timestamp_ntz"), ("operation", "smallint"), *[(c, "string") for c in ("changed_by", "changed_by_name", "correlation_id", "reason", "extra")]]


@_query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_SHAPE)) + ") x(ordinal, name, kind)")
def history_schema(s, d):
    fields = _whole(s, d).frame().drop(R.BUCKET).schema.fields
    return s.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "ordinal int, name string, kind string")
