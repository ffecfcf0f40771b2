"""The engine's queries over the driver's tables, each with its equal in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import period as P
from palimpsest.operators import diff as D
from palimpsest.operators import joins as J
from palimpsest.operators import reader as R
from palimpsest.operators import writer as Wr
from palimpsest.plans.spec import TemporalSpec

T1 = dt.datetime(2024, 1, 15, 12)
T2 = dt.datetime(2024, 1, 25, 12)
O1 = dt.datetime(2001, 7, 1)
EARLY = dt.datetime(1970, 1, 1)

def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


L, S, F8 = T.LongType(), T.StringType(), T.DoubleType()
USER = TemporalSpec("user_state", _struct(user_id=L, event_type=S, value=F8, props=S), ("user_id",), retention=True)
USER_TYPE = TemporalSpec("user_type_state", USER.schema, ("user_id", "event_type"))
ORDER = TemporalSpec("cust_order_state", _struct(o_custkey=L, o_orderstatus=S, o_orderpriority=S, o_totalprice=F8), ("o_custkey",), exclude=("o_totalprice",))
CUSTOMER = TemporalSpec("dim_customer", _struct(c_custkey=L, c_name=S, c_nationkey=T.IntegerType(), c_mktsegment=S), ("c_custkey",))
#: Nested members over the same flat columns: action is there when its kind is.
NESTED = TemporalSpec("nested_state", _struct(user_id=L, event=_struct(type=S, value=F8), props=S), ("user_id",), required={"event": "value"})


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def user_history(spark: SparkSession, sf: str, writer: str = "trigger") -> DataFrame:
    log = Wr.with_operations(_table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return Wr.derive_history(log, USER, order=["ts", "event_id"], ts="ts", history_id="event_id", writer=writer)


def user_type_history(spark: SparkSession, sf: str) -> DataFrame:
    log = Wr.with_operations(_table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], F.lit(False))
    return Wr.derive_history(log, USER_TYPE, order=["ts", "event_id"], ts="ts", history_id="event_id")


def order_history(spark: SparkSession, sf: str, writer: str = "trigger") -> DataFrame:
    log = Wr.with_operations(_table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.lit(False))
    return Wr.derive_history(log, ORDER, order=["o_orderdate", "o_orderkey"], ts="o_orderdate", history_id="o_orderkey", writer=writer)


def customer_history(spark: SparkSession, sf: str) -> DataFrame:
    return Wr.seed(_table(spark, sf, "customer"), CUSTOMER, O1, history_id=F.col("c_custkey"))


def _cte(name: str, table: str, key: str, cols: str, ts: str, hid: str, delete: str, noop: bool) -> str:
    """The derivation in SQL. key, cols: comma-joined; cols are the versioned columns besides the key."""
    n, cs = name, [c.strip() for c in cols.split(",")]
    lags = ", ".join(f"lag({c}) OVER w AS l_{c}" for c in cs)
    same = " AND ".join(f"{c} IS NOT DISTINCT FROM l_{c}" for c in cs)
    out = ", ".join(f"CASE WHEN op = 3 THEN l_{c} ELSE {c} END AS {c}" for c in cs)
    return f"""{n}_a AS (SELECT {key}, {cols}, {hid} AS history_id, epoch_us({ts}) AS us, {ts} AS o1, ({delete}) AS del FROM {table}),
{n}_b AS (SELECT *, lag(del) OVER w AS pd, {lags} FROM {n}_a WINDOW w AS (PARTITION BY {key} ORDER BY o1, history_id)),
{n}_c AS (SELECT *, CASE WHEN del THEN 3 WHEN coalesce(pd, true) THEN 1 ELSE 2 END AS op FROM {n}_b WHERE NOT (del AND coalesce(pd, true))),
{n}_d AS (SELECT * FROM {n}_c {f"WHERE NOT (op = 2 AND {same})" if noop else ""}),
{n}_e AS (SELECT *, sum(CASE WHEN op = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY o1, history_id ROWS UNBOUNDED PRECEDING) AS life FROM {n}_d),
{n}_f AS (SELECT *, row_number() OVER (PARTITION BY {key}, life ORDER BY o1, history_id) AS rn FROM {n}_e),
{n}_g AS (SELECT *, rn + max(us - rn) OVER (PARTITION BY {key}, life ORDER BY rn ROWS UNBOUNDED PRECEDING) AS vf FROM {n}_f),
{n}_h AS (SELECT *, CASE WHEN op = 3 THEN vf ELSE coalesce(lead(vf) OVER (PARTITION BY {key}, life ORDER BY rn), {P.SENTINEL_US}) END AS vt FROM {n}_g),
{n} AS (SELECT {key}, {out}, history_id, make_timestamp(vf::BIGINT) AS valid_from, make_timestamp(vt::BIGINT) AS valid_to, op::SMALLINT AS operation FROM {n}_h)"""


U = "WITH " + _cte("u", "events", "user_id", "event_type, value, props", "ts", "event_id", "event_type = 'error'", True)
U_ALL = "WITH " + _cte("u", "events", "user_id", "event_type, value, props", "ts", "event_id", "event_type = 'error'", False)
UT = "WITH " + _cte("u", "events", "user_id, event_type", "value, props", "ts", "event_id", "false", True)
O = "WITH " + _cte("o", "orders", "o_custkey", "o_orderstatus, o_orderpriority", "o_orderdate", "o_orderkey", "false", True)  # noqa: E741
O_ALL = "WITH " + _cte("o", "orders", "o_custkey", "o_orderstatus, o_orderpriority", "o_orderdate", "o_orderkey", "false", False)
UTU = U + ",\n" + _cte("x", "events", "user_id, event_type", "value, props", "ts", "event_id", "false", True)
UO = U + ",\n" + O.removeprefix("WITH ")
INF = f"TIMESTAMP '{P.SENTINEL}'"
END = f"nullif(valid_to, {INF}) AS valid_to, valid_to = {INF} AS is_current"
ENT = "user_id, event_type, value, props"
VER = f"SELECT {ENT}, valid_from, {END} FROM u WHERE operation <> 3"


def _at(t: dt.datetime, r: str = "") -> str:
    return f"{r}valid_from <= TIMESTAMP '{t}' AND {r}valid_to > TIMESTAMP '{t}'"


def _asof(t: dt.datetime) -> str:
    return f"SELECT {ENT} FROM u WHERE {_at(t)}"


def _unpivot(spec: TemporalSpec, rows: str, keep: str, kinds: dict[str, str] | None = None) -> str:
    parts = []
    for i, x in enumerate(spec.diff_order()):
        c = x.column
        parts.append(f"SELECT {keep}, {i} AS ordinal, '{x.path}' AS path, o_{c}::VARCHAR AS old_value, {c}::VARCHAR AS new_value FROM {rows} WHERE first OR {c} IS DISTINCT FROM o_{c}")
    return " UNION ALL ".join(parts)


def _shown_history(h: DataFrame, spec: TemporalSpec) -> DataFrame:
    e = R.history_rows(h, spec, ordered=False)
    return e.select("history_id", "entity.*", "valid_from", "valid_to", "is_current", "operation")


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f):
        name = f.__name__
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@_query(f"{U} {_asof(T1)}")
def asof_user_state(s, d):
    return R.as_of(user_history(s, d), USER, T1)


@_query(f"{U} {_asof(EARLY)}")
def asof_before_first(s, d):
    return R.as_of(user_history(s, d), USER, EARLY)


@_query(f"{U}, b AS (SELECT min(valid_from) AS t FROM u WHERE operation = 2) SELECT {ENT}, valid_from = t AS opens FROM u, b WHERE valid_from <= t AND valid_to > t")
def asof_boundary(s, d):
    h = user_history(s, d)
    t = h.where("operation = 2").agg(F.min("valid_from")).first()[0] or EARLY
    return h.where(P.contains_instant(F.col("valid_from"), F.col("valid_to"), t)).select(*USER.columns, (F.col("valid_from") == P.ntz(t)).alias("opens"))


@_query(f"{U} SELECT user_id, value FROM u WHERE {_at(T1)} AND event_type = 'purchase' ORDER BY value DESC, user_id LIMIT 10")
def asof_composed_filter_topk(s, d):
    return R.as_of(user_history(s, d), USER, T1).where("event_type = 'purchase'").orderBy(F.desc("value"), "user_id").limit(10).select("user_id", "value")


@_query(f"{U} SELECT event_type, count(*) AS n FROM u WHERE {_at(T1)} GROUP BY event_type")
def asof_count_by_type(s, d):
    return R.as_of(user_history(s, d), USER, T1).groupBy("event_type").agg(F.count("*").alias("n"))


@_query(f"{UO} SELECT u.user_id, u.event_type, o.o_orderstatus FROM u JOIN o ON u.user_id = o.o_custkey WHERE {_at(T1, 'u.')} AND {_at(O1, 'o.')}")
def asof_join_asof(s, d):
    a, b = R.as_of(user_history(s, d), USER, T1), R.as_of(order_history(s, d), ORDER, O1)
    return a.join(b, a.user_id == b.o_custkey).select("user_id", "event_type", "o_orderstatus")


@_query(f"{U} {_asof(T1)} UNION ALL {_asof(T2)}")
def asof_concat_two_instants(s, d):
    h = user_history(s, d)
    return R.as_of(h, USER, T1).unionByName(R.as_of(h, USER, T2))


@_query(f"{U} {_asof(T1)} UNION {_asof(T2)}")
def asof_union_distinct(s, d):
    h = user_history(s, d)
    return R.as_of(h, USER, T1).unionByName(R.as_of(h, USER, T2)).distinct()


@_query(f"{U} {_asof(T1)} AND user_id IN (SELECT c_custkey FROM customer)")
def asof_semi_current(s, d):
    return R.as_of(user_history(s, d), USER, T1).join(_table(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left_semi")


@_query(f"{U} SELECT EXISTS (SELECT 1 FROM u WHERE {_at(T1)} AND event_type = 'signup') AS found")
def asof_any(s, d):
    return R.as_of(user_history(s, d), USER, T1).agg((F.count_if(F.col("event_type") == "signup") > 0).alias("found"))


@_query(f"{UT} SELECT {ENT} FROM u WHERE {_at(T1)}")
def asof_composite_key(s, d):
    return R.as_of(user_type_history(s, d), USER_TYPE, T1).select("user_id", "event_type", "value", "props")


@_query(f"{U} {VER}")
def all_versions(s, d):
    return R.all_versions(user_history(s, d), USER)


@_query(f"{U} SELECT user_id, count(*) AS n, min(valid_from) AS first_from FROM u WHERE operation <> 3 GROUP BY user_id")
def all_versions_count(s, d):
    return R.all_versions(user_history(s, d), USER, ordered=False).groupBy("user_id").agg(F.count("*").alias("n"), F.min("valid_from").alias("first_from"))


@_query(f"{U} SELECT DISTINCT user_id, event_type FROM u WHERE operation <> 3")
def all_versions_distinct(s, d):
    return R.all_versions(user_history(s, d), USER, ordered=False).select("user_id", "event_type").distinct()


@_query(f"{U} {VER} ORDER BY valid_from DESC, user_id LIMIT 20")
def all_versions_newest(s, d):
    return R.all_versions(user_history(s, d), USER).orderBy(F.desc("valid_from"), "user_id").limit(20)


@_query(f"{U} {VER} AND valid_from < TIMESTAMP '{T2}' AND valid_to > TIMESTAMP '{T1}'")
def from_to_month(s, d):
    return R.from_to(user_history(s, d), USER, T1, T2)


@_query(f"{U} {VER} AND false")
def from_to_empty(s, d):
    return R.from_to(user_history(s, d), USER, T1, T1)


@_query(f"{U} {VER} AND valid_to > TIMESTAMP '{T1}'")
def from_to_unbounded(s, d):
    return R.from_to(user_history(s, d), USER, T1, dt.datetime.max)


@_query(f"{U} {VER} AND valid_from >= TIMESTAMP '{T1}' AND valid_to <= TIMESTAMP '{T2}'")
def contained_in_week(s, d):
    return R.contained_in(user_history(s, d), USER, T1, T2)


@_query(f"{U} {VER} AND valid_from >= TIMESTAMP '{T1}'")
def contained_in_unbounded(s, d):
    return R.contained_in(user_history(s, d), USER, T1, dt.datetime.max)


@_query(f"{U} SELECT history_id, {ENT}, valid_from, {END}, operation FROM u")
def history_full(s, d):
    return _shown_history(user_history(s, d), USER)


@_query(f"{U} SELECT history_id, {ENT}, valid_from, {END}, operation FROM u WHERE operation = 3")
def history_deletes(s, d):
    return _shown_history(user_history(s, d), USER).where("operation = 3")


@_query(f"{U} SELECT history_id, {ENT}, valid_from, {END}, operation FROM u WHERE valid_from >= TIMESTAMP '{T1}' AND valid_from < TIMESTAMP '{T2}'")
def history_in_window(s, d):
    return _shown_history(user_history(s, d), USER).where((F.col("valid_from") >= P.ntz(T1)) & (F.col("valid_from") < P.ntz(T2)))


@_query(f"{U}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, history_id DESC) AS k FROM u) SELECT history_id, {ENT}, valid_from, operation FROM r WHERE k = 1")
def history_latest_per_key(s, d):
    return R.latest_per_key(user_history(s, d), USER).select("history_id", *USER.columns, "valid_from", "operation")


@_query(f"{U} SELECT {ENT} FROM u WHERE valid_to = {INF}")
def current_versions(s, d):
    return R.current(user_history(s, d), USER)


_O = "SELECT history_id, o_custkey, o_orderstatus, o_orderpriority, valid_from, " + END + ", operation FROM o"


@_query(f"{O} {_O}")
def derive_noop_suppressed(s, d):
    return _shown_history(order_history(s, d), ORDER)


@_query(f"{O_ALL} {_O}")
def derive_interceptor_mode(s, d):
    return _shown_history(order_history(s, d, writer="interceptor"), ORDER)


@_query(f"{O_ALL} {_O} WHERE epoch_us(valid_from) % 86400000000 <> 0")
def derive_clamped_ties(s, d):
    return _shown_history(order_history(s, d, writer="interceptor"), ORDER).where(F.pmod(P.to_us(F.col("valid_from")), F.lit(86_400_000_000)) != 0)


@_query(f"{UT} SELECT history_id, {ENT}, valid_from, {END}, operation FROM u")
def derive_composite_key(s, d):
    return _shown_history(user_type_history(s, d), USER_TYPE).select("history_id", "user_id", "event_type", "value", "props", "valid_from", "valid_to", "is_current", "operation")


@_query(f"{U_ALL} SELECT operation, count(*) AS n FROM u GROUP BY operation")
def derive_operation_counts(s, d):
    return user_history(s, d, writer="interceptor").groupBy("operation").agg(F.count("*").alias("n"))


@_query(f"SELECT c_custkey AS history_id, c_custkey, c_name, c_nationkey, c_mktsegment, TIMESTAMP '{O1}' AS valid_from, NULL::TIMESTAMP AS valid_to, true AS is_current, 1::SMALLINT AS operation FROM customer")
def seed_customer(s, d):
    return _shown_history(customer_history(s, d), CUSTOMER)


_LAGGED = O + """, v AS (SELECT *, lag(history_id) OVER w IS NULL AS first, lag(o_custkey) OVER w AS o_o_custkey, lag(o_orderstatus) OVER w AS o_o_orderstatus,
lag(o_orderpriority) OVER w AS o_o_orderpriority FROM o WHERE operation <> 3 WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from, history_id))"""


@_query(f"{_LAGGED} {_unpivot(ORDER, 'v', 'o_custkey, valid_from')}")
def diff_timeline(s, d):
    return D.diff_timeline(order_history(s, d), ORDER)


@_query(f"{_LAGGED}, x AS ({_unpivot(ORDER, 'v', 'o_custkey, valid_from, first')}) SELECT o_custkey, path, old_value, new_value FROM x WHERE first")
def diff_insert_vs_null(s, d):
    h = order_history(s, d).where("operation = 1")
    return D.diff_timeline(h, ORDER).select("o_custkey", "path", "old_value", "new_value")


@_query(f"{_LAGGED}, x AS ({_unpivot(ORDER, 'v', 'o_custkey, valid_from')}) SELECT path, count(*) AS n FROM x GROUP BY path")
def diff_change_counts(s, d):
    return D.diff_timeline(order_history(s, d), ORDER).groupBy("path").agg(F.count("*").alias("n"))


_PAIR = f"""{O}, a AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM o WHERE {_at(dt.datetime(1997, 1, 1))}),
b AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM o WHERE {_at(O1)}),
v AS (SELECT b.*, a.o_custkey IS NULL AS first, a.o_custkey AS o_o_custkey, a.o_orderstatus AS o_o_orderstatus, a.o_orderpriority AS o_o_orderpriority FROM b LEFT JOIN a USING (o_custkey))"""


@_query(f"{_PAIR} {_unpivot(ORDER, 'v', 'o_custkey')}")
def diff_asof_pair(s, d):
    h = order_history(s, d)
    at = [h.where(P.contains_instant(F.col("valid_from"), F.col("valid_to"), t)) for t in (dt.datetime(1997, 1, 1), O1)]
    return D.diff_between(*at, ORDER)


@_query(f"{U} SELECT history_id, {ENT}, valid_from, {END}, operation FROM u WHERE valid_to > TIMESTAMP '{T1}'")
def retention_pruned_history(s, d):
    return _shown_history(user_history(s, d).where(F.col("valid_to") > P.ntz(T1)), USER)


@_query(f"{U} {_asof(T2)}")
def retention_asof_exact(s, d):
    return R.as_of(user_history(s, d).where(F.col("valid_to") > P.ntz(T1)), USER, T2)


TENANT = TemporalSpec("tenant_state", USER.schema, ("user_id",), filters={"tenant": lambda: F.col("user_id") % 3 == 0, "active": lambda: F.col("event_type") != "view"})


@_query(f"{U} {_asof(T1)} AND user_id % 3 = 0 AND event_type <> 'view'")
def filter_tenant(s, d):
    return R.as_of(user_history(s, d), TENANT, T1)


@_query(f"{U} {_asof(T1)} AND user_id % 3 = 0")
def filter_one_ignored(s, d):
    return R.as_of(user_history(s, d), TENANT, T1, ignore_filters=["active"])


@_query(f"{U} {_asof(T1)}")
def filter_ignored(s, d):
    return R.as_of(user_history(s, d), TENANT, T1, ignore_filters=True)


@_query(f"{U} SELECT user_id, event_type AS kind, value, value IS NULL AS absent FROM u WHERE {_at(T1)}")
def nested_asof(s, d):
    h = user_history(s, d).withColumnsRenamed({"event_type": "event_type", "value": "event_value"})
    e = R.as_of(h, NESTED, T1)
    return e.select("user_id", F.col("event.type").alias("kind"), F.col("event.value").alias("value"), F.col("event").isNull().alias("absent"))


@_query(f"{U} SELECT event_type, count(*) AS n, min(epoch_us(valid_to) - epoch_us(valid_from)) AS min_us, max(epoch_us(valid_to) - epoch_us(valid_from)) AS max_us FROM u WHERE operation <> 3 AND valid_to <> {INF} GROUP BY event_type")
def version_duration_stats(s, d):
    us = P.to_us(F.col("valid_to")) - P.to_us(F.col("valid_from"))
    h = user_history(s, d).where((F.col("operation") != 3) & ~P.is_open(F.col("valid_to")))
    return h.groupBy("event_type").agg(F.count("*").alias("n"), F.min(us).alias("min_us"), F.max(us).alias("max_us"))


@_query(f"{U} SELECT e.event_id, u.history_id, u.event_type AS state FROM events e JOIN u ON e.user_id = u.user_id AND u.operation <> 3 AND e.ts >= u.valid_from AND e.ts < u.valid_to")
def asof_event_join(s, d):
    e, h = _table(s, d, "events").select("event_id", F.col("user_id").alias("uid"), "ts"), user_history(s, d)
    return J.as_of_join(e, h, F.col("uid") == F.col("user_id"), F.col("ts")).select("event_id", "history_id", F.col("event_type").alias("state"))


@_query(f"""{UTU}, k AS (SELECT user_id AS k2, event_type AS t2, valid_from AS f2, valid_to AS e2 FROM x WHERE operation <> 3)
SELECT user_id, event_type, t2, valid_from, f2, greatest(valid_from, f2) AS overlap_from, nullif(least(valid_to, e2), {INF}) AS overlap_to FROM u JOIN k ON user_id = k2 AND event_type <> t2 AND valid_from < e2 AND f2 < valid_to WHERE operation <> 3""")
def overlap_join(s, d):
    """A user's states with the user's states of each other type that were valid at the same time."""
    a = user_history(s, d).where("operation <> 3").select("user_id", "event_type", "valid_from", "valid_to")
    b = user_type_history(s, d).where("operation <> 3").select(F.col("user_id").alias("k2"), F.col("event_type").alias("t2"), F.col("valid_from").alias("f2"), F.col("valid_to").alias("e2"))
    out = J.overlap_join(a, b, (F.col("user_id") == F.col("k2")) & (F.col("event_type") != F.col("t2")), ("valid_from", "valid_to"), ("f2", "e2"))
    return out.select("user_id", "event_type", "t2", "valid_from", "f2", "overlap_from", P.closed_or_null(F.col("overlap_to")).alias("overlap_to"))


@_query(f"{U} {VER} AND event_type = 'signup' UNION ALL {VER} AND event_type = 'purchase'")
def union_versions(s, d):
    v = R.all_versions(user_history(s, d), USER, ordered=False)
    return v.where("event_type = 'signup'").unionByName(v.where("event_type = 'purchase'"))


@_query(f"{U} SELECT * FROM ({_asof(T2)}) EXCEPT ALL ({_asof(T1)})")
def except_snapshots(s, d):
    h = user_history(s, d)
    return R.as_of(h, USER, T2).exceptAll(R.as_of(h, USER, T1))


@_query(f"{U} SELECT * FROM ({_asof(T2)}) INTERSECT ({_asof(T1)})")
def intersect_snapshots(s, d):
    h = user_history(s, d)
    return R.as_of(h, USER, T2).intersect(R.as_of(h, USER, T1))


@_query(f"{U} SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM u WHERE {_at(T1)})")
def asof_anti(s, d):
    return _table(s, d, "events").select("user_id").join(R.as_of(user_history(s, d), USER, T1), "user_id", "left_anti").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from palimpsest import stored_queries

    return Q | stored_queries.Q


def oracle_sql() -> dict[str, str]:
    from palimpsest import stored_queries

    return SQL | stored_queries.SQL
