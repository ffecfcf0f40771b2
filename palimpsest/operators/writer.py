"""From an ordered stream of row changes to versions, with windows only.

Inside one life (insert to delete) the versions start at v1 = ts1, vi = max(tsi, v(i-1) + 1 us): a clock that stands still or
steps back cannot produce an empty or reversed period. Unrolled this is vi = i + max over j <= i of (tsj - j), a prefix
maximum. Every window is partitioned by the key, so one exchange serves all of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.period import SENTINEL, SENTINEL_US, from_us, instant, ntz, to_us
from palimpsest.plans.spec import CONTEXT_COLUMNS, HistoricalSnapshotError, TemporalError, TemporalSpec

#: Closes the open version and leaves no tombstone: the old key of a change of keys.
CLOSE = 0
#: How the text of an error begins that a job raises over the changes themselves.
VIOLATION = "[PALIMPSEST_VIOLATION] "
#: Metadata key that marks key columns of rows read from history.
ORIGIN = "palimpsest.history"


def flat(df: DataFrame, spec: TemporalSpec) -> list[Column]:
    """The versioned columns of entity rows under their flat names; those that are flat already are taken as they are."""
    return [F.col(f"`{x.column}`" if x.column in df.columns else x.path).cast(x.type).alias(x.column) for x in spec.leaves]


def reject_historical(df: DataFrame) -> None:
    """Rows that a historical read returned are not changes. Computed columns lose the mark, as copied values should."""
    if marked := [f.name for f in df.schema.fields if (f.metadata or {}).get(ORIGIN)]:
        raise HistoricalSnapshotError(f"these rows were read from history ({', '.join(marked)}); copy values into new rows")


def with_operations(changes: DataFrame, key: Sequence[str], order: Sequence[str], delete: Column) -> DataFrame:
    """Adds op to rows that only say which of them delete: the first of a life inserts, later ones update."""
    w = W.partitionBy(*key).orderBy(*order)
    d = changes.withColumn("__del", F.coalesce(delete, F.lit(False))).withColumn("__prev", F.lag("__del").over(w))
    op = F.when(F.col("__del"), 3).when(F.coalesce("__prev", F.lit(True)), 1).otherwise(2).cast("smallint")
    return d.withColumn("op", op).drop("__del", "__prev")


def expand_key_changes(changes: DataFrame, spec: TemporalSpec, old: str = "old_") -> DataFrame:
    """Splits updates that change the key (old_<key> not null and different) into the close of the old key's chain and an
    update that opens a version under the new key."""
    moved = F.lit(False)
    for k in spec.key:
        moved |= F.col(old + k).isNotNull() & ~F.col(old + k).eqNullSafe(F.col(k))
    moved &= F.col("op") == 2
    closes = changes.where(moved).withColumns({k: F.coalesce(old + k, k) for k in spec.key}).withColumn("op", F.lit(CLOSE).cast("smallint"))
    return changes.unionByName(closes).drop(*[old + k for k in spec.key])


def _same(spec: TemporalSpec, now: str, before: str) -> Column:
    """Whether two states agree on every versioned column; JSON text is compared by content."""
    out = F.lit(True)
    for c in spec.columns:
        a, b = F.col(f"{now}.{c}"), F.col(f"{before}.{c}")
        if c in spec.json_columns:
            a, b = (F.to_json(F.try_parse_json(x)) for x in (a, b))
        out &= a.eqNullSafe(b)
    return out


def derive_history(
    changes: DataFrame,
    spec: TemporalSpec,
    *,
    order: Sequence[str] = ("seq",),
    ts: str = "commit_ts",
    op: str = "op",
    history_id: str | None = None,
    writer: str = "trigger",
    open_versions: DataFrame | None = None,
    dangling_deletes: str = "drop",
    duplicate_inserts: str = "update",
    session_user: str | None = None,
) -> DataFrame:
    """The history of changes: one row for each insert and update, a tombstone with the last values for each delete.

    order: arrival order of a key's changes, which need not be that of ts. writer: "trigger" records no version for an
    update that leaves every versioned column as it was and reads an empty context string as null; "interceptor" records
    such updates when a versioned column was written (changes may carry a boolean __touched; null counts as true).
    open_versions: open rows of an existing history for the keys in changes; they take part as first rows of their keys
    and come back closed or still open. dangling_deletes: "drop" or "error", for a delete of a row that isn't there;
    duplicate_inserts: "update" or "error", for an insert of a key that is live. Such an error is raised by the job that computes
    the history, without a pass of its own; its text begins with VIOLATION.
    An empty frame gives an empty history; null keys form a key of their own.
    """
    if writer not in ("trigger", "interceptor"):
        raise ValueError("writer is 'trigger' or 'interceptor'")
    reject_historical(changes)
    context = [F.col(c).cast("string").alias(c) if c in changes.columns else F.lit(None).cast("string").alias(c) for c in CONTEXT_COLUMNS]
    if writer == "trigger":
        context = [F.nullif(c, F.lit("")).alias(n) for c, n in zip(context, CONTEXT_COLUMNS, strict=True)]
    user = F.lit(session_user).cast("string") if session_user else F.current_user()
    touched = F.coalesce(F.col("__touched"), F.lit(True)) if "__touched" in changes.columns else F.lit(True)
    rows = changes.select(
        F.struct(*flat(changes, spec)).alias("v"),
        F.struct(F.lit(1).alias("late"), *[F.col(o) for o in order]).alias("at"),
        to_us(F.col(ts), changes.schema[ts].dataType).alias("us"),
        F.col(op).cast("smallint").alias("op"),
        F.col(history_id or order[-1]).cast("bigint").alias("history_id"),
        F.struct(*context).alias("ctx"),
        user.alias("db_session_user"),
        touched.alias("touched"),
    )
    if open_versions is not None:
        o = open_versions
        first = F.struct(F.lit(0).alias("late"), *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in order])
        kept_user = F.col("db_session_user") if "db_session_user" in o.columns else F.lit("")
        rows = rows.unionByName(
            o.select(
                F.struct(*[F.col(c) for c in spec.columns]).alias("v"),
                first.alias("at"),
                to_us(F.col(spec.period[0])).alias("us"),
                F.col("operation").alias("op"),
                F.col("history_id"),
                F.struct(*[F.col(c) for c in CONTEXT_COLUMNS]).alias("ctx"),
                kept_user.alias("db_session_user"),
                F.lit(True).alias("touched"),
            )
        )
    rows = rows.select("*", *[F.col(f"v.{k}").alias(f"__k{i}") for i, k in enumerate(spec.key)])
    keys = [f"__k{i}" for i in range(len(spec.key))]
    by_key = W.partitionBy(*keys).orderBy("at")
    ends = (3, CLOSE)
    rows = rows.select("*", F.lag("op").over(by_key).alias("prev"), F.lag("v").over(by_key).alias("last"))
    live = F.col("prev").isNotNull() & ~F.col("prev").isin(*ends)
    again = (F.col("op") == 1) & live & (F.col("at.late") == 1)
    wrong = []
    if dangling_deletes == "error":
        wrong.append(((F.col("op") == 3) & ~live, f"{VIOLATION}{spec.name}: a delete has no live row to snapshot"))
    if duplicate_inserts == "error":
        wrong.append((again, f"{VIOLATION}{spec.name}: an insert of a key that is live"))
    if wrong:
        fine = F.lit(True)
        for bad, text in wrong:
            fine = F.when(bad, F.raise_error(F.lit(text)).cast("boolean")).otherwise(fine)
        rows = rows.where(fine)
    rows = rows.withColumn("op", F.when(again, F.lit(2).cast("smallint")).otherwise(F.col("op")))
    rows = rows.where(live | ~F.col("op").isin(*ends))
    unchanged = (F.col("op") == 2) & live & (F.col("at.late") == 1)
    unchanged &= _same(spec, "v", "last") if writer == "trigger" else ~F.col("touched")
    rows = rows.where(~F.coalesce(unchanged, F.lit(False)))
    born = (F.col("op") == 1) | (F.col("at.late") == 0) | F.coalesce(F.lag("op").over(by_key).isin(*ends), F.lit(True))
    rows = rows.withColumn("life", F.sum(born.cast("int")).over(by_key.rowsBetween(W.unboundedPreceding, 0)))
    by_life = W.partitionBy(*keys, "life").orderBy("at")
    rows = rows.withColumn("rn", F.row_number().over(by_life))
    rows = rows.withColumn("vf", F.max(F.col("us") - F.col("rn")).over(by_life.rowsBetween(W.unboundedPreceding, 0)) + F.col("rn"))
    end = F.when(F.col("op") == 3, F.col("vf")).otherwise(F.coalesce(F.lead("vf").over(by_life), F.lit(SENTINEL_US)))
    rows = rows.withColumn("vt", end).where(F.col("op") != CLOSE)
    out = [F.col("history_id")]
    out += [F.when(F.col("op") == 3, F.col(f"last.{c}")).otherwise(F.col(f"v.{c}")).alias(c) for c in spec.columns]
    out += [from_us(F.col("vf")).alias(spec.period[0]), from_us(F.col("vt")).alias(spec.period[1]), F.col("op").alias("operation")]
    out += [F.col(f"ctx.{c}").alias(c) for c in CONTEXT_COLUMNS]
    return rows.select(*out, *(["db_session_user"] if spec.session_user else []))


def seed(rows: DataFrame, spec: TemporalSpec, at: dt.datetime, *, history_id: Column | None = None, session_user: str | None = None) -> DataFrame:
    """The history of rows that exist when their table becomes temporal: one open insert each, without a context."""
    reject_historical(rows)
    hid = (F.monotonically_increasing_id() if history_id is None else history_id).cast("bigint")
    out = rows.select(
        hid.alias("history_id"),
        *flat(rows, spec),
        ntz(instant(at)).alias(spec.period[0]),
        ntz(SENTINEL).alias(spec.period[1]),
        F.lit(1).cast("smallint").alias("operation"),
        *[F.lit(None).cast("string").alias(c) for c in CONTEXT_COLUMNS],
    )
    user = F.lit(session_user).cast("string") if session_user else F.current_user()
    return out.withColumn("db_session_user", user) if spec.session_user else out
