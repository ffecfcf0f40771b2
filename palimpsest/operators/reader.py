"""Temporal reads over a history frame. Each is a filter and a projection, left to Catalyst to push into the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import period as P
from palimpsest.operators.writer import ORIGIN
from palimpsest.plans.spec import CONTEXT_COLUMNS, TemporalSpec, UnsupportedTemporalQuery

#: The partition column of stored histories; a read adds a bound on it so that old partitions are not opened.
BUCKET = "valid_to_month"


def _member(spec: TemporalSpec, struct: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
    out = []
    for f in struct.fields:
        at = (*prefix, f.name)
        if not prefix and f.name in spec.exclude:
            continue
        if not isinstance(f.dataType, T.StructType):
            out.append(F.col("_".join(at)).alias(f.name))
            continue
        leaves = [x for x in spec.leaves if x.path.startswith(".".join(at) + ".")]
        if required := spec.required.get(".".join(at)):
            absent = F.col("_".join((*at, required))).isNull()
        else:
            absent = F.lit(True)
            for x in leaves:
                absent &= F.col(x.column).isNull()
        whole = F.struct(*_member(spec, f.dataType, at))
        out.append((F.when(~absent, whole) if f.nullable else whole).alias(f.name))
    return out


def entity_columns(spec: TemporalSpec) -> list[Column]:
    """The entity with its nested members rebuilt; key columns carry the mark of history."""
    marked = {k: F.col(k).alias(k, metadata={ORIGIN: spec.name}) for k in spec.key}
    names = [f.name for f in spec.schema.fields if f.name not in spec.exclude]
    return [marked.get(n, c) for n, c in zip(names, _member(spec, spec.schema, ()), strict=True)]


def apply_filters(history: DataFrame, spec: TemporalSpec, ignore: bool | Collection[str] = False) -> DataFrame:
    """The entity's filters on the historical values. One over a column that history does not hold makes every historical
    read fail, even one that ignores filters: its result could not be trusted. Which columns a predicate reads is found by analysing
    it over the versioned ones; filter_columns may state more."""
    # A frame of its own: under a projection Spark would still find the columns that it leaves out.
    held = history.sparkSession.createDataFrame([], history.select(*spec.columns).schema) if spec.filters else history
    for name, columns in spec.filter_columns.items():
        if lost := [c for c in columns if c not in spec.columns]:
            raise UnsupportedTemporalQuery(f"{spec.name}: filter {name!r} reads {', '.join(lost)}, which history does not hold")
    for name, predicate in spec.filters.items():
        try:
            held.where(predicate()).schema  # noqa: B018  analysis alone
        except AnalysisException as e:
            raise UnsupportedTemporalQuery(f"{spec.name}: filter {name!r} reads what history does not hold: {e.getCondition() or e}") from e
        if ignore is not True and name not in (ignore or ()):
            history = history.where(predicate())
    return history


def _month(t: dt.datetime) -> str:
    return f"{t.year:04d}-{t.month:02d}"


def _ended_after(history: DataFrame, t: dt.datetime) -> DataFrame:
    return history.where(F.col(BUCKET) >= _month(t)) if BUCKET in history.columns else history


def _ended_by(history: DataFrame, t: dt.datetime) -> DataFrame:
    return history.where(F.col(BUCKET) <= _month(t)) if BUCKET in history.columns else history


def _shown(spec: TemporalSpec) -> list[Column]:
    vf, vt = (F.col(p) for p in spec.period)
    return [vf, P.closed_or_null(vt).alias(spec.period[1]), P.is_open(vt).alias("is_current")]


def as_of(history: DataFrame, spec: TemporalSpec, t: dt.datetime, *, ignore_filters: bool | Collection[str] = False) -> DataFrame:
    """Entities as they were at t. A boundary belongs to the version that starts there; tombstones are empty and never match."""
    t = P.instant(t)
    h = _ended_after(apply_filters(history, spec, ignore_filters), t)
    return h.where(P.contains_instant(F.col(spec.period[0]), F.col(spec.period[1]), t)).select(*entity_columns(spec))


def current(history: DataFrame, spec: TemporalSpec, *, ignore_filters: bool | Collection[str] = False) -> DataFrame:
    h = apply_filters(history, spec, ignore_filters)
    h = h.where(F.col(BUCKET) == "9999-12") if BUCKET in h.columns else h
    return h.where(P.is_open(F.col(spec.period[1]))).select(*entity_columns(spec))


def versions(history: DataFrame, spec: TemporalSpec, *, where: Column | None = None, ignore_filters: bool | Collection[str] = False, ordered: bool = True) -> DataFrame:
    """Versions without tombstones, newest first, with their period."""
    h = apply_filters(history, spec, ignore_filters).where(F.col("operation") != 3)
    h = h if where is None else h.where(where)
    h = h.orderBy(F.col(spec.period[0]).desc()) if ordered else h
    return h.select(*entity_columns(spec), *_shown(spec))


def all_versions(history: DataFrame, spec: TemporalSpec, **how) -> DataFrame:
    return versions(history, spec, **how)


def from_to(history: DataFrame, spec: TemporalSpec, start: dt.datetime, end: dt.datetime, **how) -> DataFrame:
    """Versions whose period overlaps [start, end)."""
    a, b = P.window(start, end)
    return versions(_ended_after(history, a), spec, where=P.overlaps(F.col(spec.period[0]), F.col(spec.period[1]), a, b), **how)


def contained_in(history: DataFrame, spec: TemporalSpec, start: dt.datetime, end: dt.datetime, **how) -> DataFrame:
    """Versions whose whole period lies in [start, end); an end of datetime.max takes open versions too."""
    a, b = P.window(start, end)
    return versions(_ended_by(_ended_after(history, a), b), spec, where=P.within(F.col(spec.period[0]), F.col(spec.period[1]), a, b), **how)


def history_rows(history: DataFrame, spec: TemporalSpec, *, ignore_filters: bool | Collection[str] = False, ordered: bool = True) -> DataFrame:
    """Every row, tombstones included, newest first: the entity as a struct beside the metadata."""
    h = apply_filters(history, spec, ignore_filters)
    h = h.orderBy(F.col(spec.period[0]).desc(), F.col("history_id").desc()) if ordered else h
    user = ["db_session_user"] if spec.session_user else []
    return h.select("history_id", F.struct(*entity_columns(spec)).alias("entity"), *_shown(spec), "operation", *CONTEXT_COLUMNS, *user)


def latest_per_key(history: DataFrame, spec: TemporalSpec) -> DataFrame:
    """The newest row of each key, its tombstone if it was deleted: one aggregation, combined on the map side."""
    rest: Sequence[str] = [c for c in history.columns if c not in spec.key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(spec.period[0]), F.col("history_id"))).alias("r")
    return history.groupBy(*spec.key).agg(best).select(*spec.key, "r.*")


def single(rows: DataFrame) -> DataFrame:
    """rows if there is exactly one, checked by a look at two."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"exactly one row was expected, not {'none' if not found else 'several'}")
    return rows
