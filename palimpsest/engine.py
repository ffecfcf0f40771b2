"""The engine: a catalog of temporal tables under one root, their writes, reads, diffs and retention."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Callable, Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import period as P
from palimpsest.operators import diff as D
from palimpsest.operators import reader as R
from palimpsest.operators import writer as Wr
from palimpsest.plans.evolution import evolve, orphan_fields, snapshot
from palimpsest.plans.spec import (
    CONTEXT_COLUMNS,
    ChangeContext,
    ConflictError,
    HistoryHorizonError,
    NotTemporalError,
    RetentionNotEnabledError,
    TemporalError,
    TemporalSpec,
)
from palimpsest.sources.store import HistoryStore


class Engine:
    """root: a folder that driver and executors share. writer: how no-op updates and empty contexts are read (see
    operators.writer). change_context: called once for each apply; what it raises aborts the apply. compact_after: directories of closed
    versions that a table may have before a commit merges them; a read is a union of them."""

    def __init__(self, spark: SparkSession, root: str, *, writer: str = "trigger", change_context: Callable[[], ChangeContext] | None = None, clock: Callable[[], dt.datetime] | None = None, compact_after: int = 32):
        self.spark, self.root, self.writer, self.change_context, self.compact_after = spark, root.rstrip("/"), writer, change_context, compact_after
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self._reasons: list[str] = []
        self._tables: dict[str, TemporalTable] = {}

    @contextlib.contextmanager
    def reason(self, text: str) -> Iterator[None]:
        """The reason of the applies inside; the innermost scope wins over outer ones and over the provider."""
        self._reasons.append(text)
        try:
            yield
        finally:
            self._reasons.pop()

    def context(self) -> ChangeContext | None:
        given = self.change_context() if self.change_context else None
        if self._reasons:
            given = given or ChangeContext()
            given = ChangeContext(given.changed_by, given.changed_by_name, given.correlation_id, self._reasons[-1], given.extra)
        return given

    def _store(self, spec: TemporalSpec) -> HistoryStore:
        return HistoryStore(self.spark, f"{self.root}/{spec.identity.replace('#', '__')}")

    def table(self, spec: TemporalSpec) -> TemporalTable:
        """Creates the table, or opens it and evolves its schema. An entity taken up again finds its old history."""
        store = self._store(spec)
        base = store.manifest()
        if base is None:
            store.commit(None, schema=snapshot(spec), orphaned=False)
        elif (new := evolve(base["schema"], spec)) != base["schema"] or base.get("orphaned"):
            store.commit(base, schema=new, orphaned=False)
        self._tables[spec.name] = t = TemporalTable(self, spec, store)
        return t

    def __getitem__(self, name: str) -> TemporalTable:
        if name not in self._tables:
            raise NotTemporalError(f"{name} is not a temporal entity")
        return self._tables[name]

    def rename(self, name: str, spec: TemporalSpec) -> TemporalTable:
        """Goes on under another name with the history of `name`, which stays where it is: identities, not names, name the files."""
        old = self[name]
        if spec.identity != old.spec.identity:
            raise TemporalError(f"declare {spec.name} with entity_id={old.spec.identity!r} to keep the history of {name}")
        del self._tables[name]
        return self.table(spec)

    def remove(self, name: str) -> None:
        """Stops versioning; the recorded history stays on disk and cannot be queried until the entity returns."""
        t = self[name]
        t.store.commit(t.store.manifest(), orphaned=True)
        del self._tables[name]


class TemporalTable:
    """One entity. Reads return frames over the newest commit at the time of the call."""

    def __init__(self, engine: Engine, spec: TemporalSpec, store: HistoryStore):
        self.engine, self.spec, self.store = engine, spec, store

    # ---- storage

    def _schema(self, base: dict) -> T.StructType:
        return T.StructType([*self.spec.history_schema().fields, *orphan_fields(base["schema"])])

    def _rows(self, base: dict, *parts: str) -> DataFrame:
        if base.get("orphaned"):
            raise NotTemporalError(f"{self.spec.name} is no longer temporal")
        return self.store.read({p: base[p] for p in parts or ("open", "closed")}, self._schema(base))

    def frame(self) -> DataFrame:
        """The history as stored, with the sentinel end, the partition bucket and columns that the entity lost."""
        return self._rows(self.store.manifest())

    # ---- writes

    def seed(self, rows: DataFrame, at: dt.datetime | None = None, *, history_id=None) -> None:
        """Takes up rows that exist already; once, before any change."""
        base = self.store.manifest()
        if base["open"] or base["closed"]:
            raise TemporalError(f"{self.spec.name} has a history already")
        out = Wr.seed(rows, self.spec, at or self.engine.clock(), history_id=history_id)
        name = self.store.write(out, "data", list(self.spec.key), self.spec.period[1])
        top = self.store.read({"open": [name]}, self.spec.history_schema()).agg(F.max("history_id")).first()[0]
        self.store.commit(base, open=[name], sequence=max(base["sequence"], (-1 if top is None else top) + 1))

    def apply_changes(self, changes: DataFrame, *, order: Sequence[str] = ("seq",), ts: str = "commit_ts", op: str = "op", batch_id: str | None = None, stream: tuple[str, int] | None = None, dangling_deletes: str = "error", duplicate_inserts: str = "error", attempts: int = 10) -> dict:
        """Commits a batch of changes: open versions of the touched keys are closed or replaced, the others carried over.

        batch_id: a batch that was committed before is skipped, so a retry is harmless; stream: (id, number) of a batch of a stream,
        skipped if that stream has come as far. Context columns missing from the changes come from the engine's provider and
        reason, called once. History ids go on from the last one, in the order of the last column of order. A delete of a row that is
        not there and an insert of one that is are errors, unless "drop" and "update" say otherwise. If another writer commits
        meanwhile, the batch is derived again over what it left, `attempts` times at most.
        """
        Wr.reject_historical(changes)
        given = self.engine.context()
        for c in CONTEXT_COLUMNS:
            if given is not None and c not in changes.columns:
                changes = changes.withColumn(c, F.lit(getattr(given, c)).cast("string"))
        if ts not in changes.columns:
            changes = changes.withColumn(ts, P.ntz(P.instant(self.engine.clock())))
        number = F.col(order[-1]).cast("bigint")
        low, high = changes.agg(F.min(number), F.max(number)).first()
        for left in reversed(range(attempts)):
            base = self.store.manifest()
            if batch_id is not None and batch_id in base["batches"]:
                return base
            if stream is not None and base.get("streams", {}).get(stream[0], -1) >= stream[1]:
                return base
            try:
                return self._apply(base, changes, number, low, high, order, ts, op, batch_id, stream, dangling_deletes, duplicate_inserts)
            except ConflictError:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def _apply(self, base, changes, number, low, high, order, ts, op, batch_id, stream, dangling_deletes, duplicate_inserts) -> dict:
        spec, keys = self.spec, list(self.spec.key)
        first = base["sequence"]
        changes = changes.withColumn("__hid", F.lit(first - (low or 0)).cast("bigint") + number)
        live = self._rows(base, "open")
        touched = changes.select(*keys).distinct()
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        mine = live.alias("o").join(touched.alias("t"), same, "left_semi")
        rest = live.alias("o").join(touched.alias("t"), same, "left_anti")
        derived = Wr.derive_history(changes, spec, order=order, ts=ts, op=op, history_id="__hid", writer=self.engine.writer, open_versions=mine, dangling_deletes=dangling_deletes, duplicate_inserts=duplicate_inserts)
        orphans = [f.name for f in orphan_fields(base["schema"])]
        if orphans:
            lost = mine.select("history_id", *orphans)
            derived = derived.join(lost, "history_id", "left")
        try:  # one derivation, one write: the month tells closed rows from open ones
            name = self.store.write(derived.unionByName(rest.drop(R.BUCKET), allowMissingColumns=True), "data", keys, spec.period[1])
        except (PySparkException, Py4JJavaError) as e:
            if Wr.VIOLATION in str(e):
                raise TemporalError(str(e).partition(Wr.VIOLATION)[2].splitlines()[0].strip()) from None
            raise
        streams = {**base.get("streams", {}), **({stream[0]: stream[1]} if stream else {})}
        batches = [*base["batches"], *([batch_id] if batch_id is not None else [])]
        out = self.store.commit(base, open=[name], closed=[*base["closed"], name], sequence=first + (0 if high is None else high - low + 1), batches=batches, streams=streams)
        if len(out["closed"]) > self.engine.compact_after:
            with contextlib.suppress(ConflictError):  # another commit went before; the next one compacts
                out = self.compact()
        return out

    def compact(self) -> dict:
        """Merges the directories of closed versions into one."""
        base = self.store.manifest()
        name = self.store.write(self._rows(base, "closed"), "closed", list(self.spec.key), self.spec.period[1])
        return self.store.commit(base, closed=[name])

    # ---- reads

    def _guarded(self, t: dt.datetime) -> DataFrame:
        """The history of one manifest, which also has the horizon that t is held against: a prune meanwhile cannot come between.
        Raised before a plan is built: a check inside the plan would not run where no row reaches it."""
        base = self.store.manifest()
        h = self._horizon(base)
        if h is not None and t < h:
            raise HistoryHorizonError(self.spec.name, t, h)
        return self._rows(base)

    def as_of(self, t: dt.datetime, *, ignore_filters=False) -> DataFrame:
        return R.as_of(self._guarded(P.instant(t)), self.spec, t, ignore_filters=ignore_filters)

    def from_to(self, start: dt.datetime, end: dt.datetime, **how) -> DataFrame:
        return R.from_to(self._guarded(P.window(start, end)[0]), self.spec, start, end, **how)

    def contained_in(self, start: dt.datetime, end: dt.datetime, **how) -> DataFrame:
        return R.contained_in(self._guarded(P.window(start, end)[0]), self.spec, start, end, **how)

    def all_versions(self, **how) -> DataFrame:
        return R.all_versions(self.frame(), self.spec, **how)

    def history(self, **how) -> DataFrame:
        return R.history_rows(self.frame(), self.spec, **how)

    def current(self, *, ignore_filters=False) -> DataFrame:
        return R.current(self.frame(), self.spec, ignore_filters=ignore_filters)

    # ---- diffs

    def diff_timeline(self) -> DataFrame:
        return D.diff_timeline(self.frame(), self.spec)

    def diff_between(self, older: dt.datetime, newer: dt.datetime) -> DataFrame:
        if not P.instant(older) < P.instant(newer):
            raise ValueError("the first instant is not before the second")
        rows = self._guarded(P.instant(older))
        at = [R.apply_filters(rows, self.spec).where(P.contains_instant(*(F.col(p) for p in self.spec.period), P.instant(t))) for t in (older, newer)]
        return D.diff_between(*at, self.spec)

    def diff(self, older: dict | None, newer: dict) -> list[tuple[str, object, object]]:
        return D.diff_pair(older, newer, self.spec)

    # ---- retention

    @staticmethod
    def _horizon(base: dict | None) -> dt.datetime | None:
        h = (base or {}).get("horizon")
        return dt.datetime.fromisoformat(h) if h else None

    def horizon(self) -> dt.datetime | None:
        return self._horizon(self.store.manifest())

    def prune(self, older_than: dt.datetime, batch_size: int = 10_000) -> int:
        """Forgets versions and tombstones that ended by older_than; returns their number.

        The horizon is recorded first and only moves forward, so a read that pruning could falsify fails from then on.
        batch_size is checked and otherwise without effect: partitions of Spark are the batches.
        """
        if not self.spec.retention:
            raise RetentionNotEnabledError(f"{self.spec.name} was declared without retention")
        cutoff = P.instant(older_than, "older_than")
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        if cutoff >= dt.datetime.max or cutoff > self.engine.clock():
            raise ValueError(f"the cutoff {cutoff} lies in the future")
        old = self.horizon()
        base = self.store.manifest()
        base = self.store.commit(base, horizon=(cutoff if old is None else max(old, cutoff)).isoformat(sep=" "))
        rows, vt = self._rows(base, "closed"), F.col(self.spec.period[1])
        gone = rows.where((vt <= P.ntz(cutoff)) & (F.col(R.BUCKET) <= R._month(cutoff))).count()
        if gone:
            # Only the month of the cutoff is rewritten; earlier ones are hidden by name until vacuum() deletes them.
            edge = R._month(cutoff)
            kept = self.store.write(rows.where((F.col(R.BUCKET) == edge) & (vt > P.ntz(cutoff))), "closed", list(self.spec.key), self.spec.period[1])
            left = [f"{n.partition('@')[0]}@{max(edge, n.partition('@')[2])}" for n in base["closed"]]
            self.store.commit(base, closed=[*left, kept])
        return gone
