"""The declaration of a temporal entity, its validation, and the errors of the engine."""

from __future__ import annotations

import enum
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

CONTEXT_COLUMNS = ("changed_by", "changed_by_name", "correlation_id", "reason", "extra")
METADATA_COLUMNS = ("history_id", "operation", *CONTEXT_COLUMNS, "db_session_user")


class TemporalError(Exception):
    """Base of every error that this engine raises itself."""


class ConflictError(TemporalError):
    """Another writer committed first; nothing was changed, and the write can be repeated."""


class NotTemporalError(TemporalError):
    """The entity has no history."""


class TemporalModelError(TemporalError):
    """The declaration of a temporal entity is invalid."""


class SchemaEvolutionError(TemporalModelError):
    """A schema change would destroy or reinterpret recorded history."""


class UnsupportedTemporalQuery(TemporalError):
    """A query over history that could return a silently wrong result."""


class HistoricalSnapshotError(TemporalError):
    """Rows read from history were handed back as changes."""


class RetentionNotEnabledError(TemporalError):
    """The entity was declared without retention."""


class HistoryHorizonError(TemporalError):
    """A read reaches before the retention horizon."""

    code = "HS001"

    def __init__(self, entity: str, instant, horizon):
        super().__init__(f"{self.code}: history of {entity} before {horizon} was pruned; {instant} cannot be answered")


class VersionOperation(enum.IntEnum):
    INSERT = 1
    UPDATE = 2
    DELETE = 3


@dataclass(frozen=True)
class ChangeContext:
    """Who changed a row, and why; each part may be missing."""

    changed_by: str | None = None
    changed_by_name: str | None = None
    correlation_id: str | None = None
    reason: str | None = None
    extra: str | None = None


@dataclass(frozen=True)
class Leaf:
    """A versioned column: its dotted path in the entity and its flat name in the history."""

    path: str
    column: str
    type: T.DataType


def _leaves(struct: T.StructType, prefix: tuple[str, ...], entity: str) -> list[Leaf]:
    found: list[Leaf] = []
    for f in struct.fields:
        at = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            found += _leaves(f.dataType, at, entity)
            continue
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, (T.MapType, T.StructType, T.ArrayType, T.VariantType)):
            raise UnsupportedTemporalQuery(f"{entity}.{'.'.join(at)}: {f.dataType.simpleString()} cannot be versioned")
        found.append(Leaf(".".join(at), "_".join(at), f.dataType))
    return found


@dataclass(frozen=True)
class TemporalSpec:
    """A temporal entity.

    schema: the entity; struct fields are nested members, stored flat as parent_child. required: for an optional nested
    member the child whose null marks it absent (else it is absent when all its columns are null). filters: named
    predicates that each historical read applies to the historical values, evaluated when the read is built.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    period: tuple[str, str] = ("valid_from", "valid_to")
    history_table: str | None = None
    retention: bool = False
    session_user: bool = False
    required: Mapping[str, str] = field(default_factory=dict)
    filters: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    filter_columns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    json_columns: tuple[str, ...] = ()
    entity_id: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "key", tuple(self.key))
        object.__setattr__(self, "exclude", tuple(self.exclude))
        self.validate()

    @property
    def identity(self) -> str:
        """Stable over renames of the table."""
        return self.entity_id or f"{self.name}#History"

    @property
    def table(self) -> str:
        return self.history_table or f"{self.name}_history"

    @property
    def leaves(self) -> list[Leaf]:
        """Versioned columns: own ones first, then those of nested members; each column once."""
        found = _leaves(T.StructType([f for f in self.schema.fields if f.name not in self.exclude]), (), self.name)
        return [x for x in found if "." not in x.path] + [x for x in found if "." in x.path]

    @property
    def columns(self) -> list[str]:
        return [x.column for x in self.leaves]

    def diff_order(self) -> list[Leaf]:
        """The key, then own columns, then nested ones."""
        own = self.leaves
        return [x for x in own if x.column in self.key] + [x for x in own if x.column not in self.key]

    def validate(self) -> None:
        names = [f.name for f in self.schema.fields]
        if not self.key:
            raise TemporalModelError(f"{self.name}: a temporal entity needs a key")
        if missing := [k for k in (*self.key, *self.exclude) if k not in names]:
            raise TemporalModelError(f"{self.name}: no such column: {', '.join(missing)}")
        if kept := [k for k in self.key if k in self.exclude]:
            raise TemporalModelError(f"{self.name}: key columns cannot be excluded: {', '.join(kept)}")
        if self.period[0] == self.period[1]:
            raise TemporalModelError(f"{self.name}: both period columns are called {self.period[0]}")
        flat = self.columns
        if twice := sorted({c for c in flat if flat.count(c) > 1}):
            raise TemporalModelError(f"{self.name}: nested members collide on {', '.join(twice)}")
        if taken := sorted({*flat} & {*self.period, *METADATA_COLUMNS}):
            raise TemporalModelError(f"{self.name}: reserved column names: {', '.join(taken)}")
        if taken := sorted({*self.period} & {*METADATA_COLUMNS}):
            raise TemporalModelError(f"{self.name}: reserved period names: {', '.join(taken)}")

    def history_schema(self) -> T.StructType:
        """Versioned columns are nullable whatever the entity says; constraints are not mirrored."""
        out = [T.StructField("history_id", T.LongType(), False)]
        out += [T.StructField(x.column, x.type, True) for x in self.leaves]
        out += [T.StructField(p, T.TimestampNTZType(), False) for p in self.period]
        out.append(T.StructField("operation", T.ShortType(), False))
        out += [T.StructField(c, T.StringType(), True) for c in CONTEXT_COLUMNS]
        if self.session_user:
            out.append(T.StructField("db_session_user", T.StringType(), False))
        return T.StructType(out)
