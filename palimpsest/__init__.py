"""System-versioned (transaction-time) tables on Spark: history derivation, temporal reads, diff and retention."""

from palimpsest.engine import Engine, TemporalTable
from palimpsest.plans.spec import (
    ChangeContext,
    ConflictError,
    HistoricalSnapshotError,
    HistoryHorizonError,
    NotTemporalError,
    RetentionNotEnabledError,
    SchemaEvolutionError,
    TemporalError,
    TemporalModelError,
    TemporalSpec,
    UnsupportedTemporalQuery,
    VersionOperation,
)

__all__ = [
    "ChangeContext",
    "ConflictError",
    "Engine",
    "HistoricalSnapshotError",
    "HistoryHorizonError",
    "NotTemporalError",
    "RetentionNotEnabledError",
    "SchemaEvolutionError",
    "TemporalError",
    "TemporalModelError",
    "TemporalSpec",
    "TemporalTable",
    "UnsupportedTemporalQuery",
    "VersionOperation",
]
