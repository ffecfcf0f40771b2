"""What changed between versions, one row for each changed leaf."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.plans.spec import TemporalSpec


def _text(c: Column, kind: T.DataType) -> Column:
    """A leaf as text: values of all types share the columns old_value and new_value."""
    if isinstance(kind, T.ArrayType):
        return F.to_json(c)
    return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _plain(c: Column, is_json: bool) -> Column:
    """What is compared: JSON by its content, as the derivation does."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c) if is_json else c


def _unpivot(df: DataFrame, spec: TemporalSpec, old: str, new: str, first: Column, keep: list[str]) -> DataFrame:
    """Rows of changed leaves; where first holds there is nothing older and every leaf is listed, null or not."""
    leaves = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(x.path).alias("path"),
            _text(F.col(f"{old}.{x.column}"), x.type).alias("old_value"),
            _text(F.col(f"{new}.{x.column}"), x.type).alias("new_value"),
            (first | ~_plain(F.col(f"{old}.{x.column}"), x.column in spec.json_columns).eqNullSafe(_plain(F.col(f"{new}.{x.column}"), x.column in spec.json_columns))).alias("changed"),
        )
        for i, x in enumerate(spec.diff_order())
    ]
    out = df.select(*keep, F.explode(F.array(*leaves)).alias("leaf")).where("leaf.changed")
    return out.select(*keep, "leaf.ordinal", "leaf.path", "leaf.old_value", "leaf.new_value")


def diff_timeline(history: DataFrame, spec: TemporalSpec) -> DataFrame:
    """Each version against its predecessor. Tombstones change nothing and are stepped over, so a row inserted again is
    compared with what it was before the delete. Columns: key, valid_from, ordinal, path, old_value, new_value."""
    vf = spec.period[0]
    w = W.partitionBy(*spec.key).orderBy(vf, "history_id")
    state = F.struct(*spec.columns)
    h = history.where(F.col("operation") != 3).select(*[F.col(k).alias(f"__{k}") for k in spec.key], vf, state.alias("n"), F.lag(state).over(w).alias("o"))
    out = _unpivot(h, spec, "o", "n", F.col("o").isNull(), [f"__{k}" for k in spec.key] + [vf])
    return out.withColumnsRenamed({f"__{k}": k for k in spec.key})


def diff_between(older: DataFrame, newer: DataFrame, spec: TemporalSpec) -> DataFrame:
    """Entities (flat columns) that are in both snapshots or only in newer: the latter list every leaf with a null old value.
    Columns: key, ordinal, path, old_value, new_value."""
    o = older.select(*[F.col(k).alias(f"__{k}") for k in spec.key], F.struct(*spec.columns).alias("o"))
    n = newer.select(*[F.col(k).alias(f"__{k}") for k in spec.key], F.struct(*spec.columns).alias("n"))
    out = _unpivot(n.join(o, [f"__{k}" for k in spec.key], "left"), spec, "o", "n", F.col("o").isNull(), [f"__{k}" for k in spec.key])
    return out.withColumnsRenamed({f"__{k}": k for k in spec.key})


def diff_pair(older: dict | None, newer: dict, spec: TemporalSpec) -> list[tuple[str, object, object]]:
    """Two versions as mappings of flat columns: (path, old, new) of each changed leaf. With the period and the operation
    present, both must be versions of one key in order, and neither a tombstone."""
    vf = spec.period[0]
    if newer.get("operation") == 3 or (older or {}).get("operation") == 3:
        raise ValueError("a tombstone is not a version")
    if older is not None:
        if any(older[k] != newer[k] for k in spec.key):
            raise ValueError("versions of different keys")
        if vf in older and vf in newer and not older[vf] < newer[vf]:
            raise ValueError("the first version is not older than the second")
    leaves = spec.diff_order()
    if older is None:
        return [(x.path, None, newer[x.column]) for x in leaves]

    def plain(value, column: str):
        try:
            return json.loads(value) if column in spec.json_columns and value is not None else value
        except ValueError:
            return value

    return [(x.path, older[x.column], newer[x.column]) for x in leaves if plain(older[x.column], x.column) != plain(newer[x.column], x.column)]
