"""Schema evolution: history keeps every column that it ever had; a change that would reinterpret values is refused."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from palimpsest.plans.spec import SchemaEvolutionError, TemporalSpec


def snapshot(spec: TemporalSpec, orphans: dict[str, str] | None = None) -> dict:
    """What is kept beside the data to compare the next declaration with. orphans: columns that the entity lost."""
    return {
        "identity": spec.identity,
        "name": spec.name,
        "table": spec.table,
        "key": list(spec.key),
        "period": list(spec.period),
        "retention": spec.retention,
        "session_user": spec.session_user,
        "columns": {x.column: x.type.json() for x in spec.leaves},
        "orphans": orphans or {},
    }


def evolve(old: dict, spec: TemporalSpec) -> dict:
    """The snapshot that follows old under the declaration spec.

    A removed column is kept as an orphan; declared again with its old type, it is whole again. A rename is an addition
    and an orphan. A changed type, a changed key, a changed period name and retention withdrawn are refused.
    """
    kept = {**old["columns"], **old["orphans"]}
    new = {x.column: x.type.json() for x in spec.leaves}
    if changed := sorted(c for c in new if c in kept and json.loads(kept[c]) != json.loads(new[c])):
        raise SchemaEvolutionError(f"{spec.name}: the type of {', '.join(changed)} differs from recorded history")
    if list(spec.key) != list(old["key"]):
        raise SchemaEvolutionError(f"{spec.name}: the key of recorded history is {', '.join(old['key'])}")
    if list(spec.period) != list(old["period"]):
        raise SchemaEvolutionError(f"{spec.name}: the period of recorded history is {', '.join(old['period'])}")
    if old["retention"] and not spec.retention:
        raise SchemaEvolutionError(f"{spec.name}: retention cannot be withdrawn once it is recorded")
    return snapshot(spec, {c: t for c, t in kept.items() if c not in new})


def orphan_fields(snap: dict) -> list[T.StructField]:
    return [T.StructField(c, T._parse_datatype_json_string(t), True) for c, t in snap["orphans"].items()]
