"""Half-open periods [from, to) over microsecond timestamps without time zone (UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The open end on disk. It sorts after every instant; results show null instead (see closed_or_null).
SENTINEL = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)
SENTINEL_US = 253402300799999999


def instant(value: dt.datetime, name: str = "instant") -> dt.datetime:
    """value as a naive UTC datetime; datetime.max stands for the open end."""
    if not isinstance(value, dt.datetime):
        raise TypeError(f"{name} must be a datetime, not {type(value).__name__}")
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def window(start: dt.datetime, end: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Both bounds, checked before any plan is built."""
    a, b = instant(start, "start"), instant(end, "end")
    if a > b:
        raise ValueError(f"the window ends before it starts: {a} > {b}")
    return a, b


def ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


_DAY_US = 86_400_000_000


def to_us(c: Column, kind: T.DataType | None = None) -> Column:
    """Microseconds since 1970 of a wall-clock time, read as UTC in whatever zone the session has. kind: the type of c; an instant
    (timestamp with zone) keeps its microseconds."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    c = c.cast("timestamp_ntz")
    seconds = (F.unix_date(c.cast("date")).cast("bigint") * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def from_us(c: Column) -> Column:
    """The wall-clock time of microseconds since 1970, the same in every session zone."""
    rest = F.pmod(c, F.lit(_DAY_US))
    days = F.floor((c - rest) / _DAY_US).cast("int")
    step = F.make_dt_interval(days, F.lit(0), F.lit(0), (rest.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + step


def contains_instant(vf: Column, vt: Column, t: dt.datetime) -> Column:
    return (vf <= ntz(t)) & (vt > ntz(t))


def overlaps(vf: Column, vt: Column, a: dt.datetime, b: dt.datetime) -> Column:
    """Range overlap: an empty window overlaps nothing, even strictly inside a period."""
    return F.lit(False) if a == b else (vf < ntz(b)) & (vt > ntz(a))


def within(vf: Column, vt: Column, a: dt.datetime, b: dt.datetime) -> Column:
    return F.lit(False) if a == b else (vf >= ntz(a)) & (vt <= ntz(b))


def is_open(vt: Column) -> Column:
    return vt == ntz(SENTINEL)


def closed_or_null(vt: Column) -> Column:
    """The end of a period for results: null while it is open (the sentinel overflows pandas timestamps)."""
    return F.nullif(vt, ntz(SENTINEL))


def month(c: Column) -> Column:
    """The partition bucket of an end; that of the open end sorts last."""
    return F.concat_ws("-", F.lpad(F.year(c).cast("string"), 4, "0"), F.lpad(F.month(c).cast("string"), 2, "0"))
