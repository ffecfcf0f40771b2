"""Interval joins of histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_join(facts: DataFrame, history: DataFrame, on: Column, at: Column, period: Sequence[str] = ("valid_from", "valid_to"), how: str = "inner") -> DataFrame:
    """Each fact with the version that was valid when it happened. on holds the equality of keys, so the join is hashed by
    key and the period is a residual condition; a key has one version at an instant, so facts do not multiply."""
    return facts.join(history.where(F.col("operation") != 3), on & (at >= F.col(period[0])) & (at < F.col(period[1])), how)


def overlap_join(left: DataFrame, right: DataFrame, on: Column, left_period: Sequence[str], right_period: Sequence[str]) -> DataFrame:
    """Pairs of versions that were valid together, with the common period as overlap_from and overlap_to."""
    lf, lt, rf, rt = (F.col(c) for c in (*left_period, *right_period))
    out = left.join(right, on & (lf < rt) & (rf < lt))
    return out.withColumns({"overlap_from": F.greatest(lf, rf), "overlap_to": F.least(lt, rt)})


def as_of_many(instants: DataFrame, history: DataFrame, at: Column, period: Sequence[str] = ("valid_from", "valid_to")) -> DataFrame:
    """The versions at each of a few instants that come as rows, so that one plan serves any of them. There is no equality to join on: the
    instants are broadcast, and callers keep them few."""
    return history.where(F.col("operation") != 3).join(F.broadcast(instants), (at >= F.col(period[0])) & (at < F.col(period[1])))
