"""Labelled rows to learn from: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % divisor


def held_out(column: str = "doc_id", divisor: int = 4, kept_back: int = 2) -> Column:
    return F.coalesce(remainder(column, divisor) == kept_back, F.lit(False))


def sample(labels: DataFrame, label: str, rows: int, divisor: int | None = 4) -> DataFrame:
    """(doc_id, y): at most `rows` labelled ids, those of the smallest hashes, without the held-out ones. An id that is labelled
    more than once has its largest label. The bound is what allows the result to be broadcast."""
    out = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    out = out.where(~held_out("doc_id", divisor)) if divisor else out
    return out.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
