"""The queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import ctw, decontaminate, fingerprint, linededup, minhash, mixing, quality, substrings, toxicity, warc
from palimpsest.llm import pipeline as corpus

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query()
def op1_decontaminate(s, d):
    return decontaminate.contamination(_table(s, d, "documents"), _table(s, d, "benchmark"))


@_query(mixing.sql())
def op9_mixing(s, d):
    return mixing.mix(_table(s, d, "documents"))


@_query()
def op6_warc(s, d):
    return warc.round_trip(_table(s, d, "pages"))


@_query()
def op10_fingerprint(s, d):
    return fingerprint.fingerprints(_table(s, d, "documents"))


@_query()
def op2_toxicity(s, d):
    return toxicity.score(_table(s, d, "documents"), _table(s, d, "labels"))


@_query()
def op3_quality(s, d):
    return quality.score(_table(s, d, "documents"), _table(s, d, "labels"))


@_query()
def op8_minhash(s, d):
    return minhash.groups(_table(s, d, "documents"), k=3, percent=85)


@_query()
def op4_linededup(s, d):
    return linededup.report(_table(s, d, "documents"), least=0, bits=None)


@_query()
def op7_ctw(s, d):
    return ctw.scores(_table(s, d, "documents"))


@_query()
def op5_substrings(s, d):
    return substrings.dedup(_table(s, d, "documents")).drop("kept")


@_query(corpus.ORACLE_SQL)
def pipeline(s, d):
    return corpus.run(s, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
