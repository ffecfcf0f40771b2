"""The corpus pipeline: toxicity, line deduplication, near duplicates, benchmark decontamination, mixing.

Each stage takes what its predecessor kept, as Parquet, and its decisions take effect: toxic documents go, repeated lines are cut
from texts, and with them documents of which nothing is left, one document of each group of near duplicates stays, documents with
benchmark passages go, and the mix says how many copies to take of the rest. All but the last return the columns of documents. Null and
empty texts pass every filtering stage, as do null ids; repeated rows are kept or dropped together, and an empty table stays empty. What a
near copy has of its own after line deduplication is a text of its own to the stages that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, linededup, minhash, mixing, toxicity
from palimpsest.llm.shared import scratch, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score() of toxicity predicts to be toxic. Without labels nothing is."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that stand elsewhere, short ones too, and without documents all of whose lines do; blank lines stay."""
    return linededup.dedup_lines(docs, least=0, bits=None, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 5-word shingles and a similarity of 0.8."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold 8 consecutive words of a benchmark item, or all words of a shorter one in a row."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document make the mix: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: No stage but the last can be said in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, with the rows of mix_sources(); a stage's table goes once the next one is written."""
    with scratch(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = stash(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        return stash(STAGES[-1][1](spark, docs, sf_dir), "stage-mixing", keep=True)
