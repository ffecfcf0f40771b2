"""Mixing sources to target weights by Pareto order sampling.

A source's ratio of target to size gives each document an expected number of copies: its whole part is certain, the rest is an
inclusion probability p. Documents are ranked by the odds of a fixed random number over the odds of p, and the first ranks
are taken until their words fill what the certain copies leave of the target. The cut is found over sums of rank buckets,
twice, so no source, however large, is ordered in one task; only the last bucket's few rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import SPACED, stash

#: Rank buckets of each of the two passes.
FAN = 4096


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone; a null key has one of its own."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), budget: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes: (source, source_size). Sources in order of code points, nulls last, weigh as cycle says, repeating, and share
    budget times all words; a target stops at most times its source, and the excess goes to the others by weight until none is
    above. Adds weight and target. The sources are sorted in one task: they are few beside the documents."""
    n = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (n % len(cycle) + 1).cast("int"))
    t = sizes.withColumn("weight", weight)
    cap = F.lit(most) * F.col("source_size")
    by_ratio = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    t = t.withColumns({
        "rank": F.row_number().over(by_ratio),
        "before": F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
        "total": F.lit(budget) * F.sum("source_size").over(W.partitionBy()),
    })
    level = (F.col("total") - F.col("before")) / F.col("rest")
    t = t.withColumns({"level": level, "full": cap / F.col("weight") < level})
    # Where the sources before it are full and it is not, a source's level is that of all that follow.
    free = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("rank"))).over(W.partitionBy())
    return t.select("source", "source_size", "weight", F.when(F.col("full"), cap).otherwise(F.least(cap, F.col("weight") * F.coalesce(free, F.lit(0.0)))).alias("target"))


def _cut(rows: DataFrame, bucket: str, need: DataFrame) -> DataFrame:
    """For each source the first bucket by whose end its words reach what is needed: (k, at, reached), at null if none."""
    sums = rows.groupBy("k", bucket).agg(F.sum("size").alias("s")).join(need, "k")
    sums = sums.withColumn("c", F.sum("s").over(W.partitionBy("k").orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)))
    return sums.where(F.col("c") >= F.col("need")).groupBy("k").agg(F.min(bucket).alias("at"), F.min_by(F.col("c") - F.col("s"), bucket).alias("reached"))


def mix(docs: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), budget: float = 1.0, most: int = 3, seed: int = 9, preference: str | None = None) -> DataFrame:
    """What a mix takes of each document: doc_id, source, size, source_size, target, copies, taken.

    size: words between ASCII white space (null: 0). preference: a positive column of docs; inclusion is in proportion to it
    within a source (default: equal). copies is at most `most`; a source's taken words differ from its target by at most half
    the size of one document, unless preferences run into that bound. The random numbers are digests of doc_id, so reruns
    agree; repeated ids tie, and are ranked by size. A null source is a source, the last. Empty tables give no rows, and sources
    without words a target of 0. Other columns are not read.
    """
    k = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    like = F.col(preference).cast("double") if preference else F.lit(1.0)
    base = docs.select(F.col("doc_id").cast("long"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long").alias("size"), like.alias("like"))
    base = stash(base.withColumns({"k": k, "u": uniform(F.col("doc_id"), seed)}), "mix")
    sizes = base.groupBy("k", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("like")).alias("liked"))
    shares = targets(sizes, cycle, budget, float(most)).withColumn("k", k)
    shares = shares.join(sizes.select("k", "liked"), "k").withColumn("ratio", F.when(F.col("liked") > 0, F.col("target") / F.col("liked")).otherwise(0.0))
    shares = stash(shares.select("k", "source_size", "target", "ratio"), "mix-shares")
    rows = base.join(shares, "k").withColumn("m", F.least(F.lit(float(most)), F.col("ratio") * F.col("like")))
    rows = rows.withColumns({"sure": F.floor("m"), "p": F.col("m") - F.floor("m")})
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    rows = rows.withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds)))
    rows = rows.withColumns({"b1": F.floor(F.col("v") * FAN), "b2": F.floor(F.col("v") * FAN * FAN)})
    need = rows.groupBy("k", "target").agg((F.col("target") - F.sum(F.col("sure") * F.col("size"))).alias("need")).drop("target")
    need = stash(need, "mix-need")
    drawn = rows.where("p > 0")
    one = stash(_cut(drawn, "b1", need.where("need > 0")), "mix-cut")
    rows = rows.join(need, "k").join(one.withColumnsRenamed({"at": "at1", "reached": "r1"}), "k", "left")
    edge = rows.where("p > 0 AND b1 = at1").select("k", "b2", "size", "need", "r1")
    two = _cut(edge, "b2", edge.select("k", (F.col("need") - F.col("r1")).alias("need")).distinct())
    two = stash(two.withColumnsRenamed({"at": "at2", "reached": "r2"}), "mix-cut")
    rows = rows.join(two, "k", "left")
    last = (F.col("p") > 0) & (F.col("b1") == F.col("at1")) & (F.col("b2") == F.col("at2"))
    rows = rows.withColumn("last", F.coalesce(last, F.lit(False)))
    done = rows.where(~F.col("last"))
    extra = (F.col("p") > 0) & (F.col("need") > 0) & (F.col("at1").isNull() | (F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("b2") < F.col("at2"))))
    done = done.withColumn("extra", F.coalesce(extra, F.lit(False)).cast("long"))
    tail = rows.where("last").withColumn("c", F.col("r1") + F.col("r2") + F.sum("size").over(W.partitionBy("k").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)))
    short = F.col("need") - (F.col("c") - F.col("size"))
    tail = tail.withColumn("extra", ((F.col("c") <= F.col("need")) | ((short > 0) & (F.col("c") - F.col("need") < short))).cast("long")).drop("c")
    copies = F.col("sure") + F.col("extra")
    out = done.unionByName(tail)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def sql(table: str = "documents", seed: int = 9, most: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> str:
    """The same in DuckDB's SQL, with whole windows."""
    w = " ".join(f"WHEN {i} THEN {c}.0::DOUBLE" for i, c in enumerate(cycle))
    return f"""WITH a AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACED}')), 0)::BIGINT AS size,
(('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM a GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(cycle)} {w} END AS weight, {most}.0::DOUBLE * source_size AS cap FROM s),
s2 AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(source_size) OVER ())::DOUBLE AS total FROM s1 WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source))),
s3 AS (SELECT *, (total - before) / rest AS level, cap / weight < (total - before) / rest AS isfull FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN isfull THEN cap ELSE least(cap, weight * coalesce((SELECT level FROM s3 WHERE NOT isfull ORDER BY rank LIMIT 1), 0.0::DOUBLE)) END AS target FROM s3),
r AS (SELECT a.*, source_size, target, CASE WHEN source_size > 0 THEN least({most}.0::DOUBLE, target / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS m FROM a JOIN s4 ON a.source IS NOT DISTINCT FROM s4.source),
r1 AS (SELECT *, floor(m)::BIGINT AS sure, m - floor(m) AS p FROM r),
r2 AS (SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) * ((1 - p) / p)) / (1 + (u / (1 - u)) * ((1 - p) / p)) END AS v, target - sum(sure * size) OVER (PARTITION BY source) AS need FROM r1),
r3 AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id, size ROWS UNBOUNDED PRECEDING) AS c FROM r2)
SELECT doc_id, source, size, source_size, target, sure + n AS copies, ((sure + n) * size)::BIGINT AS taken FROM
(SELECT *, CASE WHEN p > 0 AND need > 0 AND (c <= need OR (need - (c - size) > 0 AND c - need < need - (c - size))) THEN 1 ELSE 0 END::BIGINT AS n FROM r3)"""
