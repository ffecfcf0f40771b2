"""Order MinHash fingerprints, in DataFrame functions alone.

A text's k-mers of words are numbered by occurrence, so that repeats count, and hashed. The range of the hash is cut into
SKETCHES equal parts; in each part the TUPLE smallest are selected, put back into the order of the text and hashed as a tuple. Two
texts agree on a part if they share its smallest k-mers and their order, so the share of agreeing parts falls with the edit
distance, where a plain MinHash would not see moved passages. k is 2: an edit of one word touches two k-mers, and texts of a
few words still have some.

Arrays of longs carry a hash in their upper 34 bits and a position in the lower 30, so both sorts are of plain numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import SPACED

SKETCHES = 64
TUPLE = 2
K = 2
_POSITION = 30
_LOW = (1 << _POSITION) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(at.cast("bigint"))


def _hash(x: Column) -> Column:
    return F.shiftright(x, _POSITION)


def _kmers(words: Column, k: int) -> Column:
    """Hashes of k words in a row; a text of fewer words, but at least one, has one k-mer."""

    def of(w: Column) -> Column:
        h = w
        for j in range(1, k):
            n = F.size(w) - j
            h = F.zip_with(F.slice(h, F.lit(1), n), F.slice(w, F.lit(j + 1), n), lambda a, b: F.xxhash64(a, b))
        whole = F.array(F.xxhash64(F.array_join(w, " "))) if k > 1 else F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(w) >= k, h if k > 1 else whole).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def _numbered(kmers: Column) -> Column:
    """Packed hashes of (k-mer, number of its occurrence) with their positions, in no order."""

    def of(s: Column) -> Column:
        indices = F.sequence(F.lit(0), F.size(s) - 1)
        value = lambda i, n: _packed(F.xxhash64(_hash(F.get(s, i)), n), F.get(s, i).bitwiseAND(F.lit(_LOW)))
        like_last = lambda i: _hash(F.get(s, i)) == _hash(F.get(s, i - 1))  # noqa: E731  null at 0
        like_next = lambda i: _hash(F.get(s, i)) == _hash(F.get(s, i + 1))  # noqa: E731  null at the end

        def runs(again: Column) -> Column:
            """again: indices of later occurrences. Where a run of equal k-mers starts and ends, in step with each other."""
            starts = F.filter(again, lambda i: ~F.coalesce(like_last(i - 1), F.lit(False)))
            ends = F.filter(again, lambda i: ~F.coalesce(like_next(i), F.lit(False)))
            return F.flatten(F.zip_with(starts, ends, lambda a, b: F.transform(F.sequence(a, b), lambda i: value(i, i - a + 1))))

        firsts = F.transform(F.filter(indices, lambda i: ~F.coalesce(like_last(i), F.lit(False))), lambda i: value(i, F.lit(0)))
        later = let(F.filter(indices, lambda i: F.coalesce(like_last(i), F.lit(False))), runs)
        return F.when(F.size(s) > 0, F.concat(firsts, later)).otherwise(s)

    return let(F.sort_array(F.transform(kmers, _packed)), of)


def signature(text: Column, k: int = K) -> Column:
    """SKETCHES numbers from 1 to 65535, 0 for a part without k-mers. A null text is empty."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED), F.lit(0))
    part = lambda x: F.shiftright(x, 58)  # noqa: E731  of 64, from -32 to 31
    assert SKETCHES == 64

    def of(v: Column) -> Column:
        least = F.filter(v, lambda x, i: (i < TUPLE) | (part(x) != part(F.get(v, i - TUPLE))))

        def tuples(m: Column) -> Column:
            def entry(x: Column, i: Column) -> Column:
                nxt = F.get(m, i + 1)
                two = nxt.isNotNull() & (part(nxt) == part(x))
                ahead = x.bitwiseAND(F.lit(_LOW)) < nxt.bitwiseAND(F.lit(_LOW))
                h = F.when(two & ahead, F.xxhash64(_hash(x), _hash(nxt))).when(two, F.xxhash64(_hash(nxt), _hash(x))).otherwise(F.xxhash64(_hash(x)))
                first = (i == 0) | (part(F.get(m, i - 1)) != part(x))
                return F.struct((part(x) + 32).cast("int").alias("p"), F.when(first, (F.pmod(h, F.lit(65535)) + 1).cast("int")).alias("h"))

            found = F.map_from_entries(F.filter(F.transform(m, entry), lambda e: e["h"].isNotNull()))
            return let(found, lambda at: F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda p: F.coalesce(F.element_at(at, p), F.lit(0))))

        return let(least, tuples)

    return let(F.sort_array(_numbered(_kmers(words, k))), of)


def as_text(sig: Column) -> Column:
    """Four hexadecimal digits a part."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of parts with k-mers on either side on which both agree; two empty texts are alike."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1025).otherwise(1))
    return let(F.aggregate(both, F.lit(0), lambda s, x: s + x), lambda n: F.when(n == 0, 1.0).otherwise(F.floor(n / 1024) / (n % 1024)))


def _buckets(docs: DataFrame, rows: int, most: int) -> tuple[Column, DataFrame]:
    """A range of doc_id as a number, falling with the ids, of about rows rows; and a table of the buckets that have rows:
    (bucket, top: its largest id, above: the bucket before it, that of the last for the first). At most `most` rows."""
    spark = docs.sparkSession
    oid = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = docs.count()
    parts = max(1, min(most, -(-n // rows)))
    bounds: list[int] = []
    if parts > 1:
        found = docs.select(F.percentile_approx(oid, [i / parts for i in range(1, parts)], F.lit(parts * 20))).first()[0]
        bounds = sorted(set(found))
    size = 1
    while size <= len(bounds):
        size *= 2
    # The number of bounds that are not above the id, by halving steps over an array that ends in the largest number.
    padded = F.array(*[F.lit(x).cast("bigint") for x in bounds + [(1 << 63) - 1] * (size - len(bounds))])

    def halving(b: Column, step: int) -> Callable[[Column], Column]:
        return lambda p: F.when(F.get(b, p + (step - 1)) <= oid, p + step).otherwise(p)

    def search(b: Column) -> Column:
        at, step = F.lit(0), size
        while step > 1:
            step //= 2
            at = let(at, halving(b, step))
        return at

    bucket = (-search(padded)).cast("int") if bounds else F.lit(0)
    tops = docs.select(bucket.alias("bucket"), oid.alias("oid")).groupBy("bucket").agg(F.max("oid").alias("top")).orderBy("bucket").collect()
    table = [(r.bucket, r.top, tops[i - 1].bucket) for i, r in enumerate(tops)]
    return bucket, spark.createDataFrame(table, "bucket int, top long, above int")


def fingerprints(docs: DataFrame, *, rows: int = 256, most_buckets: int = 16384) -> DataFrame:
    """The fingerprint of each text and of its edited text: the last floor(n_chars / 2) code points replaced by the first as many,
    or all, of the next document in falling order of doc_id (after the last: the first).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; null ids
    come last; rows of one id are ordered by a hash of their text. One document alone follows itself. Documents are dealt
    to ranges of ids, so neighbours meet in one exchange of the texts; the first row of a range goes to the range before it too.
    Other columns are not read.
    """
    bucket, table = _buckets(docs, rows, most_buckets)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    d = d.withColumn("oid", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("sig", signature(F.col("text")))
    d = d.join(F.broadcast(table), "bucket")  # at most most_buckets rows
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))
    again = F.struct(F.col("above").alias("b"), F.lit(1).alias("ghost"))
    d = d.withColumn("to", F.explode(F.when(F.col("oid") == F.col("top"), F.array(own, again)).otherwise(F.array(own))))
    d = d.select("doc_id", "text", "sig", "oid", "to.b", "to.ghost")
    w = W.partitionBy("b").orderBy("ghost", F.desc("oid"), F.xxhash64("text"))
    d = d.select("*", F.lead("text").over(w).alias("next_text"), F.lead("sig").over(w).alias("next_sig")).where("ghost = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    d = d.withColumn("edited_sig", signature(F.col("edited")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
