"""Fuzzy line deduplication.

Lines are normalised to their lower-cased words of letters, digits and non-ASCII code points; equal ones are one node. Two nodes
are linked if the edit distance of their normalised texts is small against the longer one; of each connected group of lines the
first occurrence stays. SimHashes of lines a fifth of whose characters differ are 10 to 20 bits apart, too far for blocks of a pigeonhole:
so pairs to compare meet in ANCHORS minima of word triples, taken from as many parts of the hash's range and preferring long triples,
which are rare, and short lines in bands of 4-byte grams too. A pair that has met is dropped if its lengths, or the SimHashes of its word
pairs, differ too much; the rest is decided by the edit distance alone. Short lines meet by chance, as often as the square of their number:
their pairs are decided where they meet, by a bound from counts of their letters, then by the distance itself, and leave links only.
After the rounds of leaders all lines are compared so, in numpy, by parts of buckets; of lines that meet, those go before that whose lengths or
SimHashes leave them no partner, and pairs that links join already are not measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.edits import Texts, close
from palimpsest.llm.edits import near as alike
from palimpsest.llm.links import Met, grouped, membership
from palimpsest.llm.shared import free, scratch, stash

#: Minima of word triples of a line, and (bytes of a gram, minima in a band, bands) that lines of at most SHORT characters have beside.
ANCHORS, BRIEF, SHORT = 6, (4, 2, 8), 48
#: Bits in which the SimHashes of linked lines may differ where a caller limits them.
DISTANCE = 3
#: Bits in which SimHashes of word pairs may differ for a pair to be compared, where one of its lines has more than SIFTED characters;
#: other pairs carry their texts and letters.
SIFT, SIFTED = 20, 64
#: Numbers of 64 bits in the filter of the documents that lose lines.
CELLS = 1 << 18
#: Columns of the short lines alone.
BRIEFLY = ("text", "w0", "w1", "w2", "w3")

#: Stands for a null id, which comes last.
_LAST = (1 << 63) - 1


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, empty ones too, and where each text's begin; a text has a line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(off, feeds, "right") - 1
    n = np.bincount(row, minlength=len(off) - 1) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    starts[first], starts[~first] = off[:-1], feeds + 1
    last = np.zeros(at[-1], bool)
    last[at[1:] - 1] = True
    ends[last], ends[~last] = off[1:], feeds
    return starts, ends, at


def _nodes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, node, words) of the lines of at least `least` words, and hash, start and end of their words in the lower-cased data."""
    low = W.LOWER[data]
    edge = np.append(starts, len(data))
    s, e, wo = W.spans(low, np.unique(np.concatenate([[0], edge])), W.ALNUM)
    h = W.hashes(low, s, e)
    a, b = np.searchsorted(s, starts), np.searchsorted(s, ends)
    long = np.flatnonzero(b - a >= max(least, 1))
    if not len(long):
        z = np.zeros(0, np.int64)
        return z, z, z, h[:0], z, z, low
    a, b = a[long], b[long]
    n = b - a
    inside = np.zeros(len(h) + 1, np.int64)
    np.add.at(inside, a, 1)
    np.add.at(inside, b, -1)
    keep = np.cumsum(inside[:-1]) > 0
    h = h[keep]
    at = np.cumsum(n) - n
    place = np.arange(len(h)) - np.repeat(at, n)
    node = W.mix(np.add.reduceat(W.mix(h + W.mix(place.astype(np.uint64))), at) + n.astype(np.uint64))
    return long, node.view(np.int64), n, h, s[keep], e[keep], low


def _simhash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    at, sim = np.cumsum(n) - n, np.zeros(len(n), np.uint64)
    for i in range(64 if len(n) else 0):
        ones = np.add.reduceat((h >> np.uint64(i)).astype(np.uint8) & 1, at, dtype=np.int64)
        sim |= (2 * ones > n).astype(np.uint64) << np.uint64(i)
    return sim.view(np.int64)


def _wordless(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, node) of the lines that have no word but are not blank: their bytes without white space around."""
    s, e, wo = W.spans(data, np.append(starts, len(data)), W.NON_SPACE)
    words = np.searchsorted(np.flatnonzero(W.ALNUM[W.LOWER[data]]), np.stack([starts, ends]))
    line = np.flatnonzero((np.diff(wo) > 0) & (words[0] == words[1]))
    if not len(line):
        return line, line
    h = W.hashes(data, s[wo[line]], e[wo[line + 1] - 1])
    return line, W.mix(h ^ np.uint64(0x27D4EB2F165667C5)).view(np.int64)


def _plain(n: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lines with a space before each and after the last, and where each line begins."""
    size, line = e - s, np.repeat(np.arange(len(n)), n)
    before = np.cumsum(size) - size
    to = before + np.arange(len(s)) + 1 + line
    step = np.arange(int(size.sum()))
    buf = np.full(len(step) + len(s) + len(n), 32, np.uint8)
    buf[np.repeat(to - before, size) + step] = low[np.repeat(s - before, size) + step]
    return buf, np.append(to[np.cumsum(n) - n] - 1, len(buf))


def _bands(h: np.ndarray, row: np.ndarray, rows: int, seed: int, r: int, b: int) -> np.ndarray:
    """(rows, b): keys of bands of r minima of the features h of rows; every row has one. An empty bin takes the next one's minimum."""
    m = r * b
    v = W.mix(h ^ np.uint64(seed))
    cell = row.astype(np.uint64) * np.uint64(m) + ((v >> np.uint64(32)) * np.uint64(m) >> np.uint64(32))
    code = np.sort(cell << np.uint64(32) | (v & np.uint64(0xFFFFFFFF)))
    cell = code >> np.uint64(32)
    first = np.append(True, cell[1:] != cell[:-1])
    least = np.zeros((rows, m), np.uint64)
    found = np.zeros((rows, m), bool)
    least.ravel()[cell[first].astype(np.int64)] = code[first] & np.uint64(0xFFFFFFFF)
    found.ravel()[cell[first].astype(np.int64)] = True
    here = np.where(found, np.arange(m), 2 * m)
    of = np.minimum.accumulate(np.concatenate([here, here + m], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :m] % m
    least = np.take_along_axis(least, of, 1) | of.astype(np.uint64) << np.uint64(32)
    key = np.broadcast_to(W.mix(np.arange(b, dtype=np.uint64) + np.uint64(seed)), (rows, b)).copy()
    for i in range(r):
        key = W.mix(key ^ least[:, i * b : (i + 1) * b])
    return key.view(np.int64)


def _word_grams(n: np.ndarray, h: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k words in a row with a mark on either side of each line: their hashes, lines and bytes."""
    m = n + 2
    at = np.cumsum(m) - m
    ext, bytes_ = np.full(int(m.sum()) + k, 0x51ED270B7F2C3A19, np.uint64), np.zeros(int(m.sum()) + k, np.int64)
    place = np.arange(len(h)) + 2 * np.repeat(np.arange(len(n)), n) + 1
    ext[place], bytes_[place] = h, size
    c = np.maximum(m - k + 1, 1)
    row = np.repeat(np.arange(len(n)), c)
    place = np.arange(len(row)) + np.repeat(at - (np.cumsum(c) - c), c)
    total = np.append(0, np.cumsum(bytes_))
    return W.ngrams(ext, k)[place], row, total[place + k] - total[place]


def _byte_grams(begin: np.ndarray, buf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(begin)
    c = np.maximum(length - size + 1, 1)
    row = np.repeat(np.arange(len(length)), c)
    place = np.arange(len(row)) + np.repeat(begin[:-1] - (np.cumsum(c) - c), c)
    lanes = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))
    return lanes[place] & W._MASK[np.minimum(begin[row + 1] - place, size)], row


def _anchors(n: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(lines, ANCHORS) keys: the first of each part by length, then by hash; a part without a triple repeats another's."""
    g, row, length = _word_grams(n, h, size, 3)
    v = W.mix(g ^ np.uint64(0x9E3779B1))
    rank = v & np.uint64(0xFFFFFF) | (np.clip(24 - length, 0, 15) // 3).astype(np.uint64) << np.uint64(24)
    cell = row.astype(np.uint64) * np.uint64(ANCHORS) + ((v >> np.uint64(32)) * np.uint64(ANCHORS) >> np.uint64(32))
    code = np.sort(cell << np.uint64(32) | rank)
    cell = code >> np.uint64(32)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    found = np.zeros((len(n), ANCHORS), np.uint64)
    cell = cell[first].astype(np.int64)
    found.ravel()[cell] = W.mix(code[first] & np.uint64(0xFFFFFFFF) | (cell % ANCHORS + 1).astype(np.uint64) << np.uint64(34))
    return np.where(found == 0, found.max(axis=1, keepdims=True), found).view(np.int64)


def _letters(begin: np.ndarray, buf: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """(lines, 4): of each of 32 classes of code points, by their last bytes, a byte with a bit for each up to eight that the line has. An
    edit adds one bit at most and takes one at most."""
    row = np.repeat(np.cumsum(pick) - 1, np.diff(begin))
    keep = np.repeat(pick, np.diff(begin)) & np.append((buf[1:] & 0xC0) != 0x80, True)
    count = np.bincount(row[keep] * 32 + (buf[keep] & 31), minlength=32 * int(pick.sum()))
    return ((1 << np.minimum(count, 8)) - 1).astype(np.uint8).view("<i8").reshape(-1, 4)


def _strings(begin: np.ndarray, buf: np.ndarray, pick: np.ndarray) -> pa.Array:
    """The texts of the lines picked."""
    at, size = begin[:-1][pick] + 1, np.diff(begin)[pick] - 2
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data = buf[np.repeat(at, size) + inside]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data))


def _keys(n: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Characters of the normalised lines, (lines, keys) of all and of the short ones, and what _plain() gives."""
    buf, begin = _plain(n, s, e, low)
    chars = np.add.reduceat(((buf & 0xC0) != 0x80).astype(np.int64), begin[:-1]) - 2
    out = [(np.arange(len(n)), _anchors(n, h, e - s))]
    mine = chars <= SHORT
    if mine.any():
        size, r, b = BRIEF
        f, row = _byte_grams(begin, buf, size)
        keep = mine[row]
        out.append((np.flatnonzero(mine), _bands(f[keep], (np.cumsum(mine) - 1)[row[keep]], int(mine.sum()), 0x2545F491, r, b)))
    return chars, out, (buf, begin)


def _occurrences(docs: DataFrame, least: int, percent: int, bits: int | None) -> DataFrame:
    """(node, doc_id, line, chars, sim, keys, text, w0 to w3) of lines; keys are null where the same line has stood shortly before, and where
    there are no words. sim: of single words where bits limits the links, else of pairs, and then short lines with keys have their text and
    letters."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, off = W.buffers(batch.column(1))
            for i, j in W.slices(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, at = _lines(part, o)
                line, node, n, h, s, e, low = _nodes(part, starts, ends, least)
                _, once = np.unique(node, return_index=True)
                mine = np.zeros(len(node), bool)
                mine[once] = True
                words = np.repeat(mine, n)
                n, h, s, e = n[mine], h[words], s[words], e[words]
                chars, sim, lists = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
                flat, brief = np.zeros(0, np.int64), np.zeros(len(node), bool)
                texts, letters = pa.array([], pa.string()), np.zeros((0, 4), np.int64)
                if len(n):
                    grams, row = (h, np.repeat(np.arange(len(n)), n)) if bits is not None else _word_grams(n, h, e - s, 2)[:2]
                    sim[mine] = _simhash(grams, np.bincount(row, minlength=len(n)))
                    chars[mine], found, (buf, begin) = _keys(n, h, s, e, low, percent)
                    if bits is None:
                        brief = mine & (chars <= SIFTED)
                        texts, letters = _strings(begin, buf, brief[mine]), _letters(begin, buf, brief[mine])
                    owner = np.concatenate([np.repeat(pick, k.shape[1]) for pick, k in found])
                    flat = np.concatenate([k.ravel() for _, k in found])
                    order = np.lexsort((flat, owner))
                    owner, flat = owner[order], flat[order]
                    new = np.append(True, (owner[1:] != owner[:-1]) | (flat[1:] != flat[:-1]))
                    owner, flat = owner[new], flat[new]
                    lists[mine] = np.bincount(owner, minlength=len(n))
                if least < 1:
                    more, other = _wordless(part, starts, ends)
                    line, node = np.append(line, more), np.append(node, other)
                    z = np.zeros(len(more), np.int64)
                    chars, sim, lists, mine, brief = np.append(chars, z), np.append(sim, z), np.append(lists, z), np.append(mine, z > 0), np.append(brief, z > 0)
                row = np.searchsorted(at, line, "right") - 1
                offsets = pa.array(np.append(0, np.cumsum(lists)).astype(np.int32), mask=np.append(~mine, False))
                own = pa.array(np.cumsum(brief) - 1, mask=~brief)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), ids.slice(i, j - i).take(pa.array(row)), pa.array(line - at[row]), pa.array(chars), pa.array(sim), pa.ListArray.from_arrays(offsets, pa.array(flat)), texts.take(own)]
                    + [pa.array(letters[:, k]).take(own) for k in range(4)],
                    ["node", "doc_id", "line", "chars", "sim", "keys", "text", "w0", "w1", "w2", "w3"],
                )

    schema = "node long, doc_id long, line long, chars long, sim long, keys array<long>, text string, w0 long, w1 long, w2 long, w3 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _spot(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number of a line's place, by its document and number."""
    return W.mix(W.mix(ids.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def _texts(docs: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(node, text) of the lines asked for, normalised; asked: (node, d, line), d the id or _LAST. A filter of their places picks the
    lines, so that the other ones are not read word by word and no document is shuffled."""

    wanted = membership(asked.select("d", "line"), asked.count(), _spot)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = W.buffers(batch.column(1))
            for i, j in W.slices(off, 1 << 20):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, at = _lines(part, o)
                row = np.repeat(np.arange(j - i), np.diff(at))
                pick = np.flatnonzero(wanted.value(_spot(ids[i + row], np.arange(len(row)) - at[row])))
                if not len(pick):
                    continue
                size = ends[pick] - starts[pick]
                to = np.append(0, np.cumsum(size + 1))
                took = np.full(to[-1], 10, np.uint8)
                inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                took[np.repeat(to[:-1], size) + inside] = part[np.repeat(starts[pick], size) + inside]
                line, node, n, _, s, e, low = _nodes(took, to[:-1], to[1:] - 1, max(least, 1))
                if not len(line):
                    continue
                buf, begin = _plain(n, s, e, low)
                edges = np.append(begin[:-1] + 1, 0).astype(np.int64)
                flat, cut = buf.tobytes(), np.append(begin[1:] - 1, 0)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([flat[x:y].decode() for x, y in zip(edges[:-1], cut[:-1], strict=True)], pa.string())], ["node", "text"])

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "text")
    return d.mapInArrow(run, "node long, text string").dropDuplicates(["node"]).join(asked, "node", "left_semi")


def removals(docs: DataFrame, *, least: int = 5, percent: int = 80, bits: int | None = DISTANCE) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of the lines to remove from a document."""
    with scratch(docs.sparkSession):
        return stash(_removals(docs, least, percent, bits), "lines-gone", keep=True)


def _removals(docs: DataFrame, least: int, percent: int, bits: int | None) -> DataFrame:
    occ = stash(_occurrences(docs, least, percent, bits), "lines")
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "line")
    what = [F.max("chars").alias("chars"), F.max(F.when(F.col("keys").isNotNull(), F.col("sim"))).alias("sim"), *[F.max(c).alias(c) for c in BRIEFLY]]
    nodes = occ.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("c"), *what)
    nodes = stash(nodes, "line-nodes")

    def near(x: Column, y: Column) -> Column:
        longest = F.greatest(x["chars"], y["chars"])
        alike = F.abs(x["chars"] - y["chars"]) * 100 <= longest * (100 - percent)
        apart = F.bit_count(x["sim"].bitwiseXOR(y["sim"]))
        if bits is not None:
            return alike & (apart <= bits)
        most = longest * (100 - percent)

        def more(p: Column, q: Column) -> Column:
            return sum((F.bit_count(p[c].bitwiseAND(F.bitwise_not(q[c]))) for c in BRIEFLY[1:]), F.lit(0))

        edits = F.levenshtein(x["text"], y["text"], SIFTED * (100 - percent) // 100)
        brief = (more(x, y) * 100 <= most) & (more(y, x) * 100 <= most) & (edits >= 0) & (edits * 100 <= most)
        return alike & F.when(longest <= SIFTED, brief).otherwise(apart <= SIFT)

    def texts(asked: DataFrame) -> DataFrame:
        asked = stash(asked.join(known, "node").select("node", "first.d", "first.line"), "line-asked")
        return stash(_texts(docs, asked, least), "line-texts")

    def pairs(pairs: DataFrame) -> DataFrame:
        text = texts(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        p = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return p.select("a", "b", "ta", "tb").mapInArrow(lambda batches: close(batches, percent), "a long, b long")

    def told(chars: np.ndarray, sim: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near(), but for the letters and edits of short lines; the bits of difference, and the characters of the longer lines."""
        longest = np.maximum(chars[i], chars[j])
        keep = np.abs(chars[i] - chars[j]) * 100 <= longest * (100 - percent)
        apart = np.bitwise_count((sim[i] ^ sim[j]).view(np.uint64)).astype(np.int64)
        return keep & (apart <= bits if bits is not None else (longest <= SIFTED) | (apart <= SIFT)), apart, longest

    def sift(col: dict[str, pa.Array], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep, apart, longest = told(col["chars"].to_numpy(), col["sim"].to_numpy(), i, j)
        if bits is not None:
            return np.where(keep, apart, -1)
        brief, most = longest <= SIFTED, longest * (100 - percent)
        at = np.flatnonzero(keep & brief)
        w = np.stack([col[c].fill_null(0).to_numpy() for c in BRIEFLY[1:]])
        x, y = (w[:, k[at]].view(np.uint64) for k in (i, j))
        keep[at] = np.maximum(np.bitwise_count(x & ~y).sum(axis=0, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=0, dtype=np.int64)) * 100 <= most[at]
        return np.where(keep, apart, -1)

    def test(col: dict[str, pa.Array], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        t = Texts(col["whole"].take(pa.array(used)))
        return alike(t, at[: len(i)], t, at[len(i) :], percent)

    def features() -> DataFrame:
        return known.select("node", F.struct("chars", "sim", *BRIEFLY).alias("f"))

    def narrow(met: DataFrame) -> DataFrame:
        nonlocal known
        known = stash(nodes.join(met, "node", "left_semi"), "line-known")
        return features()

    known = nodes
    lists = occ.where("keys IS NOT NULL").select("node", "keys", "chars", "sim")
    confirm = Met(pairs, lambda asked: texts(asked).withColumnRenamed("text", "whole"), sift, test, lists, lambda col, i, j: told(col["chars"], col["sim"], i, j)[0], narrow)
    label = grouped(occ.select("node", F.explode("keys").alias("key")), features(), near, confirm, "lines")
    linked = nodes.join(label, "node", "left").select("node", "first", "c", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("fuzzy"))
    firsts = linked.where("fuzzy").groupBy("root").agg(F.min("first").alias("keep"))
    keep = linked.where("c > 1 OR fuzzy").join(firsts, "root", "left").select("node", F.coalesce("keep", "first").alias("keep"))
    gone = occ.select("node", "doc_id", "line").join(keep, "node").where(order != F.col("keep"))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _cell(spot: Column) -> Column:
    return F.shiftrightunsigned(spot, 6).bitwiseAND(F.lit(CELLS - 1))


def _bit(spot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))


def _filter(ids: DataFrame, cell: str, set_: str) -> DataFrame:
    """(cell, set): CELLS numbers at most, whose bits tell which ids may be among these; sometimes yes wrongly, never no wrongly."""
    spot = F.xxhash64(ids.columns[0])
    return ids.groupBy(_cell(spot).alias(cell)).agg(F.bit_or(_bit(spot)).alias(set_))


def _cut(docs: DataFrame, least: int, percent: int, bits: int | None) -> tuple[DataFrame, Column, Column]:
    """docs with the numbers of the lines to remove, that column, and the text without them. Documents that a filter of the ids knows to lose
    nothing are not joined, so their texts stay where they are read."""
    key, gone, cell, set_ = free(docs, "gone_id", "gone_lines", "gone_cell", "gone_bits")
    lines = removals(docs, least=least, percent=percent, bits=bits).select(F.col("doc_id").alias(key), F.col("lines").alias(gone))
    maybe = F.broadcast(_filter(lines.select(key), cell, set_))
    spot = F.xxhash64(F.col("doc_id").cast("long"))
    told = docs.join(maybe, _cell(spot) == F.col(cell), "left").withColumn(set_, F.coalesce(F.col(set_).bitwiseAND(_bit(spot)) != 0, F.lit(False)))
    cut = told.where(F.col(set_)).join(lines, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    whole = told.where(~F.col(set_)).withColumn(gone, F.lit(None).cast(lines.schema[gone].dataType))
    columns = [F.col(f"`{c}`") for c in (*docs.columns, gone)]
    joined = cut.select(*columns).union(whole.select(*columns))  # only texts that are cut, and few others, are shuffled
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i.cast("long")))
    return joined, F.col(gone), F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, *, least: int = 5, percent: int = 80, bits: int | None = DISTANCE, drop_emptied: bool = False) -> DataFrame:
    """The documents without repeated lines, with all their columns; n_chars, where there is one, is that of the new text.

    Lines are cut at line feeds and compared by their normalised words (see above). Lines of fewer than `least` words stay; with 0,
    lines without a word but not blank are compared too, as they are. Two lines are linked if they are equal, or if their edit
    distance is at most 100 - percent per cent of the longer one and, unless bits is None, their SimHashes differ in at most that
    many bits. Of each connected group the occurrence with the smallest (doc_id, line)
    stays. Every document stays, with an empty text if all its lines went, unless drop_emptied: then those go that lines were cut
    from and that have nothing but white space left. A null text stays null. Null ids come last; rows of
    one id count as one document, so of repeated rows all keep or lose a line together. Further columns may have any name.
    """
    joined, gone, text = _cut(docs, least, percent, bits)
    if drop_emptied:
        joined = joined.where(gone.isNull() | F.col("text").isNull() | text.rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": text}
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("bigint", "int"):
        new["n_chars"] = F.coalesce(F.when(gone.isNotNull(), F.char_length(text)).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, *, least: int = 5, percent: int = 80, bits: int | None = DISTANCE) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that dedup_lines() leaves; a null text is empty, and has no lines)."""
    joined, gone, text = _cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, percent, bits)
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    return joined.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.array_size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
