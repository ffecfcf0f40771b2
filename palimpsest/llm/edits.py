"""Whether two texts are within an edit distance, by Myers' bit vectors: a column of the table is an addition and a few bit operations,
so long lines cost far less than cell by cell. Many pairs of about one length go through numpy together, a word of 64 rows at a time;
few pairs go side by side in one of Python's integers, very long ones one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from palimpsest.llm import words as W

#: Pairs that go together at most, for each word of a column at least, and words of a column at most.
TOGETHER, WORTH, TALL = 1024, 16, 64
#: Bytes of the integers in which pairs go side by side.
WIDE = 2048
#: Numbers in the table of a lot's signs, about; a lot of more signs is halved.
TABLE = 1 << 19
#: One more than the last code point.
SIGNS = 0x110000


def _differing(a: str, b: str) -> tuple[str, str]:
    """Both without what they share at either end."""
    i, n = 0, min(len(a), len(b))
    while i + 64 <= n and a[i : i + 64] == b[i : i + 64]:
        i += 64
    while i < n and a[i] == b[i]:
        i += 1
    j, n = 0, n - i
    while j + 64 <= n and a[len(a) - j - 64 : len(a) - j] == b[len(b) - j - 64 : len(b) - j]:
        j += 64
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j]


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance in code points is at most `most`. What both share at either end is left out, and a column from which
    the bound can no longer be kept ends the search."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _differing(a, b)
    if not a or not b:
        return len(a) + len(b) <= most
    at: dict[str, int] = {}
    for p, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << p
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    last = most + len(b)  # at column k a score above last - k cannot come down to the bound
    for k, c in enumerate(b):
        eq = at.get(c, 0)
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & top:
            score += 1
            if score > last - k - 1:
                return False
        elif mh & top:
            score -= 1
        elif score > last - k - 1:
            return False
        xv = eq | down
        ph = ph << 1 | 1
        up = (mh << 1 | ~(xv | ph)) & full
        down = ph & xv & full
    return score <= most


class Texts:
    """A column of texts by code points; a null is empty."""

    def __init__(self, column: pa.Array):
        data, off = W.buffers(column)
        self.signs = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.off = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        self.size = np.diff(self.off)

    def one(self, i: int) -> str:
        return self.signs[self.off[i] : self.off[i + 1]].tobytes().decode("utf-32-le")

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """(rows, longest): code points, SIGNS after the end."""
        out = np.full((len(rows), int(self.size[rows].max())), SIGNS, np.uint32)
        inside = np.arange(out.shape[1]) < self.size[rows][:, None]
        at = (self.off[rows][:, None] + np.arange(out.shape[1]))[inside]
        out[inside] = self.signs[at]
        return out


def _lot(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether each row of a is within most edits of that of b; m, n: lengths, all m in one number of words, none 0."""
    rows, tall, least, u1 = len(m), (int(m.max()) + 63) // 64, int(m.min()), np.uint64(1)
    seen = np.zeros(SIGNS + 1, bool)
    seen[a.ravel()] = True
    seen[SIGNS] = False
    k = int(seen.sum()) + 1  # the last number is of signs that stand in no pattern
    if rows * k * tall > TABLE and rows > WORTH:
        half = [slice(0, rows // 2), slice(rows // 2, rows)]
        return np.concatenate([_lot(a[x, : m[x].max()], m[x], b[x, : n[x].max()], n[x], most[x]) for x in half])
    code = np.full(SIGNS + 1, k - 1, np.int32)
    code[seen] = np.arange(k - 1)
    base = np.arange(rows) * k
    table = np.zeros((rows * k, tall), np.uint64)
    for i, at in enumerate((code[a] + base[:, None]).T.copy()):
        on = at if i < least else at[m > i]
        table[on, i >> 6] |= u1 << np.uint64(i & 63)
    columns = (code[b] + base[:, None]).T.copy()
    up, down = np.full((tall, rows), ~np.uint64(0)), np.zeros((tall, rows), np.uint64)
    score, end, alive = m.astype(np.int64), ((m - 1) & 63).astype(np.uint64), np.arange(rows)
    out = np.zeros(rows, bool)
    for j in range(columns.shape[0]):
        eqs = table[columns[j]]
        plus, minus = np.ones(len(alive), np.uint64), np.zeros(len(alive), np.uint64)
        for w in range(tall):
            eq, pv, mv = eqs[:, w], up[w], down[w]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if w == tall - 1:
                score += (ph >> end & u1).astype(np.int64) - (mh >> end & u1).astype(np.int64)
            next_plus, next_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = ph << u1 | plus, mh << u1 | minus
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            plus, minus = next_plus, next_minus
        done = n == j + 1
        if done.any():
            out[alive[done]] = score[done] <= most[done]
        if done.any() or j % 16 == 15:
            go = np.flatnonzero(~done & (score <= most + n - j - 1))  # a later column takes one edit off at most
            if len(go) == 0:
                break
            if len(go) <= 0.9 * len(alive):
                alive, score, end, n, most = alive[go], score[go], end[go], n[go], most[go]
                up, down, columns = up[:, go], down[:, go], columns[:, go]
    return out


def _side_by_side(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each of a is within most edits of that of b."""
    out = np.zeros(len(a), bool)
    pairs = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = _differing(x, y)
        if not x or not y:
            out[k] = len(x) + len(y) <= most[k]
        elif len(x) > 8 * WIDE:
            out[k] = within(x, y, int(most[k]))
        else:
            pairs.append((len(y), k, x, y))
    pairs.sort(key=lambda p: p[:2])
    at = 0
    while at < len(pairs):
        end, wide = at, 0
        while end < len(pairs) and (end == at or wide + len(pairs[end][2]) // 8 + 1 <= WIDE):
            wide += len(pairs[end][2]) // 8 + 1
            end += 1
        lot = pairs[at:end]
        out[[k for _, k, _, _ in lot]] = _lanes([x for _, _, x, _ in lot], [y for _, _, _, y in lot], [int(most[k]) for _, k, _, _ in lot])
        at = end
    return out


def _lanes(a: list[str], b: list[str], most: list[int]) -> list[bool]:
    """As _lot(), of pairs by the length of b: each has a lane of whole bytes with a bit at least above its rows, where sums end."""
    size, n = [len(x) for x in a], [len(y) for y in b]
    wide = [m // 8 + 1 for m in size]
    at = np.append(0, np.cumsum(wide)).tolist()
    eqs = np.zeros((n[-1], at[-1]), np.uint8)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = (np.frombuffer(z.encode("utf-32-le"), np.uint32) for z in (x, y))
        signs = np.unique(p)
        rows = np.zeros((len(signs) + 1, 8 * wide[k]), bool)
        rows[np.searchsorted(signs, p), np.arange(len(p))] = True
        code = np.minimum(np.searchsorted(signs, q), len(signs) - 1)
        eqs[: len(q), at[k] : at[k + 1]] = np.packbits(rows, axis=1, bitorder="little")[np.where(signs[code] == q, code, len(signs))]
    out, lanes, j = [False] * len(a), list(range(len(a))), 0

    def masks() -> tuple[int, int, int]:
        full = b"".join(((1 << size[k]) - 1).to_bytes(wide[k], "little") for k in lanes)
        return len(full), int.from_bytes(full, "little"), int.from_bytes(b"".join((1).to_bytes(wide[k], "little") for k in lanes), "little")

    width, full, low = masks()
    every, up, down = (1 << 8 * width) - 1, full, 0
    buf, begun, done = eqs.tobytes(), 0, 0
    while done < len(lanes):
        stop = min(n[lanes[done]], j + 48)
        for c in range((j - begun) * width, (stop - begun) * width, width):
            eq = int.from_bytes(buf[c : c + width], "little")
            xh = (((eq & up) + up) ^ up) | eq
            xv = eq | down
            ph = ((down | every ^ ((xh | up) & every)) & full) << 1 | low
            up, down = (((up & xh) << 1) | every ^ ((xv | ph) & every)) & full, ph & xv & full
        j = stop
        ups, downs = (np.frombuffer(v.to_bytes(width, "little"), np.uint8) for v in (up, down))
        edges = np.append(0, np.cumsum([wide[k] for k in lanes]))
        net = np.add.reduceat(np.bitwise_count(ups).astype(np.int64) - np.bitwise_count(downs), edges[:-1])
        go = []
        for r, k in enumerate(lanes):
            score = j + int(net[r])
            if r < done or n[k] < j:
                continue
            if n[k] == j:
                out[k] = score <= most[k]
            elif score <= most[k] + n[k] - j:  # a later column takes one edit off at most
                go.append(r)
        if sum(wide[lanes[r]] for r in go) <= 0.7 * width:
            cols = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in go]) if go else np.zeros(0, np.int64)
            eqs, begun = eqs[j - begun :, cols], j
            lanes, done = [lanes[r] for r in go], 0
            if lanes:
                width, full, low = masks()
                every, buf = (1 << 8 * width) - 1, eqs.tobytes()
                up, down = (int.from_bytes(v[cols].tobytes(), "little") for v in (ups, downs))
        else:
            while done < len(lanes) and n[lanes[done]] <= j:
                done += 1
    return out


def near(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the texts i of x and j of y, one by one, differ by at most 100 - percent per cent of the longer one."""
    m, n = x.size[i], y.size[j]
    most = np.maximum(m, n) * (100 - percent) // 100
    out = np.maximum(m, n) <= most
    left = np.flatnonzero(~out & (np.abs(m - n) <= most) & (np.minimum(m, n) > 0))
    tall = (m[left] + 63) // 64
    order = np.lexsort((n[left], tall))
    left, tall = left[order], tall[order]
    edges = np.append(np.flatnonzero(np.append(True, tall[1:] != tall[:-1])), len(tall)) if len(tall) else np.zeros(1, np.int64)
    few: list[np.ndarray] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        w = int(tall[a])
        for at in range(a, b, TOGETHER):
            pick = left[at : min(b, at + TOGETHER)]
            if w <= TALL and len(pick) >= WORTH * w:
                out[pick] = _lot(x.padded(i[pick]), m[pick], y.padded(j[pick]), n[pick], most[pick])
            else:
                few.append(pick)
    if few:
        pick = np.concatenate(few)
        out[pick] = _side_by_side([x.one(p) for p in i[pick]], [y.one(q) for q in j[pick]], most[pick])
    return out


def close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, ta, tb) the (a, b) whose texts differ by at most 100 - percent per cent of the longer one."""
    for batch in batches:
        for i in range(0, len(batch), 2048):  # few texts at a time by code points
            part = batch.slice(i, 2048)
            x, y, every = Texts(part.column(2)), Texts(part.column(3)), np.arange(len(part))
            yield part.select([0, 1]).filter(pa.array(near(x, every, y, every, percent), pa.bool_()))
