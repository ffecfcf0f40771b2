"""Words, hashes and n-grams of whole columns of text, as numpy arrays over the bytes of an Arrow batch.

Both kinds of word are classes of ASCII bytes with every byte over 127 on one side, so splitting UTF-8 bytes splits code
points exactly. Words are compared by 64-bit hashes: two different words among a billion collide with a chance of 3 %, and a
false match of an n-gram needs a collision of the whole n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_C1, _C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: Odd multiplier of n-gram polynomials over word hashes, which are mixed already.
_R = 0x9E3779B97F4A7C15
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, over lower-cased bytes
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> U64(32))
    x *= _C1
    x ^= x >> U64(29)
    x *= _C2
    x ^= x >> U64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row: what one pass of arrays is made for. Small, so that arrays stay in
    the processor's cache and their memory is used again: fresh pages cost more than the work on them."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = kind[data]
    inner = off[(off > 0) & (off < len(data))]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    first[inner] |= m[inner]
    last[inner - 1] |= m[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight at a time; seeds give independent ones."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    h = mix((e - s).astype(U64) * U64(_R) + U64(seed))
    at, left, which = s, e - s, None
    while len(at):
        v = lanes[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            h = mix(h ^ v)
        else:
            h[which] = mix(h[which] ^ v)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, at each index where n words follow (rows are not told apart)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, done, bits, have, size = None, 0, n, h, 1
    while bits:
        if bits & 1:
            part = have[done : len(h) - n + 1 + done]
            out = part.copy() if out is None else out * U64(pow(_R, size, 1 << 64)) + part
            done += size
        bits >>= 1
        if bits:
            have = have[: len(have) - size] * U64(pow(_R, size, 1 << 64)) + have[size:]
            size *= 2
    return mix(out)


def within_rows(word_off: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether n words from each index on belong to one row; for ngrams() of total words."""
    size = max(0, total - n + 1)
    row_end = np.repeat(word_off[1:], np.diff(word_off))[:size]
    return np.arange(size) + n <= row_end


def row_of(word_off: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), off)).astype(float)


def counts(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each index, and in all."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out
