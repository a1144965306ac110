"""Vectorised text kernels over Arrow string buffers.

Every kernel works on the UTF-8 bytes of a whole Arrow batch at once, so the
cost per word is a few numpy passes rather than Python calls.  Hashes are
64-bit: a polynomial over random byte values modulo 2**64, finished with a
multiply-xor mixer.  They identify words and shingles inside one document, a
batch or a candidate pair; where equality decides a result between documents
the operators verify on text or on two independent hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_R1 = U(0x9E3779B97F4A7C15 | 1)
_R2 = U(0xD6E8FEB86659FD93)


@lru_cache(8)
def byte_values(seed: int = 1) -> np.ndarray:
    """256 random 64-bit values, one for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


@lru_cache(2)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@lru_cache(8)
def class_table(kind: str) -> np.ndarray:
    """True where a byte belongs to a word.

    ``alnum``: digits, letters and every byte of a character beyond ASCII (the
    text must be in lower case); ``nonspace``: all but space and \\t..\\r.
    """
    t = np.zeros(256, dtype=bool)
    if kind == "alnum":
        t[48:58] = t[97:123] = t[128:] = True
    elif kind == "letters":
        t[97:123] = t[128:] = True
    else:
        t[:] = True
        t[32] = False
        t[9:14] = False
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser (xor-shift-multiply) in place of the weak low bits of a polynomial."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = U(1)
    return np.multiply.accumulate(p, dtype=np.uint64)


#: Bytes that are hashed at once.
HASHED = 1 << 17


@lru_cache(4)
def block_powers(base: int) -> np.ndarray:
    return powers(HASHED, U(base))


class Hasher:
    """Hashes of byte ranges of one buffer, worked on in blocks, so that memory does not grow with the ranges."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.data, self.values = data, byte_values(seed)
        self.base = int((_R1 if seed % 2 else _R2) + U(2 * seed))

    def _sums(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The polynomial of each range; the ranges have HASHED bytes at most, and HASHED together."""
        bounds = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
        terms = self.values[self.data[np.repeat(start, size) + place]] * block_powers(self.base)[place]
        out = np.zeros(len(start), np.uint64)
        full = np.flatnonzero(size)
        if len(full):
            out[full] = np.add.reduceat(terms, bounds[full], dtype=np.uint64)
        return out

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, size = np.asarray(start, np.int64), np.asarray(end - start, np.int64)
        out = np.empty(len(start), np.uint64)
        total, i = np.cumsum(size), 0
        while i < len(start):
            j = int(np.searchsorted(total, total[i] - size[i] + HASHED, side="right"))
            if j > i:
                out[i:j] = self._sums(start[i:j], size[i:j])
            else:  # one range of more than a block
                j, whole, factor = i + 1, 0, 1
                for a in range(int(start[i]), int(start[i] + size[i]), HASHED):
                    n = min(HASHED, int(start[i] + size[i]) - a)
                    whole = (whole + factor * int(self._sums(np.array([a]), np.array([n]))[0])) % 2**64
                    factor = factor * pow(self.base, n, 2**64) % 2**64
                out[i] = U(whole)
            i = j
        return mix(out + size.astype(np.uint64) * U(0x632BE59BD9B4E019))


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a run ends at the end of its row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cut = offs[(offs > 0) & (offs < n)]
    edge[cut] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], n)
    keep = inside[at]
    return at[keep], ends[keep]


class Words:
    """The words of every row of a batch.

    start, end: byte ranges in data; first: n + 1 offsets of the rows' words;
    hash: a 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, kind: str, lower: bool = True, seed: int = 1):
        raw, self.offs = buffers(column)
        self.data = lower_table()[raw] if lower else raw
        self.start, self.end = spans(class_table(kind)[self.data], self.offs)
        self.first = np.searchsorted(self.start, self.offs)
        self.hasher = Hasher(self.data, seed)
        self.hash = self.hasher.ranges(self.start, self.end)
        self.n = np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def text(self, a: int, b: int) -> str:
        """Words a..b - 1, with single spaces."""
        d = self.data
        return " ".join(d[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words that begin at each of len(h) - k + 1 places."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(m, U(k * 0xA24BAED4963EE407 % 2**64))
    for j in range(k):
        g = g * U(0x9FB21C651E98DF25) + h[j : j + m]
    return mix(g)


def gram_places(n: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of all k-grams that lie within one row."""
    room = np.maximum(n - k + 1, 0)
    total = int(room.sum())
    base = np.repeat(first[:-1], room)
    return base + (np.arange(total) - np.repeat(np.cumsum(room) - room, room))


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row: hashes sorted within rows, and n + 1 offsets.

    A row with fewer words, but not none, has its whole sequence as its one shingle.
    """
    rows = len(w.n)
    at = gram_places(w.n, w.first, k)
    g = grams(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(rows), np.maximum(w.n - k + 1, 0))
    for m in range(1, k):
        short = np.flatnonzero(w.n == m)
        if len(short):
            g, row = np.concatenate([g, grams(w.hash, m)[w.first[short]]]), np.concatenate([row, short])
    if len(g) > 64 * rows:  # long rows are sorted one by one, as that is faster
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
        bounds = np.searchsorted(row, np.arange(rows + 1)).tolist()
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            g[a:z].sort()
    else:
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(rows + 1))
