"""Vectorised text primitives over the UTF-8 buffers of Arrow batches.

Everything here works on slices of about a megabyte, so the working set of a task does not grow
with the batch, the partition or the corpus. Hashes are polynomials modulo 2**64 over a random
byte table, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_GOLDEN = U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word [^\x20\x09-\x0D].
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a word for matching across punctuation: letters, digits and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def salt(i: int) -> np.uint64:
    """The i-th of a series of constants; odd for odd i."""
    return U(int(_GOLDEN) * i & (1 << 64) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, _P_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Prefix:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, buf: np.ndarray):
        self.up, self.down = _powers(max(20, int(len(buf)).bit_length()))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if bufs[1] is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes (one row at least): first row, last row + 1, bytes, offsets."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = kind[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    start = np.flatnonzero(m & (~before | edge[:-1]))
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Prefix(buf)(start, end) if len(start) else np.zeros(0, np.uint64)


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the rows' offsets into them.

    A row with fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    out, at = [], np.zeros(rows + 1, np.int64)
    if len(hashes) >= size:
        span = len(hashes) - size + 1
        long = np.zeros(span, np.uint64)
        for k in range(size):
            long = (long + hashes[k : k + span]) * salt(2 * k + 1)
        long = mix(long)
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.unique(long[a : b - size + 1])
        elif b > a:
            short = U(b - a)
            with np.errstate(all="ignore"):
                for x in hashes[a:b]:
                    short = (short + x) * salt(65)
            own = mix(np.array([short], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        at[i + 1] = at[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at


def lists(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
