"""Vectorised text primitives on Arrow string columns: words, word hashes, shingles.

A chunk of documents is one byte array plus offsets, so the cost per document is a few numpy calls and memory is bounded
by the chunk (``CHUNK`` bytes, or one document if that is longer).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)

NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits of ASCII, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64; kept up to the chunk size."""
    if len(_powers[0]) <= n:
        made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, BASE_INVERSE)]
        if n > 2 * CHUNK:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def release() -> None:
    """Gives back what a worker process, which Spark uses again for other operators, still keeps."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = BASE^i times the polynomial hash of bytes i..j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _power_tables(len(data))[0][: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    inverse = _power_tables(len(prefix) - 1)[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty string."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts sum to at most ``limit`` bytes, or that hold one row."""
    _, off = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes (non-space) of each document, and the documents' offsets among them."""
    full = inside[data]
    start, end = full.copy(), full.copy()
    start[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    inner = off[1:-1]
    first = inner[inner < len(data)]
    start[first] = full[first]
    last = inner[inner > 0] - 1
    end[last] = full[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the documents' offsets among them."""
    s, e, at = words(data, off, inside)
    return range_hashes(prefix_hashes(LOWER[data]), s, e), at


SHINGLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its 5-word shingles; of all its words if there are fewer."""
    h, at = word_hashes(data, off)
    n = len(SHINGLE)
    if len(h) >= n:
        joined = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            joined += mix(h[j : len(h) - n + 1 + j] + SHINGLE[j])  * SHINGLE[(j + 2) % n]
        joined = mix(joined)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= n:
            own = np.sort(joined[lo : hi - n + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif hi > lo:
            short = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for x, k in zip(h[lo:hi], SHINGLE):
                    short = short + mix(x + k) * k
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Lookup:
    """A fixed hash table from 64-bit keys to numbers; absent keys give ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float) -> None:
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.missing = np.uint64(size - 1), missing
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.full(size, missing, values.dtype), np.zeros(size, bool)
        slot = keys & self.mask
        while len(keys):  # every round each free slot takes one key, the others move on
            free = np.flatnonzero(~self.used[slot])
            take = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[take]], self.values[slot[take]], self.used[slot[take]] = keys[take], values[take], True
            stay = np.ones(len(keys), bool)
            stay[take] = False
            keys, values, slot = keys[stay], values[stay], slot[stay] + np.uint64(1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        same = self.used[slot] & (self.keys[slot] == keys)
        out = np.where(same, self.values[slot], self.missing)
        rest = np.flatnonzero(self.used[slot] & ~same)
        while len(rest):
            slot[rest] = slot[rest] + np.uint64(1) & self.mask
            hit = self.used[slot[rest]] & (self.keys[slot[rest]] == keys[rest])
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[self.used[slot[rest]] & ~hit]
        return out
