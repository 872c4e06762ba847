"""Vectorised text primitives shared by the operators: words, word hashes and shingles.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lowered; every function works on the
UTF-8 bytes of an Arrow string column, so no Python string is built per word.  Texts are taken in chunks of whole
documents (`chunks`), which bounds memory by `CHUNK_BYTES` or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
#: For work with rolling sums, of which a byte takes 16.
ROLLING_BYTES = 1 << 20
SHINGLE = 5

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
#: A random odd number for each byte; white space counts as nothing.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[WS] = 0
_BASE = np.uint64(int(_rng.integers(2**62, 2**63)) * 2 + 1)
_STEP = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(2**61, 2**62, SHINGLE)]
_POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about `most` bytes."""
    data, at = raw(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a class within texts, and where each text's begin (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = solid[data]
    filled = at[:-1] < at[1:]
    first, last = at[:-1][filled], at[1:][filled] - 1
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text where its words begin in those (one more at the end)."""
    return runs(data, at, ~WS)


#: Sums of powers modulo 2^64 tell texts of so many bytes apart but by chance; of longer ones, some made-up pairs (such as
#: a Thue-Morse word and its complement) have equal sums, so those get a cryptographic hash.
SUMMED = 200


def long_hash(data: np.ndarray, salt: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin, stop = int(starts[0]), int(ends[-1])
    spans = np.diff(starts, append=stop)
    place = np.arange(stop - begin, dtype=np.int32) - np.repeat((starts - begin).astype(np.int32), spans)
    table = _BYTE[LOWER] if lower else _BYTE
    value = table[data[begin:stop]] * powers(int(spans.max()))[place]
    out = mix(np.add.reduceat(value, starts - begin) + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > SUMMED).tolist():
        word = data[starts[k] : ends[k]]
        out[k] = long_hash(LOWER[word] if lower else word)
    return out


def shingles(word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of each text, not yet distinct, and where each text's begin.

    A text of one to four words has one, of all its words; a text without words has none.
    """
    n = np.diff(of)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    total = int(to[-1])
    if not total:
        return np.zeros(0, np.uint64), to
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    place = np.arange(total) - np.repeat(to[:-1] - of[:-1], count)
    out = np.zeros(total, np.uint64)
    size = np.repeat(np.minimum(n, SHINGLE), count)
    for t in range(SHINGLE):
        part = padded[place + t] * _STEP[t]
        out += part if t == 0 else np.where(size > t, part, 0)
    return mix(out + size.astype(np.uint64)), to


def crc_of_decimal(column_name: str):
    """crc32 of an id written as decimal text, as a Spark column."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column_name).cast("string").cast("binary"))


_ROLL = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BACK = np.ones(1, np.uint64)


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and factors from which span() has a hash of any span of the bytes."""
    global _BACK
    n = len(data)
    if len(_BACK) < n + 1:
        p = np.full(max(n + 1, 1 << 16), _INVERSE, np.uint64)
        p[0] = 1
        _BACK = np.cumprod(p, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_ROLL[data] * powers(n)[:n], dtype=np.uint64, out=sums[1:])
    return sums, _BACK[: n + 1]


def span(data: np.ndarray, table: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of spans of the data, of which the table is rolling(data); equal for equal bytes wherever they are."""
    sums, back = table
    out = mix((sums[ends] - sums[starts]) * back[starts] + ((ends - starts) * 8 + salt).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > SUMMED).tolist():
        out[k] = long_hash(data[starts[k] : ends[k]], salt)
    return out


#: A group's rows of so many bytes are worth giving memory back for.
RELEASE_BYTES = 1 << 20
_libc = None


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of other stages."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        import ctypes

        _libc = ctypes.CDLL(None)
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def freed(work):
    """A function for mapInArrow() or applyInArrow() that releases what it freed."""
    import inspect

    def batches(rows):
        try:
            yield from work(rows)
        finally:
            release()

    def settled(out, *tables):
        if sum(t.nbytes for t in tables) > RELEASE_BYTES:
            release()
        return out

    def group(key, table):
        return settled(work(key, table), table)

    def pair(key, left, right):
        return settled(work(key, left, right), left, right)

    needed = [p for p in inspect.signature(work).parameters.values() if p.default is p.empty]
    return {1: batches, 2: group, 3: pair}[len(needed)]
