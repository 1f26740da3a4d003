"""Text columns of Arrow batches as byte blocks, and polynomial hashes of spans of them.

Every function works on a whole block (many texts end to end), so the cost is a few NumPy passes a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block takes some 100 bytes of memory a byte while it is worked on.
BLOCK_BYTES = 1 << 19
_MULT, _SEED = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z in lower case, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int, cache: dict = {}) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    got = cache.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        cache[base] = got
    return got[:n]


INVERSE = pow(_MULT, -1, 1 << 64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums from which ``span_hashes`` gets the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(_MULT, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_SEED))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over blocks of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # the bytes under a null are not defined
        length = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if (length != np.diff(at)).any():
            keep = np.repeat(np.asarray(column.is_valid()), np.diff(at))
            data, at = data[at[0] : at[-1]][keep], np.concatenate([[0], np.cumsum(length)])
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
    release()


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not the GNU C library
        return lambda _: 0


_TRIM = _trimmer()


def release() -> None:
    """Give freed memory back: a worker process lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True that cross no text's end."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    now = np.zeros(n + 1, bool)
    now[:n] = inside
    return np.flatnonzero(now & (~before | cut)), np.flatnonzero(before & (~now | cut))


def apart_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, limit: int = BLOCK_BYTES) -> np.ndarray:
    """``span_hashes`` of table[data] for spans that stand one after the other, a stretch of ``limit`` bytes at a time.

    A very long text thus takes the memory of its spans, not of prefix sums over all its bytes.
    """
    raw = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), limit):
        piece = table[data[a : a + limit]]
        prefix, b = prefix_hashes(piece), a + len(piece)
        some = slice(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b)))
        s, e = np.maximum(starts[some] - a, 0), np.minimum(ends[some] - a, len(piece))
        part = (prefix[e] - prefix[s]) * powers(INVERSE, len(prefix))[s]
        if len(part) and starts[some][0] < a:  # goes on from the stretch before
            part[:1] *= np.uint64(pow(_MULT, a - int(starts[some][0]), 1 << 64))
        raw[some] += part
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_SEED))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word - lower-cased bytes between white space - and each text's first word's number."""
    starts, ends = runs(~SPACE[data], offsets)
    return apart_hashes(data, starts, ends, LOWER), starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (all its words where it has fewer), text after text, and their offsets."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(n)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    total = np.zeros(len(words), np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * _MULT & _MASK
        total[: len(words) - j] += words[j:] * np.uint64(factor)
    pick = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    out = mix(total[pick])
    for i in np.flatnonzero((count > 0) & (count < k)):
        value = 0
        for h in words[first[i] : first[i + 1]].tolist():
            value = (value * _MULT + h + _SEED) & _MASK
        out[at[i]] = mix(np.array([value ^ int(count[i])], np.uint64))[0]
    return out, at
