"""Vectorised numpy kernels over Arrow string columns: words, word hashes and n-gram hashes.

Everything works on chunks of a bounded number of bytes, so memory does not grow with the batch;
a text longer than a chunk makes a chunk of its own. All hashes are fixed functions of the bytes:
every executor, and every retry of a task, computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20260101))
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base of the polynomial hash (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        factors = np.full(size, _BASE_INVERSE if inverse else _BASE, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of the first word of each text (with the end)."""
    n = len(data)
    word = ~SPACE[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = word
    before[offsets] = False  # no word runs over the end of a text
    starts = np.flatnonzero(word & ~before[:n])
    after = np.empty(n + 1, bool)
    after[:n] = word
    after[offsets] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial; with A-Z lower-cased if asked for."""
    code = BYTE_CODE[LOWER[data]] if lower else BYTE_CODE[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code * powers(len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(data) + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive numbers; callers leave out the runs over two texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count] * _BASE
    for j in range(1, n):
        out += hashes[j:j + count]
        out *= _BASE
    return mix(out + np.uint64(n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` numbers, by doubling."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have
