"""Shards by murmur3 of the id, compatible with what clients outside Spark compute."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def murmur3_32(data: bytes, seed: int = 0) -> int:
    return int(_hash_padded(np.frombuffer(data + b"\0" * (-len(data) % 4), np.uint8)[None, :], np.array([len(data)]), seed)[0])


def _hash_padded(block: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Public-domain murmur3 (x86, 32 bit) of rows of bytes, zero-filled to a multiple of four."""
    rotate = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    scramble = lambda k: rotate(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = np.full(len(length), seed, np.uint32)
    words = np.ascontiguousarray(block).view("<u4") if block.shape[1] else np.zeros((len(length), 0), np.uint32)
    for i in range(words.shape[1]):
        whole, part = length >= 4 * (i + 1), (length > 4 * i) & (length < 4 * (i + 1))
        k = scramble(words[:, i])
        mixed = rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = np.where(whole, mixed, np.where(part, h ^ k, h)).astype(np.uint32)
    h = h ^ length.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def murmur3_array(ids: pa.Array) -> np.ndarray:
    """Hashes of a string or binary array, by groups of lengths; null as empty."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    ids = pc.fill_null(ids.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
    data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
    length = np.diff(offsets)
    out = np.zeros(len(ids), np.uint32)
    words = (length + 3) // 4
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        width = int(w) * 4
        at = offsets[rows][:, None] + np.arange(width)
        inside = np.arange(width) < length[rows][:, None]
        block = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)
        out[rows] = _hash_padded(block, length[rows], 0)
    return out


@F.pandas_udf(LongType())
def murmur3(ids: pd.Series) -> pd.Series:
    return pd.Series(murmur3_array(pa.array(ids, pa.large_string())).astype(np.int64))


def shard(metric_id: Column, shards: int) -> Column:
    """Shard of a metric id."""
    return (murmur3(metric_id) % shards).cast("int")


def aggregated_shard(prefix: Column, metric_id: Column, suffix: Column, shards: int) -> Column:
    """Shard of an output row: of its full id."""
    return shard(F.concat(prefix, metric_id, suffix), shards)


def no_shard() -> Column:
    """For sinks without shards."""
    return F.lit(0)


def shard_set(spec: str | int | Iterable) -> set[int]:
    """Shards of ``5``, ``0..63`` or a list of these."""
    if isinstance(spec, int):
        return {spec}
    if isinstance(spec, str):
        if m := re.fullmatch(r"\s*(\d+)\s*\.\.\s*(\d+)\s*", spec):
            first, last = int(m[1]), int(m[2])
            if first > last:
                raise ValueError(f"an empty range: {spec!r}")
            return set(range(first, last + 1))
        if re.fullmatch(r"\s*\d+\s*", spec):
            return {int(spec)}
        raise ValueError(f"not a set of shards: {spec!r}")
    return set().union(*map(shard_set, spec))
