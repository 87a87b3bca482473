"""A merging t-digest: centroids of bounded number, mergeable, with interpolated quantiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPRESSION = 100.0


def compress(mean: np.ndarray, weight: np.ndarray, compression: float = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted neighbours as long as the scale function (an arc sine of the rank) moves by one at most."""
    if not len(mean):
        return mean, weight
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    total = weight.sum()
    right = np.cumsum(weight) / total
    scale = lambda q: compression * (math.pi / 2 + np.arcsin(2 * np.clip(q, 0, 1) - 1)) / math.pi
    upper = scale(right)
    starts, at = [0], 0
    while True:  # one step for each centroid that is made
        floor = scale(right[at - 1]) if at else 0.0
        nxt = max(at + 1, int(np.searchsorted(upper, floor + 1, "right")))
        if nxt >= len(mean):
            break
        starts.append(nxt)
        at = nxt
    w = np.add.reduceat(weight, starts)
    return np.add.reduceat(mean * weight, starts) / w, w


class TDigest:
    def __init__(self, compression: float = COMPRESSION, precision: int = 0) -> None:
        if not 20 <= compression <= 1000 or not 0 <= precision <= 16:
            raise ValueError("compression is 20 to 1000, precision 0 to 16")
        self.compression, self.precision = compression, precision
        self.mean, self.weight = np.zeros(0), np.zeros(0)
        self.low, self.high = math.inf, -math.inf

    def add(self, values, weights=None) -> TDigest:
        values = np.asarray(values, float)
        weights = np.ones(len(values)) if weights is None else np.asarray(weights, float)
        number = ~np.isnan(values)
        values, weights = values[number], weights[number]
        if len(values):
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self.mean, self.weight = compress(np.concatenate([self.mean, values]), np.concatenate([self.weight, weights]), self.compression)
        return self

    def merge(self, other: TDigest) -> TDigest:
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.mean, self.weight = compress(np.concatenate([self.mean, other.mean]), np.concatenate([self.weight, other.weight]), self.compression)
        return self

    def min(self) -> float:
        return self.low if len(self.mean) else 0.0

    def max(self) -> float:
        return self.high if len(self.mean) else 0.0

    def quantile(self, q: float) -> float:
        """Linear between the middles of neighbouring centroids, and to the extremes; NaN outside 0 to 1, 0 if empty."""
        if not 0 <= q <= 1:
            return math.nan
        if not len(self.mean):
            return 0.0
        middles = np.cumsum(self.weight) - self.weight / 2
        total = self.weight.sum()
        got = float(np.interp(q * total, [0, *middles, total], [self.low, *self.mean, self.high]))
        return math.trunc(got * 10**self.precision) / 10**self.precision if self.precision else got


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], compression: float = COMPRESSION, precision: int = 0) -> DataFrame:
    """Keys and a column for each quantile. Every task makes digests of what it has; only centroids are shuffled,
    so a key with very many rows is no problem; digests are merged by key."""
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    state = ", ".join([f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)] + ["mean array<double>, weight array<double>, low double, high double"])

    def partial(batches: Iterator) -> Iterator:
        open_: dict[tuple, TDigest] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False)[value]:
                key = key if isinstance(key, tuple) else (key,)
                open_.setdefault(key, TDigest(compression)).add(part.to_numpy(float))
            if len(open_) > 10_000:
                yield _frame(open_, keys)
                open_ = {}
        if open_:
            yield _frame(open_, keys)

    def final(pdf):
        d = TDigest(compression, precision)
        for mean, weight, low, high in zip(pdf["mean"], pdf["weight"], pdf["low"], pdf["high"], strict=True):
            other = TDigest(compression)
            other.mean, other.weight, other.low, other.high = np.asarray(mean), np.asarray(weight), low, high
            d.merge(other)
        out = pdf[keys].iloc[:1].copy()
        for name, q in qs.items():
            out[name] = d.quantile(q)
        return out

    made = df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(partial, state)
    schema = ", ".join([f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)] + [f"`{n}` double" for n in qs])
    return made.groupBy(*keys).applyInPandas(final, schema)


def _frame(open_: dict, keys: list[str]):
    import pandas as pd

    out = pd.DataFrame(list(open_), columns=keys)
    out["mean"] = [d.mean.tolist() for d in open_.values()]
    out["weight"] = [d.weight.tolist() for d in open_.values()]
    out["low"] = [d.low for d in open_.values()]
    out["high"] = [d.high for d in open_.values()]
    return out
