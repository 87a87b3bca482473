"""Linear text classifiers over hashed n-gram indicators scaled by naive Bayes log-count ratios.

Two trainers share the features: a logistic one and the dual coordinate descent of the linear
support vector machine. Models are trained on the driver from a bounded sample of labelled texts
(the bound is a parameter) and are arrays of a fixed size, whatever the corpus. Every hashed n-gram
that tells the classes apart is a feature; the sample's matrix is held as four bytes for each n-gram
of each text, as the value of an entry is the ratio of its column. Scoring goes over all rows and
whole texts, in chunks of a bounded size.

Defined results: texts without features (null and empty ones among them) have the score of the bias;
equal texts have equal scores; texts of any length are scored whole; an empty table gives an empty
result; without labelled texts of both classes every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import slices

BITS = 19
SMOOTHING = 1.0
MIN_ROWS = 4
MIN_Z = {"toxicity": 4.0, "quality": 3.0}  # of the ratio against its standard error; by cross-validation within the rows learned from

#: Kinds of words for n-grams over word classes.
LOWER_CASE, CAPITAL, UPPER_CASE, NUMBER, MARKS, SYMBOLS, REPEATED, OTHER = range(1, 9)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]=\\^~_@")] = True
#: By code point below U+2000: its lower case, where that is one character; white space as a space.
_LOWER = np.array([32 if c in (9, 10, 11, 12, 13) else ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x2000)], np.uint32)


def _grams_of(code: np.ndarray, border: np.uint64, offsets: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hashed n-gram) of the codes of some texts, with a border before and after each."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)  # one border after each text, one before the first
    padded = np.full(at[-1] + 1, border)
    inside = np.ones(len(padded), bool)
    inside[at] = False
    padded[inside] = code
    which = np.repeat(np.arange(n), np.diff(at))
    for size in sizes:
        h = K.gram_hashes(padded, size)
        if not len(h):
            continue
        first, last = which[:len(h)], at[1:]
        # runs that reach past the border behind their text are not n-grams of it
        keep = np.arange(len(h)) + size - 1 <= last[first]
        yield first[keep], (h[keep] >> np.uint64(64 - BITS)).astype(np.int64)


def char_grams(sizes: tuple[int, ...]) -> Callable:
    """n-grams of characters (code points) in lower case; the start and the end of a text count as white space, and so does every white space."""
    border = K.mix(np.array([32], np.uint64))[0]

    def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        small = points < len(_LOWER)
        points = np.where(small, _LOWER[np.where(small, points, 0)], points)
        yield from _grams_of(K.mix(points.astype(np.uint64)), border, at, sizes)

    return grams


def byte_grams(sizes: tuple[int, ...]) -> Callable:
    """n-grams of bytes as they are; white space as in :func:`char_grams`."""
    table = np.arange(256, dtype=np.uint8)
    table[K.SPACE] = 32
    code = K.BYTE_CODE[table]

    def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from _grams_of(code[data], code[32], offsets, sizes)

    return grams


def class_grams(sizes: tuple[int, ...]) -> Callable:
    """n-grams of word classes: case, marks, symbols, and whether a word is the one before it again."""

    def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts, ends, firsts = K.words(data, offsets)
        if not len(starts):
            return
        count = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[ends] - c[starts]
        upper, lower = count((data >= 65) & (data <= 90)), count(((data >= 97) & (data <= 122)) | (data >= 128))
        symbols, digits = count(_SYMBOL[data]), count((data >= 48) & (data <= 57))
        kind = np.full(len(starts), OTHER, np.uint64)
        kind[lower > 0] = LOWER_CASE
        kind[(lower > 0) & (upper > 0)] = CAPITAL
        kind[(upper > 1) & (lower == 0)] = UPPER_CASE
        kind[(digits > 0) & (upper + lower == 0)] = NUMBER
        kind[(upper + lower + digits == 0)] = MARKS
        kind[symbols > 0] = SYMBOLS
        h = K.word_hashes(data, starts, ends, lower=True)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[firsts[:-1][firsts[:-1] < len(same)]] = False
        kind[same] = REPEATED
        which = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        for size in sizes:
            g = K.gram_hashes(kind + np.uint64(1 << 40), size)
            if len(g):
                keep = which[:len(g)] == which[size - 1:]
                yield which[:len(g)][keep], (g[keep] >> np.uint64(64 - BITS)).astype(np.int64)

    return grams


FEATURES: dict[str, list[Callable]] = {
    "toxicity": [char_grams((4, 5, 6))],
    "quality": [byte_grams((2, 3, 4)), class_grams((1, 2, 3))],
}


def indicators(kind: str, texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row from the first on, feature) of the distinct features of each text."""
    for lo, hi, data, offsets in K.chunks(texts):
        keys = []
        for grams in FEATURES[kind]:
            for which, feature in grams(data, offsets):
                if wanted is not None:
                    keep = wanted[feature]
                    which, feature = which[keep], feature[keep]
                keys.append((which << BITS) | feature)
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield lo, hi, key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    kind: str
    weights: np.ndarray  # float32, by feature; 0 for those that don't count
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None  # the score where nothing could be learned

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        wanted = self.weights != 0
        for lo, hi, row, feature in indicators(self.kind, texts, wanted):
            out[lo:hi] = np.bincount(row, self.weights[feature].astype(float), hi - lo)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * (out + self.bias) + self.shift, -40, 40)))


def log_count_ratios(kind: str, texts: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each hashed feature, and whether it is one to keep.

    Kept are features of several texts whose ratio is far from 0 against its standard error.
    """
    one, zero = np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)
    for lo, _, row, feature in indicators(kind, texts):
        y = label[row + lo].astype(bool)
        one += np.bincount(feature[y], minlength=1 << BITS)
        zero += np.bincount(feature[~y], minlength=1 << BITS)
    ratio = np.log(one / (label.sum() + 2 * SMOOTHING)) - np.log(zero / ((1 - label).sum() + 2 * SMOOTHING))
    z = np.abs(ratio) / np.sqrt(1 / one + 1 / zero)
    keep = (one + zero - 2 * SMOOTHING >= MIN_ROWS) & (z >= MIN_Z[kind])
    return ratio, keep


@dataclass
class Matrix:
    """The kept features of each text of a sample; an entry's value is its column's ratio."""

    label: np.ndarray
    indptr: np.ndarray
    col: np.ndarray  # int32
    chosen: np.ndarray  # by column: the hashed n-gram
    ratio: np.ndarray  # by column

    def margins(self, w: np.ndarray) -> np.ndarray:
        """The product with weights by column."""
        scaled, out = self.ratio * w, np.zeros(len(self.label))
        for lo in range(0, len(out), 256):
            cut = self.indptr[lo:lo + 257]
            x = np.append(scaled[self.col[cut[0]:cut[-1]]], 0.0)
            out[lo:lo + 256] = np.add.reduceat(x, cut[:-1] - cut[0]) * (np.diff(cut) > 0)
        return out

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """The product of the transposed matrix with numbers by text."""
        out = np.zeros(len(self.ratio))
        for lo in range(0, len(g), 256):
            cut = self.indptr[lo:lo + 257]
            out += np.bincount(self.col[cut[0]:cut[-1]], np.repeat(g[lo:lo + 256], np.diff(cut)), len(out))
        return self.ratio * out


def _prepare(kind: str, sample: list[tuple[str, int]]) -> Matrix | None:
    label = np.array([y for _, y in sample])
    if not len(sample) or label.min() == label.max():
        return None
    texts = pa.array([t for t, _ in sample], pa.large_string())
    ratio, keep = log_count_ratios(kind, texts, label)
    chosen = np.flatnonzero(keep)
    if not len(chosen):
        return None
    new = np.full(1 << BITS, -1, np.int32)
    new[chosen] = np.arange(len(chosen))
    cols, sizes = [], []
    for lo, hi, row, feature in indicators(kind, texts, keep):  # by row
        cols.append(new[feature])
        sizes.append(np.bincount(row, minlength=hi - lo))
    col = np.concatenate(cols)
    del cols
    return Matrix(label, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), col, chosen, ratio[chosen].astype(np.float32))


def _constant(kind: str, sample: list[tuple[str, int]]) -> Model:
    """Where no sample, one class only or no telling feature is there: the share of label 1 for every text."""
    share = (sum(y for _, y in sample) + 1) / (len(sample) + 2)
    return Model(kind, np.zeros(1 << BITS, np.float32), 0.0, constant=share)


def _model(kind: str, w: np.ndarray, bias: float, m: Matrix, **more: float) -> Model:
    weights = np.zeros(1 << BITS, np.float32)
    weights[m.chosen] = w * m.ratio
    return Model(kind, weights, bias, **more)


def minimise(f: Callable, x: np.ndarray, rounds: int, near: float, memory: int = 8) -> np.ndarray:
    """A minimum of ``f`` (value and gradient) by limited-memory quasi-Newton steps; ends when the gradient is ``near`` its start's share."""
    value, grad = f(x)
    first = np.linalg.norm(grad)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(grad) <= near * first:
            break
        d, back = -grad, []
        for s, y in reversed(steps):
            back.append(s @ d / (y @ s))
            d = d - back[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(steps, reversed(back), strict=True):
            d = d + (a - y @ d / (y @ s)) * s
        length = 1.0 if steps else 1 / max(first, 1e-12)
        while True:
            new, new_grad = f(x + length * d)
            if new <= value + 1e-4 * length * (grad @ d) or length < 1e-10:
                break
            length /= 2
        s, y = length * d, new_grad - grad
        if y @ s > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-memory:]
        x, value, grad = x + s, new, new_grad
    return x


def train_logistic(kind: str, sample: list[tuple[str, int]], decay: float = 3e-4, rounds: int = 100, near: float = 1e-3) -> Model:
    """Logistic regression on the scaled indicators."""
    m = _prepare(kind, sample)
    if m is None:
        return _constant(kind, sample)
    n = len(m.label)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = x[:-1], m.margins(x[:-1]) + x[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - m.label) / n
        return float((np.logaddexp(0, z) - m.label * z).mean() + decay / 2 * (w @ w)), np.append(m.gradient(g) + decay * w, g.sum())

    x = minimise(loss, np.zeros(len(m.chosen) + 1), rounds, near)
    return _model(kind, x[:-1], float(x[-1]), m)


def dual_coordinate_descent(m: Matrix, cost: float, rounds: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights (the bias last) of the linear machine with hinge loss on ``rows``: one dual variable after the other."""
    y, d = np.where(m.label == 1, 1.0, -1.0), len(m.chosen)
    w, alpha = np.zeros(d + 1), np.zeros(len(y))
    rows = np.arange(len(y)) if rows is None else rows
    square = np.array([1 + float((m.ratio[m.col[a:b]] ** 2).sum(dtype=float)) for a, b in zip(m.indptr[:-1], m.indptr[1:], strict=True)])
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(rows):
            c = m.col[m.indptr[i]:m.indptr[i + 1]]
            x = m.ratio[c]
            g = y[i] * (x @ w[c] + w[d]) - 1
            step = min(max(alpha[i] - g / square[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[c] += step * y[i] * x
                w[d] += step * y[i]
                worst = max(worst, abs(step) * square[i])
        if worst < 1e-3:
            break
    return w


def train_svm(kind: str, sample: list[tuple[str, int]], cost: float = 0.02, rounds: int = 30) -> Model:
    """Hinge-loss machine on the scaled indicators; a sigmoid over the margins of texts left out gives the score."""
    m = _prepare(kind, sample)
    if m is None:
        return _constant(kind, sample)
    fold = np.arange(len(m.label)) % 5 == 4
    w = dual_coordinate_descent(m, cost, rounds, np.flatnonzero(~fold))
    margin = m.margins(w[:-1]) + w[-1]
    slope, shift = _sigmoid(margin[fold], m.label[fold]) if len(set(m.label[fold])) == 2 else (1.0, 0.0)
    w = dual_coordinate_descent(m, cost, rounds)
    return _model(kind, w[:-1], float(w[-1]), m, slope=slope, shift=shift)


def _sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the labels, by Newton's method with smoothed targets."""
    one, zero = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (one + 1) / (one + 2), 1 / (zero + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text; a null text is scored as an empty one.

    A column of the name ``name`` is replaced, all others stay.
    """
    keep = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: an array of a fixed size
    at = keep.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, at):
            got = model.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    return keep.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema] + [f"`{name}` double"]))
