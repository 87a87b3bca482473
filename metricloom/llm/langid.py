"""Language labels for spans of mixed text.

A model has, for each language, log-probabilities of hashed character n-grams inside words, and the
scripts in which the language is written. For each word the script ranges of its letters narrow the
languages that come into question; the n-grams score these. A Viterbi pass with a fixed price for
each change of language then labels all words of a text.

The model is fitted on the driver from a bounded sample of texts with a known language (the bound is
a parameter); labels are given to every word of every text.

Defined results: a text that is null, empty or without letters has no spans and the language ``und``
with score 0; so has every text if no language could be learned. Ties go to the language first in
the alphabet. Very long texts are labelled whole; repeated rows get equal results, one for each; an empty
table gives an empty result; columns with the names of new ones are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_mod, one_row_each, picked, slices

SAMPLE_ROWS = 4000
BITS = 16
SIZES = (1, 2, 3, 4)
SMOOTHING = 0.5
SWITCH_PRICE = 12.0
UNKNOWN = "und"

#: Ranges of code points by script (letters and the marks between them).
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x481), (0x48A, 0x52F)],
    "Armenian": [(0x531, 0x556), (0x561, 0x587)],
    "Hebrew": [(0x5D0, 0x5EA)],
    "Arabic": [(0x620, 0x64A), (0x671, 0x6D3), (0x750, 0x77F)],
    "Devanagari": [(0x904, 0x939), (0x958, 0x961)],
    "Bengali": [(0x985, 0x9B9)],
    "Tamil": [(0xB85, 0xBB9)],
    "Thai": [(0xE01, 0xE30)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3041, 0x3096), (0x30A1, 0x30FA)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
}
_NAMES = list(SCRIPTS)
_RANGES = sorted((a, b, i) for i, name in enumerate(_NAMES) for a, b in SCRIPTS[name])
_BOUNDS = np.array([x for a, b, _ in _RANGES for x in (a, b + 1)], np.uint32)
_OWNERS = np.array([-1] + [x for _, _, i in _RANGES for x in (i, -1)], np.int8)
_TABLE = _OWNERS[np.searchsorted(_BOUNDS, np.arange(0x3000, dtype=np.uint32), "right")]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The number of each code point's script; -1 for none."""
    out = np.full(len(points), -1, np.int8)
    low = points < 0x3000
    out[low] = _TABLE[points[low]]
    if not low.all():
        out[~low] = _OWNERS[np.searchsorted(_BOUNDS, points[~low], "right")]
    return out


@dataclass
class Words:
    """The words of some texts: code point spans, letters, script, and per text the first word."""

    points: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    starts, ends, firsts = K.words(np.minimum(points, 255).astype(np.uint8), at)
    script = scripts_of(points)
    total = np.concatenate(([0], np.cumsum(script >= 0)))
    letters = total[ends] - total[starts]
    # the script of a word's first letter
    of_letter = np.flatnonzero(script >= 0)
    first = of_letter[np.minimum(np.searchsorted(of_letter, starts), max(0, len(of_letter) - 1))] if len(of_letter) else starts * 0
    owner = np.where(letters > 0, script[first] if len(script) else -1, -1)
    return Words(points, at, starts, ends, firsts, letters, owner)


def word_grams(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hashed n-gram) of the n-grams within words; A-Z counts as a-z, other than letters as a border."""
    points = w.points.astype(np.uint64)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    code = K.mix(points + np.where(upper, np.uint64(32), np.uint64(0)))
    word = np.full(len(points), -1)
    lengths = w.ends - w.starts
    inside = np.repeat(w.starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    word[inside] = np.repeat(np.arange(len(w.starts)), lengths)
    # white space becomes one border before and after each word: it is there in the text except at its ends
    code[word < 0] = np.uint64(1)
    for n in SIZES:
        h = K.gram_hashes(code, n)
        if not len(h):
            continue
        if n == 1:
            keep = word >= 0
            yield word[keep], (h[keep] >> np.uint64(64 - BITS)).astype(np.int64)
            continue
        left, right = word[:len(h)], word[n - 1:]
        # in one word, or with one border at the side
        inner = (left == right) & (left >= 0)
        head = (left < 0) & (word[1:1 + len(h)] == right) & (right >= 0)
        tail = (right < 0) & (word[n - 2:n - 2 + len(h)] == left) & (left >= 0)
        keep = inner | head | tail
        yield np.where(left >= 0, left, right)[keep], (h[keep] >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # sizes x 2**BITS x languages: log-probabilities against their mean
    writes: np.ndarray  # scripts + 1 x languages: whether a language comes into question; the last row: no letter

    def word_scores(self, w: Words) -> np.ndarray:
        """Words x languages; words without letters score 0 everywhere."""
        out = np.zeros((len(w.starts), len(self.languages)))
        for k, (word, gram) in enumerate(word_grams(w)):
            got = self.weights[k][gram]
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(word, got[:, j], len(out))
        out /= len(SIZES)
        out[~self.writes[w.script]] = -50.0  # not None: a text may have nothing but such words
        out[w.letters == 0] = 0.0
        return out


def viterbi(scores: np.ndarray, price: float) -> np.ndarray:
    """The best label of each word if each change of label costs ``price``.

    Most texts keep one language. That is best for sure if, against the language with the best sum,
    no other gains more than one price over any run of words, nor two together at the start and the
    end; else the full pass decides.
    """
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0), 0)
    if (gain - low).max() <= price and max(0.0, gain.max()) + (gain[-1] - np.minimum(gain.min(0), 0)).max() <= price:
        return np.full(n, best)
    back = np.empty((n, k), np.int32)
    v = np.zeros(k)
    own = np.arange(k)
    for t in range(n):
        top = int(v.argmax())
        switch = v < v[top] - price
        back[t] = np.where(switch, top, own)
        v = np.where(switch, v[top] - price, v) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(v.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def train(sample: list[tuple[str, str]]) -> Model:
    """A model of (text, language) pairs: smoothed multinomials of hashed n-grams, each language with its scripts."""
    languages = sorted({lang for _, lang in sample})
    counts = np.full((len(SIZES), 1 << BITS, max(1, len(languages))), SMOOTHING)
    letters = np.zeros((len(_NAMES) + 1, max(1, len(languages))))
    for j, lang in enumerate(languages):
        texts = pa.array([t for t, x in sample if x == lang], pa.large_string())
        for _, _, data, offsets in K.chunks(texts):
            w = words_of(data, offsets)
            for k, (_, gram) in enumerate(word_grams(w)):
                counts[k, :, j] += np.bincount(gram, minlength=1 << BITS)
            letters[:, j] += np.bincount(w.script, w.letters, len(_NAMES) + 1) if (w.script >= 0).all() else np.bincount(w.script[w.script >= 0], w.letters[w.script >= 0], len(_NAMES) + 1)
    logs = np.log(counts / counts.sum(1, keepdims=True))
    logs -= logs.mean(2, keepdims=True)
    writes = letters >= 0.01 * np.maximum(1, letters.sum(0))
    writes[~writes.any(1)] = True  # a script that nobody is known to write excludes nobody
    return Model(languages, logs.astype(np.float32), writes)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the texts in ``docs`` that have a language and aren't held out; ``rows`` of them at most."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = [r.doc_id for r in picked(known.select("doc_id").distinct(), F.col("doc_id"), rows).collect()]
    if not ids:
        return train([])
    pick = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    got = one_row_each(known.select("doc_id", "text", "lang").join(F.broadcast(pick), "doc_id"), rows).collect()
    return train([(r.text, r.lang) for r in sorted(got, key=lambda r: (r.doc_id, r.lang, r.text))])


def label(docs: DataFrame, model: Model, price: float = SWITCH_PRICE, text: str = "text", spans: bool = True, with_text: bool = True) -> DataFrame:
    """``docs`` (without the texts, if they are not to travel back) with lang_pred, score and lang_spans.

    ``lang_spans`` lists (start, end, lang) over code points, one for each run of words with one
    label. ``lang_pred`` is the language with most letters, ``score`` its share of all letters. Columns
    of these names are replaced; all others stay.
    """
    keep = docs.drop("lang_pred", "score", "lang_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # an array of a fixed size for each language
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    at = keep.columns.index(text)
    places = [i for i in range(len(keep.columns)) if with_text or i != at]
    titles = [keep.columns[i] for i in places] + ["lang_pred", "score"] + ["lang_spans"] * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = model.languages
        for batch in slices(batches, at):
            column = batch.column(at)
            out: list[tuple[str, float, list]] = [(UNKNOWN, 0.0, [])] * len(column)
            if names:
                for lo, _, data, offsets in K.chunks(column):
                    w = words_of(data, offsets)
                    scores = model.word_scores(w)
                    for i in range(len(offsets) - 1):
                        a, b = w.firsts[i], w.firsts[i + 1]
                        letters = w.letters[a:b]
                        total = letters.sum()
                        if total:
                            path = viterbi(scores[a:b], price)
                            share = np.bincount(path, letters, len(names))
                            top = int(share.argmax())
                            out[lo + i] = names[top], float(share[top] / total), _runs(path, w.starts[a:b] - w.offsets[i], w.ends[a:b] - w.offsets[i], names) if spans else []
                        elif any(map(str.isalpha, column[lo + i].as_py() or "")):
                            out[lo + i] = names[0], 1 / len(names), []  # letters of no script listed: nothing to choose by
            made = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            if spans:
                made.append(pa.array([x[2] for x in out], span))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], *made], names=titles)

    schema = [f"`{keep.schema[i].name}` {keep.schema[i].dataType.simpleString()}" for i in places] + ["lang_pred string", "score double"]
    if spans:
        schema.append("lang_spans array<struct<start:int,end:int,lang:string>>")
    return keep.mapInArrow(run, ", ".join(schema))


def _runs(path: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: list[str]) -> list[dict]:
    cut = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)]))
    return [{"start": int(starts[a]), "end": int(ends[b - 1]), "lang": names[path[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)]
