"""Removal of word windows that occur more than once, by super-k-mer partitioning.

A window is a run of consecutive words of one text. Its minimiser is the smallest hash among its
short word runs. Consecutive windows of a text that share a minimiser make a super-k-mer: it travels
as one packed string (a code for each word) to the bucket of the minimiser, where sorting brings equal
windows together and counts them exactly; equal windows always meet, as they have the same minimiser.

What travels is thinned exactly, without loss: a minimiser that occurs once has no repeated window; if
all super-k-mers of a minimiser are equal, all their windows repeat; equal super-k-mers travel once,
with their number. A bucket with very many different super-k-mers is split by window: its windows, named
by 128 bits, are counted by an aggregate that combines them before they are shuffled, so that a passage
in any number of different contexts is no hot group.

Word codes and the names of super-k-mers are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, row_key, slices, stash

WINDOW_WORDS = 35
MINIMISER_WORDS = 8
MOST_WINDOWS = 32  # of a super-k-mer; longer ones, as in periodic text, are cut
SPLIT_ABOVE = 256  # different super-k-mers of a bucket
FLUSH_WINDOWS = 20_000
SEEN = 100_000
_OTHER = np.uint64(0xA24BAED4963EE407)


class Superkmers:
    """The super-k-mers of the texts of one chunk, as arrays: text, minimiser, name, first word, windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, short: int) -> None:
        starts, ends, self.firsts = K.words(data, offsets)
        self.codes = codes = K.word_hashes(data, starts, ends)
        n = len(codes) - window + 1
        empty = np.zeros(0, np.int64)
        self.text = self.start = self.windows = self.again = empty
        self.minimiser = self.name = empty.view(np.uint64)
        if n <= 0:
            return
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.firsts))
        grams = K.gram_hashes(codes, short)
        least = K.sliding_min(grams, window - short + 1)
        inside = text[:n] == text[window - 1:]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return
        run = np.cumsum(new)[inside] - 1
        place = np.flatnonzero(inside)
        cut = place[(place - at[run]) % MOST_WINDOWS == 0]
        owner = np.searchsorted(cut, place, "right") - 1
        self.start, self.windows = cut, np.bincount(owner, minlength=len(cut))
        self.text, self.minimiser = text[cut], least[cut]
        # a minimiser that is there twice in a super-k-mer: then its own windows may be equal
        span = self.windows + window - short
        ends_at = np.cumsum(span)
        inner = np.arange(ends_at[-1]) + np.repeat(cut - (ends_at - span), span)
        self.again = (np.add.reduceat(grams[inner] == np.repeat(self.minimiser, span), ends_at - span, dtype=np.int64) > 1).astype(np.int64)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * K.powers(len(codes)), out=total[1:])
        end = cut + self.windows + window - 1
        self.name = K.mix((total[end] - total[cut]) * K.powers(len(codes) + 1, inverse=True)[cut] + self.windows.astype(np.uint64))


def _superkmer_rows(slim: DataFrame, window: int, short: int) -> DataFrame:
    """(minimiser, name, key, place) of each super-k-mer; place: first word of its text << 8 | windows,
    and 128 if the minimiser is in it more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key = batch.column(0).to_numpy()
            for lo, _, data, offsets in K.chunks(batch.column(1)):
                s = Superkmers(data, offsets, window, short)
                place = (s.start - s.firsts[s.text]) << 8 | s.again << 7 | s.windows
                yield pa.RecordBatch.from_arrays([pa.array(s.minimiser.view(np.int64)), pa.array(s.name.view(np.int64)), pa.array(key[lo + s.text]), pa.array(place)], names=["minimiser", "name", "key", "place"])

    return slim.select("key", "text").mapInArrow(run, "minimiser bigint, name bigint, key bigint, place bigint")


def _packed(wanted: DataFrame, window: int, short: int) -> DataFrame:
    """From (key, text, asked: array of (name, n, split)): (bucket, name, n, first, packed) for each super-k-mer asked for, and
    for those to be split a row without packed words for each window, named by bucket and other. A text that comes again in a task makes none."""
    schema = pa.schema([("bucket", pa.int64()), ("name", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("packed", pa.binary()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1):
            keys, asked = batch.column(0).to_pylist(), batch.column(2)
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                s = Superkmers(data, offsets, window, short)
                want = []
                for i in range(lo, hi):
                    want.append({} if keys[i] in seen else {w["name"]: w for w in asked[i].as_py()})
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(keys[i])
                rows: list[tuple] = []
                names = s.name.view(np.int64).tolist()
                for i, (text, name) in enumerate(zip(s.text.tolist(), names, strict=True)):
                    w = want[text].pop(name, None)
                    if w is None:
                        continue
                    first, count = int(s.start[i]), int(s.windows[i])
                    codes = s.codes[first:first + count + window - 1]
                    if w["split"]:
                        one, two = K.gram_hashes(codes, window).view(np.int64).tolist(), K.gram_hashes(K.mix(codes + _OTHER), window).view(np.int64).tolist()
                        rows += [(one[j], name, w["n"], j, None, two[j]) for j in range(count)]
                    else:
                        rows.append((int(s.minimiser[i].astype(np.int64)), name, w["n"], 0, codes.tobytes(), None))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return wanted.mapInArrow(run, "bucket bigint, name bigint, n bigint, first int, packed binary, other bigint")


def repeated_windows(rows: list[tuple[int, int, int, int, bytes]], window: int) -> dict[int, int]:
    """By name: a bit for each of its windows that is there twice or more. rows: whole buckets."""
    known: dict[tuple[int, int], tuple[int, bytes]] = {(name, first): (n, packed) for _, name, n, first, packed in rows}
    names, numbers, places, views = [], [], [], []
    for (name, first), (n, packed) in known.items():
        codes = np.frombuffer(packed, np.uint64)
        count = len(codes) - window + 1
        views.append(np.lib.stride_tricks.sliding_window_view(codes, window))
        names += [name] * count
        numbers += [n] * count
        places += range(first, first + count)
    content = np.ascontiguousarray(np.concatenate(views)).view(f"V{8 * window}").ravel()
    order = np.argsort(content, kind="stable")
    ordered = content[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.cumsum(new) - 1
    total = np.bincount(group, np.array(numbers)[order])
    out: dict[int, int] = {}
    for i in order[total[group] >= 2].tolist():
        out[names[i]] = out.get(names[i], 0) | 1 << places[i]
    return out


def _counted(packed: DataFrame, window: int) -> DataFrame:
    """(name, mask) from buckets that stand together."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        got = repeated_windows(rows, window) if rows else {}
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], names=["name", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        open_bucket: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if open_bucket and row[0] != open_bucket[0][0]:
                    ready += open_bucket
                    open_bucket = []
                    if size >= FLUSH_WINDOWS:
                        yield flush(ready)
                        ready, size = [], 0
                open_bucket.append(row)
                size += len(row[4]) // 8 - window + 1
        yield flush(ready + open_bucket)

    return packed.mapInArrow(run, "name bigint, mask bigint")


def removed_words(words: int, marks: list[dict], window: int) -> np.ndarray:
    """Which words are covered by the windows in ``marks`` (place, mask)."""
    change = np.zeros(words + 1, np.int64)
    place = np.array([m["place"] for m in marks], np.int64)
    mask = np.array([m["mask"] for m in marks], np.int64)
    for j in range(MOST_WINDOWS):
        at = (place >> 8)[(j < (place & 127)) & ((mask >> j) & 1 == 1)] + j
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change)[:words] > 0


def _kept(marked: DataFrame, window: int, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            marks = batch.column(2)
            n, removed, digest, kept = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()  # the ASCII white space, as bytes.split() takes it
                drop = marks[i].as_py()
                if drop:
                    gone = removed_words(len(words), drop, window)
                    rest = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    rest = words
                out = b" ".join(rest)
                n.append(len(words))
                removed.append(len(words) - len(rest))
                digest.append(hashlib.sha256(out).hexdigest())
                if texts:
                    kept.append(out.decode())
            made = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(made + [pa.array(kept, pa.string())] * texts, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    return marked.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, short: int = MINIMISER_WORDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of ``docs``.

    Removed is each word that a window covers whose word sequence starts anywhere else, too, in the
    same text or another; windows are judged on the input. Defined results: a null text has no words; a
    text with fewer words than a window keeps all; repeated rows lose all words that windows cover, as
    each is the other's copy; an empty table gives an empty result; other columns are not looked at.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    rows = _superkmer_rows(slim, window, short)
    several = stash(
        rows.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("place").bitwiseAND(128)).alias("again"), F.min("name").alias("low"), F.max("name").alias("high"))
        .where("n > 1 OR again > 0").select("minimiser", ((F.col("low") == F.col("high")) & (F.col("n") > 1)).alias("equal")), "minimisers")
    found = stash(rows.join(several, "minimiser"), "superkmers")  # no aggregate behind the join, so that Spark can split a hot minimiser

    distinct = stash(found.where("NOT equal").groupBy("minimiser", "name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")), "distinct")
    # written, so that Spark can split a hot minimiser in the join with it
    many = stash(distinct.groupBy("minimiser").agg((F.count(F.lit(1)) > SPLIT_ABOVE).alias("split")).where("split"), "many")
    asked = (
        distinct.join(many, "minimiser", "left")
        .groupBy("key").agg(F.collect_list(F.struct("name", "n", F.coalesce("split", F.lit(False)).alias("split"))).alias("asked"))
    )
    made = stash(_packed(slim.join(asked, "key").select("key", "text", "asked"), window, short), "packed")
    sorted_ = _counted(made.where("packed IS NOT NULL").select("bucket", "name", "n", "first", "packed").repartition(F.col("bucket")).sortWithinPartitions("bucket"), window)
    alone = made.where("packed IS NULL").select("bucket", "other", "name", "n", "first")
    again = stash(alone.groupBy("bucket", "other").agg(F.sum("n").alias("n")).where("n > 1").select("bucket", "other"), "again")
    counted = alone.join(again.hint("merge"), ["bucket", "other"]).select("name", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("first")).alias("mask"))
    masks = stash(sorted_.union(counted).groupBy("name").agg(F.bit_or("mask").alias("mask")), "masks")

    marks = (
        found.where("equal").select("key", "place", F.lit(-1).cast("bigint").alias("mask"))
        .union(found.where("NOT equal").join(masks, "name").select("key", "place", "mask"))
        .groupBy("key").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))  # rows that repeat an id and text have one key, and are marked once
    )
    marks = stash(marks, "marks")
    discard(several, found, distinct, many, made, again, masks)
    return _kept(slim.join(marks, "key", "left").select("doc_id", "text", "marks"), window, texts)
