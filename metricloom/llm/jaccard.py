"""Exact Jaccard self-join of word shingle sets, and the groups that its links make.

Sets are cut into bands by size. For a band the universe of shingles is partitioned into segments by
hash; a set's share of a segment is one signature. Two sets that reach the threshold differ in a
bounded number of shingles, each of which spoils one segment, so enough segments agree exactly. Of
its signatures a set therefore needs only as many as the bound, plus one. Which ones is decided by
cost: first those that do not stand out in any task's counts, then the less common of the others (a
sketch of a fixed size has the counts of what stands out; signatures too thinly spread to stand out
cost about the same). All sets use the same order, so two similar sets share a chosen signature (the
prefix argument), and segments in which thousands of dissimilar texts agree are left out. Where a set
has too few segments with content for the bound, it is indexed with all its segments and their
one-deletion neighbourhoods, and, where these don't reach the bound either, with its single shingles.

Allocation is the same for both sets of a pair. The other form, in which each set's probes choose
between a segment and its deletions freely, needs all segments and all deletions of every set in the
index: for a set of n shingles some 1.3 n rows instead of 0.2 n.

Texts that share a signature meet in the cell of the smallest id among them, in blocks of a bounded
size. First only their histograms meet there: how many shingles a set has in each of some equal ranges
of hashes. Two sets differ in at least as many shingles as their histograms do, so sets that have no
partner close enough by size and histogram drop out. The shingles of the others are then compared
exactly; a block yields a spanning forest of its links, not all pairs.

Ids of sets and of shingles are 64-bit hashes of their content; equal sets are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import discard, fresh, row_key, slices, stash
from .components import components

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
BLOCK = 512  # sets of a cell in a block; larger cells are verified as pairs of blocks
SLACK = 1.4  # how many segments with content the largest sets of a band should have, against those needed
SEEN = 100_000

_G, _S, _T = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    starts, ends, firsts = K.words(data, offsets)
    h = K.word_hashes(data, starts, ends, lower=True)
    grams = K.gram_hashes(h, size)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        yield np.unique(grams[a:b - size + 1]) if b - a >= size else K.gram_hashes(h[a:b], b - a) if b > a else grams[:0]


def set_id(u: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """How many shingles two sets of these sizes can have that only one of them has, at the threshold."""
    return (a + b) * (100 - percent) // (100 + percent)


def largest_partner(n: int, percent: int = PERCENT) -> int:
    return n * 100 // percent


@lru_cache(maxsize=None)
def segments(band: int, percent: int = PERCENT) -> int:
    """Number of segments of a band: the fewest that leave its largest sets the slack in segments with content."""
    n = 2 ** (band + 1) - 1
    need = most_different(n, largest_partner(n, percent), percent) + 1
    m = need
    while m * (1 - (1 - 1 / m) ** n) < SLACK * need and m < 4 * n:
        m += max(1, m // 50)
    return m


def roles(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, signatures needed) for a set of ``n``: its own band, and the one below if it can be a larger partner there."""
    band = n.bit_length() - 1
    out = [(band, most_different(n, largest_partner(n, percent), percent) + 1)]
    below = 2**band - 1
    if below and n <= largest_partner(below, percent):
        out.append((band - 1, most_different(n, below, percent) + 1))
    return out


def segment_signatures(u: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the segments with content, their numbers, and where each starts in the sorted set."""
    segment = ((u >> np.uint64(32)) * np.uint64(segments(band, percent))) >> np.uint64(32)
    first = np.concatenate(([0], np.flatnonzero(np.diff(segment)) + 1))
    content = np.add.reduceat(K.mix(u + _T), first)
    number = segment[first]
    return _signature(content, number, band), number, first


def _signature(content: np.ndarray, number: np.ndarray, band: int) -> np.ndarray:
    return K.mix(content + number * _S + np.uint64((band + 1) * int(_G) % 2**64))


def all_signatures(u: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.concatenate([segment_signatures(u, band, percent)[0] for band, _ in roles(len(u), percent)])


def allocate(u: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures under which a set is indexed."""
    out = []
    for band, need in roles(len(u), percent):
        sig, number, first = segment_signatures(u, band, percent)
        if len(sig) > need:
            out.append(sig[np.lexsort((sig, sketch[sig >> np.uint64(64 - SKETCH_BITS)]))[:need]])
            continue
        out.append(sig)
        if len(sig) == need:
            continue
        sizes = np.diff(np.append(first, len(u)))
        several = np.repeat(sizes > 1, sizes)
        tokens = K.mix(u + _T)
        content, of = np.add.reduceat(tokens, first), np.repeat(np.arange(len(first)), sizes)
        out.append(_signature(content[of][several] - tokens[several], number[of][several], band))
        if (sizes == 1).sum() + 2 * (sizes > 1).sum() < need:
            out.append(_signature(tokens, np.full(len(u), 1 << 40, np.uint64), band))
    return np.unique(np.concatenate(out))


def histogram(u: np.ndarray) -> np.ndarray:
    """How many shingles are in each of the equal ranges of hashes, of which a set has a quarter to an eighth of its size."""
    bits = max(2, len(u).bit_length() - 3)
    return np.minimum(np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def possible(sizes: np.ndarray, parts: np.ndarray, shapes: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Which sets have a partner (of the other part, if there are two) that size and histogram do not rule out."""
    keep = np.zeros(len(sizes), bool)
    across = len(set(parts.tolist())) > 1
    width = np.array([len(s) for s in shapes])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join([shapes[i] for i in own]), np.uint8).reshape(len(own), w).astype(np.int32)
        finer = np.flatnonzero(width == 2 * w)
        y = np.frombuffer(b"".join([shapes[i] for i in finer]), np.uint8).reshape(len(finer), w, 2).sum(2, dtype=np.int32)
        other, z = np.concatenate([own, finer]), np.concatenate([x, np.minimum(y, 255)])
        for k, i in enumerate(own):
            a, b = int(sizes[i]), sizes[other]
            bound = (a + b) * (100 - percent) // (100 + percent)
            near = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (other != i)
            if across:
                near &= parts[other] != parts[i]
            at = np.flatnonzero(near)
            # a full count stands for any larger one, so it never adds to the difference
            close = at[np.abs(z[at] - x[k]).sum(1) <= bound[at]]
            if len(close):
                keep[i] = True
                keep[other[close]] = True
    return keep


def _docs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))


def describe(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """For each document key, doc_id, n (size of its set), sid (id of the set; null if empty), shape (its histogram), and rows of
    the signature sketch (bucket, n): what stands out in the counts over all different sets of a task."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bucket", pa.int32()), ("shape", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int32)
        seen: set[int] = set()
        for batch in slices(batches, 2):
            n, sid, shape = [], [], []
            for _, _, data, offsets in K.chunks(batch.column(2)):
                found = []
                for u in shingle_sets(data, offsets, size):
                    n.append(len(u))
                    sid.append(set_id(u) if len(u) else None)
                    shape.append(histogram(u).tobytes() if len(u) else None)
                    if len(u) and sid[-1] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(sid[-1])
                        found.append(all_signatures(u, percent))
                if found:
                    np.add.at(count, (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(len(n), pa.int32()), pa.array(shape, pa.binary())], schema=schema)
        # far more than chance puts into a bucket: these hold signatures that many sets have
        usual = count.mean()
        bucket = np.flatnonzero(count > usual + 6 * np.sqrt(usual) + 3)
        none = pa.nulls(len(bucket), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(count[bucket].astype(np.int64)), none, pa.array(bucket.astype(np.int32)), pa.nulls(len(bucket), pa.binary())], schema=schema)

    return docs.mapInArrow(run, "key bigint, doc_id bigint, n bigint, sid bigint, bucket int, shape binary")


def signature_rows(docs: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """(sig, sid) of each set; copies within a task are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 2**SKETCH_BITS counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 0):
            for _, _, data, offsets in K.chunks(batch.column(0)):
                sigs, ids = [], []
                for u in shingle_sets(data, offsets, size):
                    if not len(u) or (sid := set_id(u)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    sigs.append(allocate(u, shared.value, percent))
                    ids.append(sid)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(s) for s in sigs]))], names=["sig", "sid"])

    return docs.select("text").mapInArrow(run, "sig bigint, sid bigint")


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Positions of all pairs (within ``a``, or one of each) that reach the threshold."""
    sets = a if b is None else [*a, *b]
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        i = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        near = 100 * i >= percent * (int(size.sum()) - i)
        return [(0, 1 if b is None else 0)] if near else []
    token, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(column) > 1
    use = shared[column]
    row, column = row[use], (np.cumsum(shared) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = len(a)
    both = np.zeros((left, left if b is None else len(b)), np.float32)
    width, at = 4096, 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[at:end], column[at:end] - column[at]] = 1
        both += x[:left] @ (x[:left] if b is None else x[left:]).T
        at = end
    other = size[:left] if b is None else size[left:]
    near = 100 * both >= percent * (size[:left, None] + other[None, :] - both)
    if b is None:
        near = np.triu(near, 1)
    return list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def forest(ids: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links from each id to the smallest that it is connected with."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j, key=ids.__getitem__)] = min(i, j, key=ids.__getitem__)
    return [(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i]


def block_rows(members: DataFrame) -> DataFrame:
    """From (cell, blocks, sid, key, n, shape): a row (cell, part, sid, key, n, shape) for each cell, or pair of its blocks, that a set is in."""
    schema = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("sid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("shape", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, blocks, sid = (batch.column(i).to_numpy() for i in range(3))
            own = (K.mix(sid.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(cell)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            names = np.stack([cell[row], np.minimum(own[row], other), np.maximum(own[row], other)], 1).view(np.uint64)
            one = K.mix(K.mix(K.mix(names[:, 0]) + names[:, 1]) + names[:, 2]).view(np.int64)
            for lo in range(0, len(row), 10_000):
                r = pa.array(row[lo:lo + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(one[lo:lo + 10_000]), pa.array(own[row[lo:lo + 10_000]], pa.int32()), *[batch.column(i).take(r) for i in (2, 3, 4, 5)]], schema=schema)

    return members.select("cell", "blocks", "sid", "key", "n", "shape").mapInArrow(run, "cell bigint, part int, sid bigint, key bigint, n bigint, shape binary")


def by_cell(batches: Iterator[pa.RecordBatch], part: int, sid: int) -> Iterator[list[tuple]]:
    """The rows of each cell (the first column), where cells stand together: one for each part and set, however often it comes."""
    name, rows = None, {}
    for batch in batches:
        cell = batch.column(0).to_numpy()
        columns = [c.to_pylist() for c in batch.columns]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            if name != (now := columns[0][a]):
                if rows:
                    yield list(rows.values())
                name, rows = now, {}
            for row in zip(*[c[a:b] for c in columns], strict=True):
                rows.setdefault((row[part], row[sid]), row)
    if rows:
        yield list(rows.values())


def promising(blocks: DataFrame, percent: int) -> DataFrame:
    """(key, cell, part) of the sets that histograms leave a partner in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for rows in by_cell(batches, 1, 2):
            if len(rows) > 1:
                keep = possible(np.array([r[4] for r in rows]), np.array([r[1] for r in rows]), [r[5] for r in rows], percent)
                out += [(r[3], r[0], r[1]) for r, k in zip(rows, keep.tolist(), strict=True) if k]
            if len(out) > 10_000:
                yield _named(out)
                out = []
        yield _named(out)

    def _named(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["key", "cell", "part"])

    return blocks.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, "key bigint, cell bigint, part int")


def cell_rows(members: DataFrame, size: int) -> DataFrame:
    """From (text, cells: array of (cell, part)): a row (cell, part, sid, content) for each; texts that come again in a task make none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 0):
            cells = batch.column(1)
            for lo, _, data, offsets in K.chunks(batch.column(0)):
                rows: list[tuple[int, int, int, bytes]] = []
                for i, u in enumerate(shingle_sets(data, offsets, size)):
                    sid, content = set_id(u), u.tobytes()
                    if sid in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    rows += [(c["cell"], c["part"], sid, content) for c in cells[lo + i].as_py()]
                    if len(rows) > 2000:
                        yield _cells(rows)
                        rows = []
                if rows:
                    yield _cells(rows)

    return members.mapInArrow(run, "cell bigint, part int, sid bigint, content binary")


def _cells(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["cell", "part", "sid", "content"])


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each cell, whose rows stand together."""

    def verify(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        parts: dict[int, dict[int, bytes]] = {}
        for _, part, sid, content in rows:
            parts.setdefault(part, {})[sid] = content
        if sum(map(len, parts.values())) < 2:
            return []
        ids = [list(p) for p in parts.values()]
        sets = [[np.frombuffer(x, np.uint64) for x in p.values()] for p in parts.values()]
        if len(sets) == 1:
            return forest(ids[0], similar(sets[0], None, percent))
        return forest(ids[0] + ids[1], [(i, len(ids[0]) + j) for i, j in similar(sets[0], sets[1], percent)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in by_cell(batches, 1, 2):
            out += verify(rows)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return cells.mapInArrow(run, "a bigint, b bigint")


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; if ``keyed`` also key (of id and text) and
    group, one number for each component of texts with words (null: without words).

    A document's set has its distinct shingles of ``size`` words (A-Z lower-cased); two documents link
    if their sets' Jaccard similarity is ``percent`` / 100 or more; component_id is the smallest doc_id
    that links reach. Defined results: texts that are null or without words have an empty set, link
    with nothing and are their own component; repeated rows are in one component and each has its
    row; a null doc_id counts for links, but is no component's smallest unless all its ids are null; an
    empty table gives an empty result. Other columns are not looked at.
    """
    slim = _docs(docs, doc_id, text)
    described = stash(describe(slim, size, percent), "sets")
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    often = described.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**SKETCH_BITS rows
    sketch[often["bucket"].to_numpy(np.int64)] = np.minimum(often["n"].to_numpy(np.int64), 2**31 - 1)
    own = described.where("bucket IS NULL").select("key", "doc_id", "n", "sid")
    classes = stash(described.where("bucket IS NULL").where("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("shape").alias("shape")), "classes")

    by_signature = Window.partitionBy("sig").orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (
        signature_rows(slim, sketch, size, percent)
        .withColumn("cell", F.first("sid").over(by_signature)).where("cell <> sid")
        .groupBy("cell", "sid").agg(F.lit(1).alias("one")).select("cell", "sid")
    )
    met = stash(met, "met")
    sizes = stash(met.groupBy("cell").agg(F.ceil((F.count(F.lit(1)) + 1) / BLOCK).cast("int").alias("blocks")), "sizes")
    large = sizes.where("blocks > 1")  # a written table: Spark can split the partition of a large cell in the join with it
    members = met.union(sizes.select("cell", "cell")).join(large, "cell", "left").select("sid", "cell", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    left = stash(promising(block_rows(members.join(classes.select("sid", "key", "n", "shape"), "sid")), percent), "promising")
    wanted = left.groupBy("key").agg(F.collect_list(F.struct("cell", "part")).alias("cells"))
    # a merge join at every size: the side without texts grows with the documents
    cells = cell_rows(slim.join(wanted.hint("merge"), "key").select("text", "cells"), size)
    links = cell_links(cells.repartition(F.col("cell")).sortWithinPartitions("cell"), percent)
    labels = components(links)

    linked = labels.join(classes, labels["node"] == classes["sid"]).select("sid", "component", "doc_id")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = linked.select("sid", "component").join(smallest, "component").select("sid", "component", "component_id")
    final = stash(
        classes.select("sid", "doc_id").join(known, "sid", "left")
        .select("sid", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "sid").alias("group")), "components")
    discard(classes, met, sizes, left, labels)
    return own.join(final, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(["key", "group"] if keyed else []))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of ``docs`` that stay: of each group in ``found`` (from :func:`groups`, keyed) the row with the smallest id and key.

    Null ids come last. Documents without words stay all. Groups that are not keyed are told apart by
    ids alone, which is enough where ids are distinct and not null.
    """
    if "key" not in found.columns:
        name = fresh(docs, "kept_id")
        stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(stays, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").dropDuplicates(["doc_id", "text"])
    name = fresh(docs, "kept_key")
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("x")).select(F.col("x.key").alias(name))
    wordless = found.where("group IS NULL").select(F.col("key").alias(name)).distinct()
    kept = lambda keys: docs.join(keys, row_key(F.col("doc_id"), F.col("text")) == F.col(name), "left_semi")
    return kept(first).dropDuplicates(["doc_id", "text"]).union(kept(wordless))
