"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are runs of words, and every run of ``GRAM`` words has a hash. Of the five hashes in a window of
13 words the smallest (the leftmost of equal ones) is selected: its place is a fingerprint of the
text, and neighbouring windows mostly select the same one. Equal windows select at equal places, so
texts that share 13 words or more share a fingerprint. Fingerprints of documents and benchmark are
joined; a hit is extended to both sides by the words that a window needs beyond the fingerprint, each
extension being a row with a second hash, so that a fingerprint which many texts share joins only
where the words around it agree, too, and the join never makes more rows than the documents put in.
Hits are all words that the extended spans cover. Items of fewer than 13 words are one window, and
their own fingerprint.

A bitmap over the benchmark's fingerprints drops nearly all fingerprints of the documents where they
are read. It has some sixteen bits for each fingerprint, and 8 MB at most: a larger benchmark passes
more of them on to the join, with the same result. Window identity is two 64-bit hashes.

Defined results: a text that is null or without words has no words, no hits and is not
contaminated; an item without words matches nothing; items with equal windows all count; items
without an id count like others, together as one in n_items, and are left out of items_sha256;
very long texts are read whole; repeated rows get equal results, one for each; an empty benchmark
finds nothing, an empty table of documents gives an empty result; other columns, whatever their
names, are not looked at and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, row_key, stash

WINDOW = 13
GRAM = 9
AROUND = WINDOW - GRAM
BITS_EACH = 16
MOST_LONGS = 1 << 20  # of the bitmap: 8 MB
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = "array<struct<j:int,len:int,fp:bigint,ext:bigint>>"


def words(text: Column) -> Column:
    """A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _until(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column) -> Column:
    return F.transform(_until(F.size(w) - GRAM), lambda i: F.xxhash64(*[w[i + k] for k in range(GRAM)]))


def least(h: Column, j: Column) -> Column:
    """The smallest hash in the window that starts at word ``j``."""
    return F.array_min(F.slice(h, j + 1, AROUND + 1))


def selected(h: Column, wanted) -> Column:
    """(p, fp) of each selected fingerprint for which ``wanted`` holds, once, by place."""
    hits = F.filter(F.transform(_until(F.size(h) - AROUND - 1), lambda j: F.struct(j.alias("j"), least(h, j).alias("fp"))), lambda x: wanted(x["fp"]))
    placed = F.transform(hits, lambda x: F.struct((x["j"] + F.array_position(F.slice(h, x["j"] + 1, AROUND + 1), x["fp"]).cast("int") - 1).alias("p"), x["fp"].alias("fp")))
    return F.array_distinct(placed)


def _hash(w: Column, j: Column, n: Column | int) -> Column:
    """A second hash of the ``n`` words from word ``j`` on."""
    return F.xxhash64(F.lit("window"), F.slice(w, j + 1, n))


def extended(w: Column, fingerprints: Column) -> Column:
    """Each window around each fingerprint: j, len, fp, ext."""
    around = lambda x: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(AROUND)), lambda k: x["p"] - k), lambda j: (j >= 0) & (j + WINDOW <= F.size(w)))
    return F.flatten(F.transform(fingerprints, lambda x: F.transform(around(x), lambda j: F.struct(j.alias("j"), F.lit(WINDOW).alias("len"), x["fp"].alias("fp"), _hash(w, j, WINDOW).alias("ext")))))


def _short(w: Column, n: Column, wanted) -> Column:
    """The windows of ``n`` words, fewer than 13, whose fingerprint is wanted."""
    every = F.transform(_until(F.size(w) - n), lambda j: F.struct(j.alias("j"), n.alias("len"), F.xxhash64(n, F.slice(w, j + 1, n)).alias("fp")))
    return F.transform(F.filter(every, lambda x: wanted(x["fp"])), lambda x: F.struct(x["j"].alias("j"), x["len"].alias("len"), x["fp"].alias("fp"), _hash(w, x["j"], x["len"]).alias("ext")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """len, fp, ext, items, nameless: each distinct window with the items (as strings) that have it, and whether one without an id does."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    w, every = F.col("w"), lambda _: F.lit(True)
    windows = F.when(F.size(w) >= WINDOW, let(gram_hashes(w), lambda h: extended(w, selected(h, every)))).otherwise(_short(w, F.size(w), every))
    return split.select("item", F.explode(windows).alias("x")).groupBy("x.len", "x.fp", "x.ext").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull().cast("int")).alias("nameless"))


def bitmap(windows: DataFrame) -> DataFrame:
    """One row: ``bits`` (longs, a bit for each fingerprint; their number is a power of two) and ``short`` (lengths of windows under 13 words)."""
    spark = windows.sparkSession
    n = windows.agg(F.approx_count_distinct("fp")).first()[0]
    longs = min(MOST_LONGS, 1 << max(10, (n * BITS_EACH // 64).bit_length()))
    marked = windows.groupBy(_slot(F.col("fp"), F.lit(longs)).alias("slot")).agg(F.bit_or(_bit(F.col("fp"))).alias("bits"))
    every = spark.range(longs).select(F.col("id").cast("int").alias("slot")).join(marked, "slot", "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    bits = stash(one.select(F.transform("all", lambda x: x["bits"]).alias("bits")), "bits")
    short = stash(windows.where(F.col("len") < WINDOW).agg(F.array_sort(F.collect_set("len")).alias("short")), "short")
    return bits.select("bits", short.scalar().alias("short"))


def _slot(fp: Column, longs: Column) -> Column:
    return F.shiftrightunsigned(fp, 6).bitwiseAND((longs - 1).cast("bigint")).cast("int")


def _bit(fp: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), fp.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every row of ``documents`` doc_id, key (of id and text), n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = stash(benchmark_windows(benchmark), "windows")
    marks = stash(bitmap(windows), "bitmap")
    ready = documents.select("doc_id", "text", marks.select("bits").scalar().alias("bits"), marks.select("short").scalar().alias("short"))
    bits, short = F.col("bits"), F.col("short")
    wanted = lambda fp: bits[_slot(fp, F.size(bits))].bitwiseAND(_bit(fp)) != 0
    long = lambda w: F.when(F.size(w) >= WINDOW, let(gram_hashes(w), lambda h: let(selected(h, wanted), lambda x: extended(w, x)))).otherwise(F.array().cast(_NONE))
    found = ready.select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.concat(long(w), F.flatten(F.transform(short, lambda n: _short(w, n, wanted)))).alias("found"))).alias("x"),
    ).select("doc_id", "key", "x.n", "x.found", F.monotonically_increasing_id().alias("row"))
    found = stash(found, "fingerprints")  # rows keep their number from here on
    # a merge join at every size: each row of the documents meets one of the benchmark at most, and a hot key can be split
    met = found.where("size(found) > 0").select("row", F.inline("found")).join(windows.hint("merge"), ["len", "fp", "ext"]).groupBy("row").agg(
        F.collect_set(F.struct("j", "len")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("nameless").alias("nameless"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["j"], s["j"] + s["len"] - 1)))))
    counted = met.select(
        "row", covered.cast("bigint").alias("n_hit"), (F.size("items") + F.col("nameless")).cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    whole = found.select("doc_id", "key", F.col("n").cast("bigint").alias("n_words"), "row").join(counted, "row", "left")
    none = F.lit(0).cast("bigint")
    result = whole.select("doc_id", "key", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns."""
    key, number = fresh(documents, "key"), fresh(documents, "number")
    bad = hits(documents, benchmark).where("contaminated").select(F.col("key").alias(key), F.col("doc_id").alias(number)).distinct()
    return documents.join(bad, (row_key(F.col("doc_id"), F.col("text")) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(number)), "left_anti")
