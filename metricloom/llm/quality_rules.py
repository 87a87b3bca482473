"""Quality rules in DataFrame functions only: counts of each text, and a likelihood-ratio verdict.

Words and pairs of words are hashed into a fixed number of buckets. Over all documents a multinomial
of the raw corpus is counted, and over all trusted ones (those labelled good) the target's. A text's score is the log-likelihood ratio of the two, divided by the number of its n-grams;
one threshold decides on every document. Texts are shuffled once, to meet the ids labelled good; counts
are aggregated by bucket before they move, and what scoring needs is one array of a fixed size.

Defined results: a null or empty text has no words, fails the base rules and is not kept; very long
texts are read whole; other columns, whatever their names, are left out; an empty table gives an empty
result, judged by whatever weights; without
trusted documents the ratio is that of the smoothed target and still the same for every run; ties at
the threshold are kept; rows that repeat are counted and judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stash

BUCKETS = 16384
SMOOTHING = 1.0
THRESHOLD = -0.03
MIN_WORDS = 50
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; of null: none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.array_remove(F.split(plain, " "), "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(w: Column, h: Column) -> Column:
    """Buckets of the words (whose hashes are ``h``) and of the pairs of neighbouring words."""
    bucket = lambda x: x.bitwiseAND(F.lit(BUCKETS - 1).cast("bigint")).cast("int")
    ones = F.transform(h, bucket)
    twos = F.transform(F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>")), lambda i: bucket(F.xxhash64(w[i - 1], w[i])))
    return F.concat(ones, twos)


def repeat_words(h: Column) -> Column:
    """How many words (given by their hashes) are in windows of three words that are found twice or more in the text."""
    places = F.when(F.size(h) > 2, F.sequence(F.lit(2), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.xxhash64(h[i - 2], h[i - 1], h[i]))

    def twice(o: Column) -> Column:  # hashes with their places, sorted: equal neighbours are there twice or more
        again = F.filter(o, lambda e, k: ((k > 0) & (F.get(o, k - 1)["x"] == e["x"])) | F.coalesce(F.get(o, k + 1)["x"] == e["x"], F.lit(False)))
        return let(F.array_sort(F.transform(again, lambda e: e["i"])), lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), twice)))


def weights(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket, from counts over all documents and all that are labelled good."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    # a shuffled join at every size: the ids labelled good grow with the documents; rows without an id stay out of it
    marked = texts.where("doc_id IS NOT NULL").join(trusted.withColumn("good", F.lit(1)).hint("shuffle_hash"), "doc_id", "left").select("text", "good")
    marked = marked.unionByName(texts.where("doc_id IS NULL").select("text", F.lit(None).cast("int").alias("good")))
    each = marked.select("good", F.explode(let(words(F.col("text")), lambda w: grams(w, hashes(w)))).alias("bucket"))
    counts = stash(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")), "counts")
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    filled = every.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    log = lambda n, total: F.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS))
    return stash(one.select(F.transform("all", lambda x: log(x["target"], F.col("target")) - log(x["raw"], F.col("raw"))).alias("weights")), "weights")


def judge(documents: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and text of ``documents`` with the counts, base_failed, llr (per n-gram) and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = F.col("weights")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    counted = documents.select("doc_id", "text", model.scalar().alias("weights")).select(
        "doc_id", "text",
        (F.char_length(F.translate(text, SPACE_CHARS, ""))).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(words(F.col("text")), lambda w: let(hashes(w), lambda h: F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeat_words(h).cast("bigint").alias("n_repeat_words"),
            (F.aggregate(grams(w, h), F.lit(0.0), lambda a, b: a + weights[b]) / F.greatest(F.lit(1), 2 * F.size(w) - 1)).alias("llr")))).alias("x"),
    ).select("doc_id", "text", "x.n_words", "word_chars", "n_symbols", "n_dup_lines", "x.n_repeat_words", "x.llr")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
