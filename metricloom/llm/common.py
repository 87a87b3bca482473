"""Helpers that the text operators share: the shared scratch folder, row keys, slices of batches and picked samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent, a temporary folder takes its place if driver and executors are one
    process (tests, ``local`` masters), and goes when that process ends; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="metricloom-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/metricloom-{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the lineage at files that survive a lost executor.

    What a result still reads has to stay until its reader is done, so the last tables of an operator are
    left to whoever clears the folder; :func:`discard` takes away those that nothing reads any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with some ``limit`` bytes of text each, a row with more alone: what is made of them, and sent back, stays small."""
    for batch in batches:
        texts = batch.column(column)
        at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32, len(texts) + 1, texts.offset * (8 if pa.types.is_large_string(texts.type) else 4)) if len(texts) else np.zeros(1)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(doc_id: Column, text: Column) -> Column:
    """One 64-bit key for an id and its text; rows that repeat both have the same key."""
    return F.xxhash64(doc_id, text)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for each row, also where lambdas in ``body`` use it many times.

    A column made in a projection of its own may be pasted into those lambdas by the optimizer.
    """
    return F.transform(F.array(value), body)[0]


def picked(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``: those with the smallest hash of ``by``, whatever the order of the files."""
    return df.orderBy(F.xxhash64(by), by).limit(rows)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held_in: Column, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs for a classifier, brought to the driver.

    Only labels 0 and 1 of rows for which ``held_in`` (over ``doc_id``) holds are taken. The ids are
    picked first, so the side that is broadcast has at most ``rows`` rows.
    """
    spark = documents.sparkSession
    ids = picked(
        labels.where(held_in & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")),
        F.col("doc_id"), rows,
    ).collect()  # at most `rows` pairs of numbers
    if not ids:
        return []
    kind = labels.schema["doc_id"].dataType.simpleString()
    pick = spark.createDataFrame([(r.doc_id, r.label) for r in ids], f"doc_id {kind}, label int")
    got = one_row_each(documents.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("text", "label", "doc_id"), rows)
    return [(r.text or "", r.label) for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.text or ""))]


def one_row_each(found: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``found`` (a doc_id may repeat, with equal or different texts): of each id the one with the smallest text."""
    columns = [c for c in found.columns if c != "doc_id"]
    return found.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in columns if c != "text"])).alias("x")).select("doc_id", "x.*").limit(rows)
