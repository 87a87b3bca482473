"""A pipeline over ``documents``: toxicity, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it has kept, and works on
all of it. All but the last return the columns of ``documents``; ``run`` writes each stage's result to
the folder that the cluster shares and reads it again.

Defined results: null and empty texts are kept by all stages and end without ids; rows with a null
doc_id go the way of all others; of rows that repeat an id and text, one stays (all, if they are without
words); of linked texts the one with the smallest id stays, then the one with the smallest key; very long
texts are worked on whole; documents may have other columns, whatever their names: they are left out;
empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import bpe, classifiers, decontaminate, jaccard, pii
from metricloom.llm.common import stash

TOKENIZER = "byte_bpe_50k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labelled rows of ``documents``."""
    model = classifiers.toxicity_model(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return classifiers.toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard.keep_one(docs, jaccard.groups(docs, keyed=True)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source, the ids of the text (decimals joined by commas), their number and digest, and the digest of the ids decoded.

    A null text has no ids. Ids are made and decoded in one pass, and the text itself does not travel back.
    """
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER), ids="ids", with_text=False)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the trained stages. tests/llm/test_queries.py holds every stage and run() against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
