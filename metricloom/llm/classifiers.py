"""Toxicity and quality: what is learned from ``labels``, and scores of every document.

Defined results: texts that are null or empty are scored like any text without features; a document
without a label is scored all the same; several labels for one id count as the largest; labels other
than 0 and 1, and null ids, teach nothing; without any label of both classes every score is the share
of label 1 (smoothed), 0.5 without labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import crc_mod, labelled_sample

#: Labelled rows that the models are fitted on, at most. More rows do not change it much: held-out
#: accuracy is level from a few thousand on.
SAMPLE_ROWS = QUALITY_ROWS = 6000
TOXIC_AT, QUALITY_AT = 0.5, 0.7


def toxicity_held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def quality_held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def toxicity_model(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> linear.Model:
    """Character n-gram model of ``labels.toxic``, without the held-out ids."""
    return linear.train_logistic("toxicity", labelled_sample(documents, labels, "toxic", ~toxicity_held_out(F.col("doc_id")), rows))


def quality_model(documents: DataFrame, labels: DataFrame, rows: int = QUALITY_ROWS) -> linear.Model:
    """Naive Bayes support vector model of ``labels.quality``, without the held-out ids."""
    return linear.train_svm("quality", labelled_sample(documents, labels, "quality", ~quality_held_out(F.col("doc_id")), rows))


def toxicity(documents: DataFrame, model: linear.Model) -> DataFrame:
    """``documents`` with score and predicted (1: toxic)."""
    return linear.score(documents, model).withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


def quality(documents: DataFrame, model: linear.Model) -> DataFrame:
    """``documents`` with score and predicted (1: good)."""
    return linear.score(documents, model).withColumn("predicted", (F.col("score") >= QUALITY_AT).cast("int"))
