"""Transformations of aggregated series, and rollups over several stages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import NANOS
from ..plans.rules import Options, Rollup, StoragePolicy, Transformation, stages
from . import aggregate as A

SERIES = ["type", "id", "resolution_s", "retention_s", "agg_type"]


def absolute(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.abs("value"))


def per_second(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Change per second since the series' window before, however long ago; NaN for the first, and where the value falls (a reset)."""
    series = Window.partitionBy(*SERIES).orderBy("window_nanos")
    before, since = F.lag("value").over(series), F.col("window_nanos") - F.lag("window_nanos").over(series)
    rate = (F.col("value") - before) / (since / NANOS)
    nan = F.lit(math.nan)
    out = F.when(before.isNull() | F.isnan(before) | F.isnan("value"), nan)
    out = out.otherwise(rate) if options.keep_resets else out.when(rate < 0, nan).otherwise(rate)
    return rows.withColumn("value", out)


def transform(rows: DataFrame, ops: tuple[Transformation, ...], options: Options = Options()) -> DataFrame:
    """The operations one after the other; each is a projection of its own, so their order counts."""
    for op in ops:
        rows = absolute(rows) if op.kind == "Absolute" else per_second(rows, options)
    return rows


def roll_up(rows: DataFrame, rollup: Rollup, options: Options = Options()) -> DataFrame:
    """Rows as input of a rollup: its id, one value for each row, at the time of the row's window."""
    out = rows.select("type", F.lit(rollup.id).alias("id"), "value", F.col("window_nanos").alias("ts_nanos"), F.col("window_nanos").alias("arrival_nanos"), F.hash("id", "agg_type").cast("bigint").alias("seq"), "resolution_s", "retention_s")
    return out.where(~F.isnan("value")) if options.discard_nan else out


def run(samples: DataFrame, metric_type: str, agg_types: tuple[str, ...], policies: tuple[StoragePolicy, ...], ops: tuple, options: Options = Options()) -> DataFrame:
    """Aggregated rows at the end of a pipeline: aggregate, transform, roll up, and again with what travels on.

    The metric type stays the same over all stages, so a counter's rollup cuts off fractions. Operations
    that no rollup follows are an error, as in the rules.
    """
    rows = A.aggregate(samples, metric_type, agg_types, policies, options)
    for stage in stages(ops):
        moved = roll_up(transform(rows, stage.head, options), stage.rollup, options)
        rows = A.aggregate(moved, metric_type, stage.rollup.agg_types, options=options, aligned=True, fanned=True)
    return rows


def output(samples: DataFrame, metric_type: str, agg_types: tuple[str, ...], policies: tuple[StoragePolicy, ...], ops: tuple, options: Options = Options()) -> DataFrame:
    """:func:`run`, with names of the last stage's types."""
    last = next((op.agg_types for op in reversed(ops) if isinstance(op, Rollup)), agg_types)
    return A.named(run(samples, metric_type, agg_types, policies, ops, options), metric_type, last, options)
