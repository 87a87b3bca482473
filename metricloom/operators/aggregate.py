"""Fan-out by policy, window aggregation, and output rows.

One scan and one shuffle serve all policies: a sample is fanned out in the map stage and pre-aggregated
there, so the exchange carries one row per series, policy and window and not one per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import all_of
from ..functions.windows import NANOS, window_start
from ..plans.rules import COUNTER, DEFAULT_POLICIES, DEFAULT_TYPES, Options, StoragePolicy, check_types, suffix

WINDOW_KEYS = ["type", "id", "resolution_s", "retention_s", "window_nanos"]


def fan_out(samples: DataFrame, policies: tuple[StoragePolicy, ...] = ()) -> DataFrame:
    """Each sample once for each different policy (the defaults if none is given)."""
    each = list(dict.fromkeys(policies or DEFAULT_POLICIES))
    if len(each) == 1:
        return samples.withColumns({"resolution_s": F.lit(each[0].resolution_s).cast("bigint"), "retention_s": F.lit(each[0].retention_s).cast("bigint")})
    rows = F.array(*[F.struct(F.lit(p.resolution_s).cast("bigint").alias("resolution_s"), F.lit(p.retention_s).cast("bigint").alias("retention_s")) for p in each])
    return samples.select("*", F.inline(rows))


def in_windows(samples: DataFrame, aligned: bool = False) -> DataFrame:
    """``window_nanos``, where the row of a sample's window is written: the window's end, or for forwarded samples, which are aligned, their time."""
    start = window_start(F.col("ts_nanos"), F.col("resolution_s"))
    return samples.withColumn("window_nanos", start if aligned else start + F.col("resolution_s") * F.lit(NANOS))


def typed_value(samples: DataFrame, metric_type: str) -> Column:
    """Counters take whole numbers: ``whole`` where samples have that column, else fractions are cut off, and what is no number is skipped."""
    if metric_type != COUNTER:
        return F.col("value")
    cut = F.expr("try_cast(value AS bigint)")
    return F.coalesce("whole", cut) if "whole" in samples.columns else cut


def aggregate(samples: DataFrame, metric_type: str, agg_types: tuple[str, ...] = (), policies: tuple[StoragePolicy, ...] = (), options: Options = Options(), aligned: bool = False, fanned: bool = False) -> DataFrame:
    """A row for each series, policy, window and aggregation type: WINDOW_KEYS, agg_type, agg_order, value."""
    types = check_types(metric_type, agg_types)
    own = samples.where(F.col("type") == metric_type).withColumn("value", typed_value(samples, metric_type)).where("value IS NOT NULL")
    ready = in_windows(own if fanned else fan_out(own, policies), aligned)
    order = F.struct("arrival_nanos", "seq")
    made, read = all_of(types, metric_type, F.col("value"), order, options)
    wide = ready.groupBy(*WINDOW_KEYS).agg(*made)
    rows = F.array(*[F.struct(F.lit(t).alias("agg_type"), F.lit(i).alias("agg_order"), read[t].alias("value")) for i, t in enumerate(types)])
    return wide.select(*WINDOW_KEYS, F.inline(rows))


def named(rows: DataFrame, metric_type: str, agg_types: tuple[str, ...] = (), options: Options = Options(), bare: bool = False) -> DataFrame:
    """Output rows: metric_id, ts_nanos, agg_type, value, resolution_s, retention_s. Timed samples keep their bare id."""
    types = check_types(metric_type, agg_types)
    only_default = types == DEFAULT_TYPES[metric_type]
    if bare:
        name = F.col("id")
    else:
        ends = F.create_map(*[F.lit(x) for t in types for x in (t, suffix(metric_type, t, only_default))])
        name = F.concat(F.lit(options.prefixes[metric_type]), "id", ends[F.col("agg_type")])
    return discard_nan(rows.select(name.alias("metric_id"), F.col("window_nanos").alias("ts_nanos"), "agg_type", "value", "resolution_s", "retention_s"), options)


def discard_nan(rows: DataFrame, options: Options = Options()) -> DataFrame:
    return rows.where(~F.isnan("value")) if options.discard_nan else rows


def untimed(samples: DataFrame, metric_type: str, agg_types: tuple[str, ...] = (), policies: tuple[StoragePolicy, ...] = (), options: Options = Options()) -> DataFrame:
    """Samples to output rows in one go."""
    return named(aggregate(samples, metric_type, agg_types, policies, options), metric_type, agg_types, options)


def coarser(rows: DataFrame, policy: StoragePolicy) -> DataFrame:
    """Aggregates of longer windows from those of shorter ones: count, sum, sumsq, min, max, last (with last_order).

    ``rows`` has WINDOW_KEYS with the window's end, and these columns; the longer window must be a
    multiple of the shorter. Quantiles are not mergeable and need the samples.
    """
    start = F.col("window_nanos") - F.col("resolution_s") * F.lit(NANOS)
    end = window_start(start, F.lit(policy.resolution_s)) + F.lit(policy.resolution_s * NANOS)
    return rows.groupBy("type", "id", F.lit(policy.resolution_s).cast("bigint").alias("resolution_s"), F.lit(policy.retention_s).cast("bigint").alias("retention_s"), end.alias("window_nanos")).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.max_by("last", "last_order").alias("last"), F.max("last_order").alias("last_order"))
