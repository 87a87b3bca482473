"""One Spark aggregate for each aggregation type; all results are doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import COUNTER, GAUGE, QUANTILES, Options

GREATEST = 1.7976931348623157e308


def aggregate(agg_type: str, metric_type: str, value: Column, order: Column, options: Options = Options()) -> Column:
    """The aggregate of ``value`` (bigint for counters) that ``agg_type`` names.

    ``order`` says which sample came last; quantiles are in :func:`quantiles`. NaN counts and makes sums NaN, but is no minimum or maximum;
    a gauge with nothing but NaN keeps the sentinels. Bigint sums that overflow raise an error.
    """
    number = F.lit(True) if metric_type == COUNTER else ~F.isnan(value)
    if agg_type == "Count":
        out = F.count(value)
    elif agg_type == "Sum":
        out = F.sum(value)
    elif agg_type == "SumSq":
        out = F.sum(value.cast("double") * value.cast("double"))  # a counter's square may be no bigint
    elif agg_type == "Mean":
        out = F.sum(value).cast("double") / F.count(value)
    elif agg_type == "Stdev":
        out = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    elif agg_type == "Min":
        out = F.min(F.when(number, value))
        out = F.coalesce(out, F.lit(GREATEST)) if metric_type == GAUGE else out
    elif agg_type == "Max":
        out = F.max(F.when(number, value))
        out = F.coalesce(out, F.lit(-GREATEST)) if metric_type == GAUGE else out
    elif agg_type == "Last":
        out = F.max_by(value, order)
    else:
        out = F.lit(0.0)
    return out.cast("double")


def quantiles(agg_types: tuple[str, ...], value: Column, options: Options = Options()) -> tuple[Column | None, dict[str, Column]]:
    """One aggregate (named ``ranked``) for all quantiles among ``agg_types``, and how each is read from it.

    A quantile is the value of rank ceil(q n). By default the aggregate is a mergeable sketch with rank
    error ``quantile_eps``; exact ones sort all values of a group, once for all quantiles. Spark's sketch of
    accuracy a may be off by n / a + 1/2 ranks, and by none if n < a / 2, so 2 / ``quantile_eps`` keeps the bound at every n.
    """
    wanted = [t for t in agg_types if t in QUANTILES]
    if not wanted:
        return None, {}
    ranked = F.col("ranked")
    if options.exact_quantiles:
        rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(ranked)).cast("int"))
        return F.sort_array(F.collect_list(value)).alias("ranked"), {t: F.try_element_at(ranked, rank(QUANTILES[t])).cast("double") for t in wanted}
    sketch = F.percentile_approx(value, [QUANTILES[t] for t in wanted], math.ceil(2 / options.quantile_eps))
    return sketch.alias("ranked"), {t: ranked[i].cast("double") for i, t in enumerate(wanted)}


def all_of(agg_types: tuple[str, ...], metric_type: str, value: Column, order: Column, options: Options = Options()) -> tuple[list[Column], dict[str, Column]]:
    """The aggregates that a group-by needs for ``agg_types``, and the columns to read behind it."""
    ranked, read = quantiles(agg_types, value, options)
    plain = [t for t in agg_types if t not in QUANTILES]
    made = [aggregate(t, metric_type, value, order, options).alias(t) for t in plain]
    return made + ([] if ranked is None else [ranked]), {t: read[t] if t in read else F.col(t) for t in agg_types}
