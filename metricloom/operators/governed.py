"""Aggregation that the samples' own metadata drives: types, policies and pipelines come from the rows.

An entry is told apart by category (untimed, timed, forwarded), type and id; what it is aggregated under
by aggregation types, storage policy, operations still to come and hops behind it. Samples under any
number of different rules go through one scan and one shuffle; what a row's types don't ask for is
worked out all the same (a few sums), and quantiles for timers alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.aggregates import all_of
from ..functions.windows import NANOS, window_start
from ..plans.rules import COUNTER, DEFAULT_POLICIES, DEFAULT_TYPES, GAUGE, METRIC_TYPES, QUANTILES, SIMPLE_TYPES, SUFFIXES, TIMER, Options, StagedMetadata, Transformation
from ..sources.samples import METADATA, OP
from .aggregate import discard_nan

UNTIMED, TIMED, FORWARDED = "untimed", "timed", "forwarded"
ENTRY = ["category", "type", "id"]
KEY = ["agg_types", "resolution_s", "retention_s", "ops", "hops"]


def metadata(metas: Iterable[StagedMetadata]) -> Column:
    """Metadata declared in Python, as the column ``metas`` that samples carry."""

    def op(x) -> dict:
        if isinstance(x, Transformation):
            return {"kind": "transform", "transform": x.kind}
        return {"kind": "rollup", "rollup_id": x.id, "rollup_aggs": list(x.agg_types)}

    rows = [{
        "cutover_nanos": m.cutover_nanos, "tombstoned": m.tombstoned,
        "pipelines": [{"agg_types": list(p.agg_types), "policies": [{"resolution_s": s.resolution_s, "retention_s": s.retention_s} for s in p.policies], "ops": [op(x) for x in p.ops]} for p in m.pipelines],
    } for m in metas]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{METADATA}>")


def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def types_or_default(agg_types: Column, metric_type: Column) -> Column:
    """Each type once, in order; the metric type's defaults where none is given."""
    given = F.array_distinct(F.coalesce(agg_types, _strings([])))
    default = F.when(metric_type == COUNTER, _strings(DEFAULT_TYPES[COUNTER])).when(metric_type == TIMER, _strings(DEFAULT_TYPES[TIMER])).otherwise(_strings(DEFAULT_TYPES[GAUGE]))
    return F.when(F.size(given) > 0, given).otherwise(default)


def invalid_types(agg_types: Column, metric_type: Column) -> Column:
    """Whether some type is unknown, or not for the metric type."""
    fits = lambda t: (t.isin(*SIMPLE_TYPES) & ((t != "Last") | (metric_type == GAUGE))) | (t.isin(*QUANTILES) & (metric_type == TIMER))
    return ~metric_type.isin(*METRIC_TYPES) | F.exists(agg_types, lambda t: ~fits(t))


def untimed(resolved: DataFrame) -> DataFrame:
    """Samples with ``meta`` (from ``admission.resolve_metadata``) once for each different key of its pipelines and policies."""
    policies = _policy_array(DEFAULT_POLICIES)
    no_ops = F.array().cast(f"array<{OP}>")

    def keys(p: Column) -> Column:
        every = F.when(F.coalesce(F.size(p["policies"]), F.lit(0)) > 0, p["policies"]).otherwise(policies)
        return F.transform(every, lambda s: F.struct(types_or_default(p["agg_types"], F.col("type")).alias("agg_types"), s["resolution_s"].alias("resolution_s"), s["retention_s"].alias("retention_s"), F.coalesce(p["ops"], no_ops).alias("ops")))

    own = [c for c in resolved.columns if c not in ("meta", "metas")]
    return resolved.select(F.lit(UNTIMED).alias("category"), *own, F.inline(F.array_distinct(F.flatten(F.transform("meta.pipelines", keys)))), F.lit(0).alias("hops"))


def _policy_array(policies) -> Column:
    return F.array(*[F.struct(F.lit(p.resolution_s).cast("bigint").alias("resolution_s"), F.lit(p.retention_s).cast("bigint").alias("retention_s")) for p in policies])


def timed(samples: DataFrame) -> DataFrame:
    """Timed samples, which bring agg_types, resolution_s and retention_s, and no operations."""
    return samples.withColumns({"category": F.lit(TIMED), "agg_types": types_or_default(F.col("agg_types"), F.col("type")), "ops": F.array().cast(f"array<{OP}>"), "hops": F.lit(0)})


def forwarded(samples: DataFrame) -> DataFrame:
    """Forwarded samples, which bring all of their key and one row for each value; the hops behind them are part of it."""
    return samples.withColumns({"category": F.lit(FORWARDED), "agg_types": types_or_default(F.col("agg_types"), F.col("type")), "hops": F.col("num_forwarded")})


def aggregate(keyed: DataFrame, options: Options = Options()) -> DataFrame:
    """ENTRY, KEY, window_nanos, agg_type, value: a row for each entry, key, window and type asked for.

    Rows with an invalid type are left out (see :func:`invalid_types`). Counters take whole numbers, as
    in ``operators.aggregate``, and are exact up to 2**63.
    """
    aligned = F.col("category") == FORWARDED
    start = window_start(F.col("ts_nanos"), F.col("resolution_s"))
    cut = F.expr("try_cast(value AS bigint)")
    counted = F.when(F.col("type") == COUNTER, F.coalesce("whole", cut) if "whole" in keyed.columns else cut)
    rows = keyed.where(~invalid_types(F.col("agg_types"), F.col("type"))).select(
        *ENTRY, *KEY, F.when(aligned, start).otherwise(start + F.col("resolution_s") * F.lit(NANOS)).alias("window_nanos"), "arrival_nanos", "seq",
        F.when(F.col("type") == COUNTER, counted.cast("double")).otherwise(F.col("value")).alias("value"), counted.alias("counted"), F.when(F.col("type") == TIMER, F.col("value")).alias("timed"))
    rows = rows.where("value IS NOT NULL")
    order = F.struct("arrival_nanos", "seq")
    made, read = all_of(SIMPLE_TYPES, GAUGE, F.col("value"), order, options)
    ranked, quantiles = all_of(tuple(QUANTILES), TIMER, F.col("timed"), order, options)
    wide = rows.groupBy(*ENTRY, *KEY, "window_nanos").agg(*made, *ranked, F.sum("counted").alias("counted"))
    whole = F.col("type") == COUNTER
    every = read | quantiles | {"Sum": F.when(whole, F.col("counted").cast("double")).otherwise(read["Sum"]), "Mean": F.when(whole, F.col("counted").cast("double") / F.col("Count")).otherwise(read["Mean"])}
    values = F.create_map(*[x for t, c in every.items() for x in (F.lit(t), c)])
    return wide.withColumn("values", values).select(*ENTRY, *KEY, "window_nanos", F.explode("agg_types").alias("agg_type"), "values").withColumn("value", F.try_element_at("values", "agg_type")).drop("values")


def _head(ops: Column) -> Column:
    """The operations before the first rollup."""
    at = F.array_position(F.transform(ops, lambda x: x["kind"]), "rollup")
    return F.when(at > 0, F.slice(ops, 1, (at - 1).cast("int"))).otherwise(ops)


def invalid_ops(ops: Column) -> Column:
    """Whether operations stand behind the last rollup, are unknown, or hold two derivatives before one rollup."""
    known = lambda x: (x["kind"] == "rollup") | ((x["kind"] == "transform") & x["transform"].isin("Absolute", "PerSecond"))
    rates = lambda x: F.when(x["kind"] == "rollup", F.lit("|")).when(x["transform"] == "PerSecond", F.lit("d")).otherwise("")
    return (F.size(ops) > 0) & (F.exists(ops, lambda x: ~known(x)) | (F.try_element_at(ops, F.lit(-1))["kind"] != "rollup") | F.array_join(F.transform(ops, rates), "").contains("dd"))


def transformed(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Aggregated rows with the operations before their first rollup applied: absolute values and one derivative, in their order."""
    kinds = F.transform(_head(F.col("ops")), lambda x: x["transform"])
    rate = F.array_position(kinds, "PerSecond")
    absolute = lambda part: F.array_contains(part, "Absolute")
    before = absolute(F.when(rate > 0, F.slice(kinds, 1, (rate - 1).cast("int"))).otherwise(kinds))
    after = (rate > 0) & absolute(F.slice(kinds, F.greatest(F.lit(1), (rate + 1).cast("int")), F.size(kinds)))
    series = Window.partitionBy(*ENTRY, *KEY, "agg_type").orderBy("window_nanos")
    rows = rows.withColumns({"rated": rate > 0, "after": after, "value": F.when(before, F.abs("value")).otherwise(F.col("value"))})
    old, since = F.lag("value").over(series), F.col("window_nanos") - F.lag("window_nanos").over(series)
    change = (F.col("value") - old) / (since / NANOS)
    nan = F.lit(float("nan"))
    out = F.when(old.isNull() | F.isnan(old) | F.isnan("value"), nan)
    out = out.otherwise(change) if options.keep_resets else out.when(change < 0, nan).otherwise(change)
    moved = rows.withColumn("value", F.when(F.col("rated"), out).otherwise(F.col("value")))
    return moved.withColumn("value", F.when(F.col("after"), F.abs("value")).otherwise(F.col("value"))).drop("rated", "after")


def forward(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Aggregated rows whose pipeline goes on, as input of the next stage: its rollup's id and types, one hop more."""
    ops = F.col("ops")
    at = F.array_position(F.transform(ops, lambda x: x["kind"]), "rollup").cast("int")
    roll = F.element_at(ops, at)
    out = transformed(rows.where(F.size("ops") > 0), options).select(
        F.lit(FORWARDED).alias("category"), "type", roll["rollup_id"].alias("id"), types_or_default(roll["rollup_aggs"], F.col("type")).alias("agg_types"), "resolution_s", "retention_s",
        F.slice(ops, at + 1, F.size(ops)).alias("ops"), (F.col("hops") + 1).alias("hops"), "value", F.col("window_nanos").alias("ts_nanos"), F.col("window_nanos").alias("arrival_nanos"), F.hash("id", "agg_type").cast("bigint").alias("seq"))
    return out.where(~F.isnan("value")) if options.discard_nan else out


def named(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Output rows of entries without further operations, under their output names; timed entries keep the bare id."""
    default = types_or_default(F.array().cast("array<string>"), F.col("type"))
    prefix = F.element_at(F.create_map(*[F.lit(x) for p in options.prefixes.items() for x in p]), F.col("type"))
    suffix = F.element_at(F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p]), F.col("agg_type"))
    bare = (F.col("type") != TIMER) & (F.col("agg_types") == default)
    name = F.when(F.col("category") == TIMED, F.col("id")).otherwise(F.concat(prefix, "id", F.when(bare, "").otherwise(suffix)))
    return discard_nan(rows.where(F.size("ops") == 0).select(name.alias("metric_id"), F.col("window_nanos").alias("ts_nanos"), "agg_type", "value", "resolution_s", "retention_s"), options)


def run(keyed: DataFrame, hops: int = 2, options: Options = Options()) -> DataFrame:
    """Output rows of keyed samples, after as many as ``hops`` rollups.

    Rows whose operations are invalid are left out; a pipeline with more rollups than ``hops`` is an error
    when it is met.
    """
    good = keyed.where(~invalid_ops(F.col("ops")))
    rows = aggregate(good, options)
    out = named(rows, options)
    for _ in range(hops):
        rows = aggregate(forward(rows, options), options)
        out = out.unionByName(named(rows, options))
    deeper = F.assert_true(F.size("ops") == 0, "a pipeline has more rollups than hops")
    return out.unionByName(named(rows.where(F.size("ops") > 0).where(deeper.isNotNull()), options)) if hops else out


def latency(forwarded_samples: DataFrame, resolution_s: int, options: Options = Options(), buckets: int = 40) -> DataFrame:
    """How long forwarded samples took: num_forwarded, bucket (from 0; the last has all that is longer), from_s, n.

    Buckets are equal parts of twice the delay that the hops allow.
    """
    first, each = options.forwarding_delay(resolution_s)
    width = 2 * (F.lit(first) + F.lit(each) * F.col("num_forwarded")) * NANOS / buckets
    took = F.greatest(F.lit(0), F.col("arrival_nanos") - F.col("ts_nanos"))
    at = F.least(F.lit(buckets), F.floor(took / width)).cast("int")
    return forwarded_samples.groupBy("num_forwarded", at.alias("bucket"), (at * width / NANOS).alias("from_s")).agg(F.count(F.lit(1)).alias("n"))
