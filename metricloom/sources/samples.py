"""Samples: one row per value, whatever the message it came in.

Columns: type, id, value (double), ts_nanos (arrival time of untimed samples, event time of timed
and forwarded ones), arrival_nanos, seq (order of arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import nanos
from ..plans.rules import COUNTER, GAUGE, METRIC_TYPES, TIMER

POLICY = "struct<resolution_s:bigint,retention_s:bigint>"
OP = "struct<kind:string,transform:string,rollup_id:string,rollup_aggs:array<string>>"
METADATA = f"struct<cutover_nanos:bigint,tombstoned:boolean,pipelines:array<struct<agg_types:array<string>,policies:array<{POLICY}>,ops:array<{OP}>>>>"
MESSAGE = f"msg_type string, type string, id string, counter bigint, timer array<double>, gauge double, ts_nanos bigint, value double, `values` array<double>, arrival_nanos bigint, seq bigint, source_id int, num_forwarded int, resolution_s bigint, metas array<{METADATA}>"
MESSAGE_TYPES = {
    "counter_with_metadatas": COUNTER, "batch_timer_with_metadatas": TIMER, "gauge_with_metadatas": GAUGE,
    "forwarded_metric_with_metadata": None, "timed_metric_with_metadata": None,
}


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages of all kinds, with a column ``reject`` for those that are not one of them."""
    m = lines.select(F.from_json(column, MESSAGE).alias("m")).select("m.*")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in MESSAGE_TYPES.items() if v for x in (k, v)]), F.col("msg_type")), F.col("type"))
    reject = F.when(F.col("msg_type").isNull() | ~F.col("msg_type").isin(*MESSAGE_TYPES), "unknown_message_type").when(kind.isNull() | ~kind.isin(*METRIC_TYPES), "unknown_metric_type")
    return m.withColumn("type", kind).withColumn("reject", reject)


def branch(messages: DataFrame, *kinds: str) -> DataFrame:
    """The accepted messages of the kinds."""
    return messages.where(F.col("reject").isNull() & F.col("msg_type").isin(*kinds))


def values_of(untimed: DataFrame) -> DataFrame:
    """One row per value of a counter, gauge or batch timer (an empty batch has none); a counter's whole number is in ``whole``, too, as not every bigint is a double."""
    values = F.when(F.col("type") == COUNTER, F.array(F.col("counter").cast("double"))).when(F.col("type") == TIMER, F.col("timer")).otherwise(F.array("gauge"))
    return untimed.withColumn("value", F.explode(values)).withColumn("whole", F.when(F.col("type") == COUNTER, F.col("counter"))).drop("counter", "timer", "gauge")


def check_metric_type(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of a known metric type, and the others."""
    known = F.coalesce(F.col("type").isin(*METRIC_TYPES), F.lit(False))
    return samples.where(known), samples.where(~known)


def sample(df: DataFrame, metric_type: str, metric_id: Column, value: Column, ts: Column, seq: Column, **more: Column) -> DataFrame:
    """Rows of a table as samples that arrive when they happen."""
    made = df.select(F.lit(metric_type).alias("type"), metric_id.alias("id"), value.cast("double").alias("value"), nanos(ts).alias("ts_nanos"), seq.cast("bigint").alias("seq"), *[c.alias(k) for k, c in more.items()])
    return made.withColumn("arrival_nanos", F.col("ts_nanos"))


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sample(e, COUNTER, F.concat(F.lit("events."), "event_type"), F.expr("try_cast(value AS bigint)"), F.col("ts"), F.col("event_id"))


def event_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sample(e, GAUGE, F.concat(F.lit("user."), F.col("user_id").cast("string")), F.col("value"), F.col("ts"), F.col("event_id"))


def shipping_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return sample(rows, TIMER, F.concat(F.lit("ship."), "l_returnflag"), F.col("l_extendedprice"), F.col("l_shipdate"), F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch timer for each day and priority: all order totals of it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz")
    batches = o.groupBy(F.col("o_orderpriority").alias("p"), day.alias("day")).agg(F.collect_list("o_totalprice").alias("timer"), F.min("o_orderkey").alias("seq"))
    return batches.select(F.lit(TIMER).alias("type"), F.concat(F.lit("orders."), "p").alias("id"), F.lit(None).cast("bigint").alias("counter"), "timer", F.lit(None).cast("double").alias("gauge"), nanos(F.col("day")).alias("ts_nanos"), nanos(F.col("day")).alias("arrival_nanos"), "seq")
