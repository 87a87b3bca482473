"""The writing side: samples as messages, one JSON object a line, which ``samples.decode`` reads.

A message kind has the columns that ``samples.MESSAGE`` names; columns that a kind does not use may be
left out. Messages wait until ``flush``, so that a job writes many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sharding import shard
from ..operators.admission import client_may_write
from ..plans.rules import COUNTER, GAUGE, TIMER
from .samples import MESSAGE_TYPES

FIELDS = ("msg_type", "type", "id", "counter", "timer", "gauge", "ts_nanos", "value", "values", "arrival_nanos", "seq", "source_id", "num_forwarded", "resolution_s", "metas")
UNTIMED = {v: k for k, v in MESSAGE_TYPES.items() if v}


def encode(messages: DataFrame) -> DataFrame:
    """Rows with the columns of a message as a column ``value`` of JSON, beside their shard where they have one."""
    kept = [c for c in FIELDS if c in messages.columns]
    own = [c for c in ("shard",) if c in messages.columns]
    return messages.select(*own, F.to_json(F.struct(*kept)).alias("value"))


def split_batches(timers: DataFrame, largest: int) -> DataFrame:
    """Batch timers with no more than ``largest`` values each (0: no bound); an empty batch stays one message."""
    if not largest:
        return timers
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("timer") - 1), F.lit(largest))
    return timers.withColumn("timer", F.explode(F.transform(starts, lambda at: F.slice("timer", at + 1, largest))))


class Client:
    """Writes messages to a folder of text files, in a folder for each shard."""

    def __init__(self, path: str, shards: int, max_timer_batch: int = 0, in_range: Column | None = None):
        """``in_range`` (of the column ``shard`` and others, see :func:`may_write`) says which messages a shard takes now."""
        self.path, self.shards, self.max_timer_batch, self.in_range = path, shards, max_timer_batch, in_range
        self.waiting: list[DataFrame] = []
        self.closed = False

    def untimed(self, metric_type: str, rows: DataFrame) -> None:
        """``id``, ``metas`` and ``counter``, ``timer`` (an array) or ``gauge``."""
        if metric_type not in (COUNTER, TIMER, GAUGE):
            raise ValueError(f"unknown metric type {metric_type!r}")
        made = split_batches(rows, self.max_timer_batch) if metric_type == TIMER else rows
        self._add(made.withColumn("msg_type", F.lit(UNTIMED[metric_type])))

    def timed(self, rows: DataFrame) -> None:
        """``type``, ``id``, ``value``, ``ts_nanos`` and the policy's ``resolution_s``."""
        self._add(rows.withColumn("msg_type", F.lit("timed_metric_with_metadata")))

    def forwarded(self, rows: DataFrame) -> None:
        """``type``, ``id``, ``values``, ``ts_nanos``, ``source_id``, ``num_forwarded`` and ``resolution_s``."""
        self._add(rows.withColumn("msg_type", F.lit("forwarded_metric_with_metadata")))

    def _add(self, rows: DataFrame) -> None:
        if self.closed:
            raise RuntimeError("the client is closed")
        made = rows.withColumn("shard", shard(F.col("id"), self.shards))
        self.waiting.append(encode(made if self.in_range is None else made.where(self.in_range)))

    def flush(self) -> None:
        """Write what waits, as one job; what fails to be written goes on waiting."""
        if not self.waiting:
            return
        rows = self.waiting[0]
        for more in self.waiting[1:]:
            rows = rows.unionByName(more)
        rows.write.mode("append").partitionBy("shard").text(self.path)
        self.waiting.clear()

    def close(self) -> None:
        if self.closed:
            raise RuntimeError("the client is closed already")
        self.flush()
        self.closed = True


def may_write(now: Column, ranges: dict[int, tuple[int, int]], warm_up: int, linger: int) -> Column:
    """For ``Client(in_range=...)``: cutover and cutoff by shard; shards without a range take nothing."""
    at = lambda i: F.create_map(*[F.lit(x) for s, r in ranges.items() for x in (s, r[i])])[F.col("shard")]
    return F.coalesce(client_may_write(now, at(0), at(1), warm_up, linger), F.lit(False)) if ranges else F.lit(False)
