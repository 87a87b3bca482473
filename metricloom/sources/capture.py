"""Capture: what an engine was given, kept as it came, for tests and for replay.

Messages are added as rows, counted, and handed out once by a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import MESSAGE_TYPES

UNTIMED_KINDS = tuple(k for k, v in MESSAGE_TYPES.items() if v)
TIMED_KIND, FORWARDED_KIND = "timed_metric_with_metadata", "forwarded_metric_with_metadata"


class Capture:
    """Keeps messages under ``path``, which executors share: a folder for each time between two snapshots."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.turn, self.added = spark, path.rstrip("/"), 0, 0

    def _add(self, messages: DataFrame, kinds: tuple[str, ...]) -> None:
        good = F.coalesce(F.col("msg_type").isin(*kinds), F.lit(False))
        checked = messages.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not for this call: "), F.coalesce("msg_type", F.lit("null"))))))
        checked.write.parquet(f"{self.path}/turn={self.turn}/add={self.added}")
        self.added += 1

    def add_untimed(self, messages: DataFrame) -> None:
        self._add(messages, UNTIMED_KINDS)

    def add_timed(self, messages: DataFrame) -> None:
        self._add(messages, (TIMED_KIND,))

    def add_forwarded(self, messages: DataFrame) -> None:
        self._add(messages, (FORWARDED_KIND,))

    def sink(self):
        """A sink of streams of any messages. A batch that Spark tries a second time is kept once."""

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.path}/turn={self.turn}/batch={batch}")
            self.added += 1

        return write

    def _rows(self) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{self.path}/turn={self.turn}") if self.added else None

    def num_metrics_added(self) -> int:
        """How many messages came since the last snapshot."""
        rows = self._rows()
        return 0 if rows is None else rows.count()

    def snapshot(self) -> dict[str, DataFrame]:
        """The messages since the last snapshot, by kind (those that came); from now on they count no more."""
        rows = self._rows()
        self.turn, self.added = self.turn + 1, 0
        if rows is None:
            return {}
        kinds = [r.msg_type for r in rows.select("msg_type").distinct().collect()]  # five at most
        return {k: rows.where(F.col("msg_type") == k) for k in sorted(kinds)}
