"""Sinks of aggregated rows. A sink is a function of a DataFrame (and, in streams, the batch number)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.sharding import shard

Sink = Callable[[DataFrame, int], None]
log = logging.getLogger(__name__)


class SinkConfigError(ValueError):
    pass


def blackhole() -> Sink:
    return lambda df, _: df.write.format("noop").mode("overwrite").save()


def logging_sink(rows: int | None = None) -> Sink:
    """Every row goes to the log of the executor that holds it; with ``rows``, a look at so many rows goes to the driver's."""

    def write(df: DataFrame, batch: int) -> None:
        if rows is not None:
            for row in df.limit(rows).collect():
                log.info("batch %s: %s", batch, row)
            return
        df.foreachPartition(lambda part: _log_rows(part, batch))

    return write


def _log_rows(part: Iterable[Row], batch: int) -> None:
    """On an executor: Python workers start without logging set up, so what is below a warning would be lost."""
    if not logging.getLogger().handlers:
        logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    if not log.isEnabledFor(logging.INFO):
        log.setLevel(logging.INFO)
    for row in part:
        log.info("batch %s: %s", batch, row)


def with_encode_time(df: DataFrame, rate: float) -> DataFrame:
    """``encoded_nanos``: the time of writing for a random part (``rate``, 0 to 1) of the rows, else null; consumers measure their lag by it."""
    if not 0 <= rate <= 1:
        raise SinkConfigError(f"a rate between 0 and 1: {rate}")
    return df.withColumn("encoded_nanos", F.when(F.rand() < rate, F.unix_micros(F.current_timestamp()) * 1000))


def with_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", shard(F.col("metric_id"), shards))


def _once(df: DataFrame, path: str, batch: int, fmt: str, by: tuple[str, ...] = ()) -> None:
    """Write a batch to a folder of its own, unless it has been written: then Spark tries it a second time."""
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/batch={batch}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").partitionBy(*by).format(fmt).save(folder)


def sharded_files(path: str, shards: int, only: set[int] | None = None, fmt: str = "parquet") -> Sink:
    """Files in a folder for each batch and shard; ``only`` keeps the shards that a consumer asks for. Each batch is written once."""

    def write(df: DataFrame, batch: int) -> None:
        out = df if "shard" in df.columns else with_shard(df, shards)
        if only is not None:
            out = out.where(F.col("shard").isin(*sorted(only)))
        _once(out, path, batch, fmt, ("shard",))

    return write


def files(path: str, fmt: str = "parquet") -> Sink:
    """Files in a folder for each batch. Each batch is written once."""
    return lambda df, batch: _once(df, path, batch, fmt)


def kafka(servers: str, topic: str) -> Sink:
    """At-least-once delivery through Spark's Kafka sink, where its package is on the class path."""

    def write(df: DataFrame, batch: int) -> None:
        df.select(F.col("metric_id").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def broadcast(*sinks: Sink) -> Sink:
    """Every sink gets every row, worked out once; what fails is raised after all have been tried."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        failed = []
        try:
            for sink in sinks:
                try:
                    sink(df, batch)
                except Exception as e:  # noqa: BLE001
                    failed.append(e)
        finally:
            df.unpersist()
        if failed:
            raise ExceptionGroup("sinks failed", failed)

    return write


def controlled(sink: Sink, allowed: Callable[[], bool]) -> Sink:
    """Rows pass as long as ``allowed()``; else they are dropped, which is no error."""
    return lambda df, batch: sink(df, batch) if allowed() else None


def from_config(config: dict) -> Sink:
    """A sink of a configuration with ``type`` and, for forwarding, a static or a dynamic backend."""
    kind = config.get("type")
    if kind == "blackhole":
        return blackhole()
    if kind == "logging":
        return logging_sink()
    if kind == "broadcast":
        return broadcast(*map(from_config, config["sinks"]))
    if kind != "forward":
        raise SinkConfigError(f"unknown sink {kind!r}")
    static, dynamic = config.get("static"), config.get("dynamic")
    if (static is None) == (dynamic is None):
        raise SinkConfigError("either a static or a dynamic backend")
    if dynamic is not None:
        return kafka(dynamic["servers"], dynamic["topic"])
    path, groups = static.get("path"), static.get("shards")
    if (path is None) == (groups is None):
        raise SinkConfigError("either one path or paths by shards")
    if path is not None:
        return files(path)
    from ..functions.sharding import shard_set

    total, seen = static["total_shards"], []
    for g in groups:
        seen += shard_set(g["set"])
    if sorted(seen) != list(range(total)):
        raise SinkConfigError("each shard belongs to one path")
    every = broadcast(*[sharded_files(g["path"], total, shard_set(g["set"])) for g in groups])
    return lambda df, batch: every(with_shard(df, total), batch)  # shards are worked out once for all groups
