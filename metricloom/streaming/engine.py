"""Streaming: admission, metadata and limits by keyed state, windows closed by watermark, derivatives, rollups, and the engine around them.

Spark runs no keyed state of these kinds behind an aggregation in one query, and each hop of a rollup has
its own delay anyway: so a chain is several queries, each reading what the one before has written. The
limit of new series (``operators.admission``) runs in batch only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.aggregates import all_of
from ..functions.windows import NANOS, SECONDS_BEFORE_1970, whole
from ..operators import aggregate as A
from ..operators.admission import active_metadata
from ..operators.admission import forwarded as admit_forwarded
from ..operators.admission import timed as admit_timed
from ..operators.pipeline import roll_up
from ..plans.rules import Options, Rollup, RuntimeLimits, StoragePolicy, check_types


def with_time(samples: DataFrame) -> DataFrame:
    """A timestamp column ``ts`` for windows and watermarks, from ts_nanos."""
    return samples.withColumn("ts", F.timestamp_micros(whole(F.col("ts_nanos"), 1000)))


def windowed(samples: DataFrame, metric_type: str, agg_types: tuple[str, ...], policy: StoragePolicy, options: Options = Options(), delay_s: int | None = None, aligned: bool = False) -> DataFrame:
    """Output rows of closed windows (append mode): the streaming form of ``operators.aggregate.untimed``.

    The watermark only says when a window is closed; which samples are taken is decided before, row by
    row. The delay defaults to the past buffer of the policy. Forwarded samples are ``aligned``: they keep
    their time.
    """
    types = check_types(metric_type, agg_types)
    r = policy.resolution_s
    delay = options.buffer_past_s(r) if delay_s is None else delay_s
    own = with_time(samples).where(F.col("type") == metric_type).withColumn("value", A.typed_value(samples, metric_type)).where("value IS NOT NULL")
    start = f"{-SECONDS_BEFORE_1970 % r} seconds"
    grouped = own.withWatermark("ts", f"{delay} seconds").groupBy("type", "id", F.window("ts", f"{r} seconds", f"{r} seconds", start).alias("w"))
    made, read = all_of(types, metric_type, F.col("value"), F.struct("arrival_nanos", "seq"), options)
    wide = grouped.agg(*made)
    rows = F.array(*[F.struct(F.lit(t).alias("agg_type"), F.lit(i).alias("agg_order"), read[t].alias("value")) for i, t in enumerate(types)])
    keyed = wide.select("type", "id", F.lit(r).cast("bigint").alias("resolution_s"), F.lit(policy.retention_s).cast("bigint").alias("retention_s"), (F.unix_micros("w.start" if aligned else "w.end") * 1000).alias("window_nanos"), F.inline(rows))
    return keyed


_SAMPLE = "type string, id string, value double, ts_nanos bigint, arrival_nanos bigint, seq bigint"


def _timeout(ttl_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _idle(state: GroupState) -> bool:
    """Whether the call is for a series that has been idle for too long, which is then forgotten."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def _seen(state: GroupState, ttl_ms: int | None) -> None:
    if ttl_ms is not None:
        state.setTimeoutDuration(ttl_ms)


def by_newest_metadata(samples: DataFrame, metas: str = "metas", ttl_ms: int | None = None) -> DataFrame:
    """The streaming form of ``operators.admission.resolve_metadata``: samples with ``meta`` as JSON; rejects and tombstoned ones are left out.

    What a series keeps is its newest metadata; samples of one micro-batch go in order of arrival. After
    ``ttl_ms`` without a sample (if set) the series is forgotten, its metadata too.
    """
    own = active_metadata(F.col(metas), F.col("arrival_nanos"))
    good = samples.withColumn("own", own).where("own IS NOT NULL AND (own.tombstoned OR size(own.pipelines) > 0)")
    slim = good.select("type", "id", "value", "ts_nanos", "arrival_nanos", "seq", F.col("own.cutover_nanos").alias("cutover"), F.col("own.tombstoned").alias("tombstoned"), F.to_json("own").alias("meta"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state):
            return
        rows = pd.concat(list(frames)).sort_values(["arrival_nanos", "seq"])
        newest, meta = state.get if state.exists else (None, None)
        metas = []
        for cutover, own in zip(rows["cutover"], rows["meta"], strict=True):
            if newest is None or cutover >= newest:
                newest, meta = int(cutover), own
            metas.append(meta)
        state.update((newest, meta))
        _seen(state, ttl_ms)
        rows["meta"] = metas
        yield rows[~rows["tombstoned"]][["type", "id", "value", "ts_nanos", "arrival_nanos", "seq", "meta"]]

    return slim.groupBy("type", "id").applyInPandasWithState(step, _SAMPLE + ", meta string", "cutover bigint, meta string", "append", _timeout(ttl_ms))


def value_usage(samples: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Samples with ``used``, how many values their series and second have had with them.

    What a series keeps is its last second and what that has used, until ``ttl_ms`` without a sample (if
    set). Samples of a second that is over are held against nothing but each other.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state):
            return
        rows = pd.concat(list(frames)).sort_values(["arrival_nanos", "seq"])
        second = rows["arrival_nanos"] // NANOS
        used = rows.groupby(second).cumcount() + 1
        if state.exists:
            last, before = state.get
            used = used + (second == last) * before
        last = int(second.iloc[-1])
        state.update((last, int(used[second == last].max())))
        _seen(state, ttl_ms)
        yield rows.assign(used=used)

    slim = samples.select("type", "id", "value", "ts_nanos", "arrival_nanos", "seq")
    return slim.groupBy("type", "id").applyInPandasWithState(step, _SAMPLE + ", used bigint", "second bigint, used bigint", "append", _timeout(ttl_ms))


def value_rate_limit(samples: DataFrame, limits: RuntimeLimits, ttl_ms: int | None = None) -> DataFrame:
    """The streaming form of ``operators.admission.value_rate_limit``: the samples that are taken under the limit that holds when the query starts."""
    limit, rows = limits.values_per_second, value_usage(samples, ttl_ms)
    return (rows.where(F.col("used") <= limit) if limit else rows).drop("used")


def under(limits: RuntimeLimits, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink for :func:`value_usage`: a batch is admitted under the limit that holds when it begins."""

    def write(df: DataFrame, batch: int) -> None:
        limit = limits.values_per_second
        sink((df.where(F.col("used") <= limit) if limit else df).drop("used"), batch)

    return write


def admitted(samples: DataFrame, resolution_s: int, options: Options = Options(), forwarded: bool = False) -> DataFrame:
    """Timed or forwarded samples within their buffers; these filters look at one row each, so they are those of the batch form."""
    return (admit_forwarded if forwarded else admit_timed)(samples, resolution_s, options)[0]


def hop(rows: DataFrame, rollup: Rollup, metric_type: str, policy: StoragePolicy, options: Options = Options(), delay_s: int | None = None) -> DataFrame:
    """The next stage of a pipeline: closed windows (a stream over what the stage before has written) rolled up.

    Absolute values and rates come before it (``operators.pipeline.absolute``, :func:`rates`). The delay
    defaults to what a single hop may take.
    """
    delay = math.ceil(options.max_forwarding_delay_s(policy.resolution_s, 1)) if delay_s is None else delay_s
    return windowed(roll_up(rows, rollup, options), metric_type, rollup.agg_types, policy, options, delay, aligned=True)


def distinct_sources(forwarded: DataFrame, keys: list[str], delay_s: int) -> DataFrame:
    """The first batch of each source and window, with state that goes when the watermark passes."""
    return with_time(forwarded).withWatermark("ts", f"{delay_s} seconds").dropDuplicatesWithinWatermark(keys).drop("ts")


_RATE_KEYS = ["type", "id", "resolution_s", "retention_s", "agg_type"]
_RATE_SCHEMA = "type string, id string, resolution_s bigint, retention_s bigint, agg_type string, window_nanos bigint, value double"


def rates(rows: DataFrame, options: Options = Options(), ttl_ms: int | None = None) -> DataFrame:
    """Change per second of closed windows in a stream; a series' last window is state, which goes after
    ``ttl_ms`` without one (if set: for queries that keep running, as Spark then waits for time to pass).

    ``rows`` is a stream over what a query of :func:`windowed` has written: Spark runs no state of this
    kind behind an aggregation in the same query, and each hop has its own delay anyway.
    """
    keep_resets = options.keep_resets

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _idle(state):
            return
        rows = pd.concat(list(frames)).sort_values("window_nanos")
        at, before = state.get if state.exists else (None, None)
        out = []
        for now, value in zip(rows["window_nanos"], rows["value"], strict=True):
            rate = float("nan") if at is None else (value - before) / ((now - at) / NANOS)
            out.append(float("nan") if rate < 0 and not keep_resets else rate)
            at, before = int(now), float(value)
        state.update((at, before))
        _seen(state, ttl_ms)
        made = pd.DataFrame([key] * len(rows), columns=_RATE_KEYS)
        made["window_nanos"], made["value"] = rows["window_nanos"].to_numpy(), out
        yield made

    slim = rows.select(*_RATE_KEYS, "window_nanos", "value")
    made = slim.groupBy(*_RATE_KEYS).applyInPandasWithState(step, _RATE_SCHEMA, "at bigint, value double", "append", _timeout(ttl_ms))
    return made.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # pandas hands NaN on as null


@dataclass
class Engine:
    """Starts, watches and stops the queries of a set of rules: one for each resolution and hop, as their delays differ."""

    spark: SparkSession
    checkpoint: str
    options: Options = field(default_factory=Options)
    queries: dict = field(default_factory=dict)
    closed: bool = False

    def add(self, name: str, rows: DataFrame, sink: Callable[[DataFrame, int], None], available_now: bool = False, interval: str = "1 second") -> None:
        if self.closed:
            raise RuntimeError("the engine is closed")
        if name in self.queries:
            raise ValueError(f"{name} is running")
        writer = rows.writeStream.outputMode("append").option("checkpointLocation", f"{self.checkpoint}/{name}").queryName(name).foreachBatch(sink)
        self.queries[name] = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def status(self) -> dict[str, dict]:
        return {name: {"active": q.isActive, "status": q.status, "progress": q.lastProgress} for name, q in self.queries.items()}

    def tick(self) -> dict[str, dict[str, int]]:
        """How many series and windows each query holds after its last batch, how many that batch let go, and the bytes they take."""
        out = {}
        for name, q in self.queries.items():
            held = (q.lastProgress or {}).get("stateOperators") or []
            out[name] = {k: sum(int(s.get(source) or 0) for s in held) for k, source in (("active", "numRowsTotal"), ("expired", "numRowsRemoved"), ("bytes", "memoryUsedBytes"))}
        return out

    def healthy(self) -> bool:
        return not self.closed and all(q.exception() is None for q in self.queries.values())

    def wait(self, seconds: float | None = None) -> bool:
        """Wait for the queries to end, each for so long at most; whether all have."""
        return all([q.awaitTermination(seconds) is not False if seconds else q.awaitTermination() is None for q in self.queries.values()])

    def resign(self) -> None:
        """Stop emitting; the checkpoint lets another engine go on."""
        for q in self.queries.values():
            q.stop()
        self.queries.clear()

    def close(self) -> None:
        if self.closed:
            raise RuntimeError("the engine is closed already")
        self.resign()
        self.closed = True
