"""Which samples are taken. Each filter is a column, so that rejects can be kept with their reason."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import NANOS, whole
from ..plans.rules import Options


def too_far_in_the_future(ts: Column, now: Column, buffer_nanos: int) -> Column:
    return ts - now > buffer_nanos


def too_far_in_the_past(ts: Column, now: Column, buffer_nanos: Column | int) -> Column:
    return now - ts > buffer_nanos


def timed(samples: DataFrame, resolution_s: int, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Timed samples within the buffers (both borders are in), and the others with a reason."""
    ts, now = F.col("ts_nanos"), F.col("arrival_nanos")
    reason = F.when(too_far_in_the_future(ts, now, options.buffer_future_s * NANOS), "too_far_in_the_future").when(
        too_far_in_the_past(ts, now, options.buffer_past_s(resolution_s) * NANOS), "too_far_in_the_past")
    return split(samples, reason)


def forwarded(samples: DataFrame, resolution_s: int, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Forwarded samples that come within the delay that their hops allow, and the others."""
    first, each = (F.lit(int(s * NANOS)) for s in options.forwarding_delay(resolution_s))
    late = F.col("arrival_nanos") - F.col("ts_nanos") > first + F.col("num_forwarded") * each
    return split(samples, F.when(late, "arrived_too_late"))


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reject", reason)
    return marked.where("reject IS NULL").drop("reject"), marked.where("reject IS NOT NULL")


def value_rate_limit(samples: DataFrame, limit: int, values: Column | None = None, keys: tuple[str, ...] = ("type", "id")) -> tuple[DataFrame, DataFrame]:
    """At most ``limit`` values per second and series; what is rejected uses up the second's budget, too."""
    second = whole(F.col("arrival_nanos"), NANOS)
    running = Window.partitionBy(*keys, second).orderBy("arrival_nanos", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.lit(1) if values is None else values).over(running)
    return split(samples.withColumn("used", used), F.when(F.col("used") > limit, "value_rate_limit"))


def new_series_rate_limit(samples: DataFrame, limit: int, shard: Column, warm_up_until_nanos: int = 0) -> DataFrame:
    """``samples`` with ``accepted``: false for those of a series that is new when its shard's second has had ``limit`` tries.

    Only a series' first try in a second can get it in, so these are aggregated first. They then go
    through each shard in order of arrival (tries depend on each other, so a shard is one task), where
    only the shard's series are held; the times from which series are in go back to the samples by a join.
    """
    made = samples.withColumn("shard", shard)
    order = F.struct("arrival_nanos", "seq")
    tries = made.groupBy("shard", "type", "id", whole(F.col("arrival_nanos"), NANOS).alias("second")).agg(F.min(order).alias("first")).select("shard", "type", "id", "second", "first.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = (None, None)
        used, known = 0, set()
        for batch in batches:
            columns = {k: batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("shard", "second", "arrival_nanos", "type", "id")}
            got = []
            for i, (s, second, t, kind, name) in enumerate(zip(*columns.values(), strict=True)):
                if s != now[0]:
                    known, now = set(), (s, None)
                if (kind, name) in known:
                    continue
                if t >= warm_up_until_nanos:
                    if second != now[1]:
                        now, used = (s, second), 0
                    used += 1
                    if used > limit:
                        continue
                known.add((kind, name))
                got.append(i)
            yield batch.take(pa.array(got, pa.int64()))

    entered = tries.repartition("shard").sortWithinPartitions("shard", "arrival_nanos", "seq").mapInArrow(run, tries.schema)
    since = entered.select("shard", "type", "id", F.struct("arrival_nanos", "seq").alias("since"))
    return made.join(since, ["shard", "type", "id"], "left").withColumn("accepted", F.coalesce(order >= F.col("since"), F.lit(False))).drop("since")


def writable(now: Column, cutover: Column | int, cutoff: Column | int, before: int, after: int) -> Column:
    """Whether a shard takes samples: from ``before`` its cutover to (not at) ``after`` its cutoff."""
    return (now >= cutover - before) & (now < cutoff + after)


def client_may_write(now: Column, cutover: Column | int, cutoff: Column | int, warm_up: int, linger: int) -> Column:
    """The client's range is closed on both sides."""
    return (now >= cutover - warm_up) & (now <= cutoff + linger)


def flushed_locally(out_ts: Column, cutover: Column | int, cutoff: Column | int) -> Column:
    """Untimed and timed windows that are written: behind the cutover, up to the cutoff."""
    return (out_ts > cutover) & (out_ts <= cutoff)


def flush_action(out_ts: Column, target: int, cutover: Column | int, cutoff: Column | int, buffer_nanos: int) -> Column:
    """What a flush up to ``target`` does with the window that is written at ``out_ts``.

    ``discard`` up to the shard's cutover (0: it has none), ``consume`` up to its cutoff; behind that,
    ``retain`` for ``buffer_nanos``, in case the shard comes back, and ``discard`` after. Windows that end
    behind the target are still open and are retained.
    """
    return F.when(out_ts > target, "retain").when((F.lit(0) < cutover) & (out_ts <= cutover), "discard").when(out_ts <= cutoff, "consume").when(
        out_ts <= target - buffer_nanos, "discard").otherwise("retain")


def owned(samples: DataFrame, shard: Column, shards: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    """Samples whose shard is one of those that are owned here, and the others."""
    return split(samples, F.when(~F.coalesce(shard.isin(*sorted(shards)), F.lit(False)), "shard_not_owned"))


def flushed_forwarded(out_ts: Column, cutover: Column | int, cutoff: Column | int) -> Column:
    return (out_ts >= cutover) & (out_ts < cutoff)


def active_metadata(metas: Column, now: Column) -> Column:
    """The last of the sorted metadata that is in force."""
    return F.try_element_at(F.filter(metas, lambda m: m["cutover_nanos"] <= now), F.lit(-1))


def resolve_metadata(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Untimed samples with ``meta``, the metadata that they are aggregated under, and rejects.

    A sample whose metadata is older than what its series already has is aggregated under the newer (of
    several with one cutover, the one that was new last). Tombstoned samples are dropped without a
    reason and leave the series as it is. A series' samples need not stand together: what is
    gathered by series is only when it first had each of its metadata.
    """
    live = samples.withColumn("own", F.when(F.size("metas") > 0, active_metadata(F.col("metas"), F.col("arrival_nanos"))))
    reason = F.when(F.coalesce(F.size("metas"), F.lit(0)) < 1, "empty_metadatas").when(F.col("own").isNull(), "no_applicable_metadata").when(
        ~F.col("own.tombstoned") & (F.coalesce(F.size("own.pipelines"), F.lit(0)) < 1), "no_pipelines")
    good, bad = split(live, reason)
    untombstoned = good.where("NOT own.tombstoned")
    order = F.struct("arrival_nanos", "seq")
    changes = good.groupBy("type", "id", "own").agg(F.min(order).alias("since"))
    by_series = changes.groupBy("type", "id").agg(F.collect_list(F.struct(F.col("own.cutover_nanos").alias("cutover"), "since", "own")).alias("changes"))
    newer = F.filter("changes", lambda c: (c["since"] <= order) & (c["cutover"] > F.col("own.cutover_nanos")))
    newest = F.array_max(F.transform(newer, lambda c: F.struct(c["cutover"].alias("cutover"), c["since"].alias("since"), c["own"].alias("own"))))
    resolved = untombstoned.join(by_series, ["type", "id"]).withColumn("meta", F.coalesce(newest["own"], F.col("own")))
    return resolved.drop("own", "changes"), bad.drop("own")


def first_from_each_source(forwarded: DataFrame, keys: list[str]) -> DataFrame:
    """Of the batches of one source for a window only the first to arrive counts."""
    columns = [c for c in forwarded.columns if c not in keys]
    first = F.min_by(F.struct(*columns), F.struct("arrival_nanos", "seq"))
    return forwarded.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*")


def expired(last_access: DataFrame, now_nanos: int, ttl_nanos: int) -> DataFrame:
    """Series (with a column last_nanos) that have not been written for longer than ``ttl_nanos``."""
    return last_access.where(F.lit(now_nanos) > F.col("last_nanos") + F.lit(ttl_nanos))
