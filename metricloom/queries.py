"""The registered queries of the metrics engine over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sharding, tdigest
from .functions.windows import NANOS, whole, window_start
from .operators import admission
from .operators import aggregate as A
from .operators import governed as G
from .operators import pipeline as P
from .plans import rules as R
from .sources import samples as S

KEEP_NAN = R.Options(discard_nan=False)
EXACT = R.Options(exact_quantiles=True)  # what the SQL beside the queries computes
SHARDS = 1024
T0 = 1704067200 * NANOS  # 2024-01-01

ORACLES: dict[str, str] = {}
QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded so that the order of a sum does not show; large values to thousands."""
    return df.withColumn("value", F.when(F.abs("value") >= 1e9, F.round("value", -3)).otherwise(F.round("value", digits)))


def rounded_sql(digits: int) -> str:
    return f"CASE WHEN abs(value) >= 1e9 THEN round(value, -3) ELSE round(value, {digits}) END"


# ---- SQL building blocks ----

SOURCES = {
    "C": "SELECT 'events.' || event_type AS id, CAST(trunc(value) AS BIGINT) AS value, epoch_us(ts) * 1000 AS t, event_id AS seq FROM events",
    "G": "SELECT 'user.' || user_id AS id, value, epoch_us(ts) * 1000 AS t, event_id AS seq FROM events",
    "T": "SELECT 'ship.' || l_returnflag AS id, l_extendedprice AS value, epoch_us(l_shipdate) * 1000 AS t, l_orderkey * 8 + l_linenumber AS seq FROM lineitem",
}
NS = "CAST(1000000000 AS BIGINT)"
SQL_AGGS = {
    "Last": "arg_max(value, (t, seq))", "Min": "min(value)", "Max": "max(value)", "Mean": "sum(value) / count(value)", "Count": "count(value)", "Sum": "sum(value)",
    "SumSq": "sum(value * value)", "Stdev": "coalesce(stddev_samp(value), 0)",
} | {name: f"quantile_disc(value, {q})" for name, q in R.QUANTILES.items()}


def start_sql(t: str, r: int) -> str:
    return f"({t} - (({t} + {R.NANOS} * CAST({62135596800 % r} AS BIGINT)) % ({r} * {NS})))"


def windows_sql(source: str, types: tuple[str, ...], policies: tuple[R.StoragePolicy, ...], where: str = "true", at: str | None = None) -> str:
    """id, w, resolution_s, retention_s, agg_type, value of a source."""
    each = []
    for p in dict.fromkeys(policies):
        w = at or f"{start_sql('t', p.resolution_s)} + {p.resolution_s} * {NS}"
        for t in types:
            each.append(f"SELECT id, {w} AS w, CAST({p.resolution_s} AS BIGINT) AS resolution_s, CAST({p.retention_s} AS BIGINT) AS retention_s, '{t}' AS agg_type, CAST({SQL_AGGS[t]} AS DOUBLE) AS value FROM ({source}) WHERE {where} GROUP BY ALL")
    return " UNION ALL ".join(each)


def named_sql(rows: str, metric_type: str, types: tuple[str, ...], digits: int = 4, keep_nan: bool = False, bare: bool = False) -> str:
    only = types == R.DEFAULT_TYPES[metric_type]
    case = "CASE agg_type " + " ".join(f"WHEN '{t}' THEN '{R.suffix(metric_type, t, only)}'" for t in types) + " END"
    name = "id" if bare else f"'{R.PREFIXES[metric_type]}' || id || {case}"
    return f"SELECT {name} AS metric_id, CAST(w AS BIGINT) AS ts_nanos, agg_type, {rounded_sql(digits)} AS value, resolution_s, retention_s FROM ({rows})" + ("" if keep_nan else " WHERE NOT isnan(value)")


def rate_sql(rows: str) -> str:
    """Change per second of each series; NaN for the first window and for a fall."""
    return f"""SELECT id, w, resolution_s, retention_s, agg_type,
      CASE WHEN b IS NULL OR value < b THEN CAST('NaN' AS DOUBLE) ELSE (value - b) / ((w - bw) / 1e9) END AS value
    FROM (SELECT *, lag(value) OVER s AS b, lag(w) OVER s AS bw FROM ({rows}) WINDOW s AS (PARTITION BY id, resolution_s, retention_s, agg_type ORDER BY w))"""


def simple(name: str, source: str, metric_type: str, read, types: tuple[str, ...] = (), policies: tuple[str, ...] = ("1h:40d",)) -> None:
    chosen, each = R.check_types(metric_type, types), R.policies(*policies) if policies else R.DEFAULT_POLICIES
    QUERIES[name] = lambda spark, d: rounded(A.untimed(read(spark, d), metric_type, types, R.policies(*policies) if policies else (), EXACT))
    ORACLES[name] = named_sql(windows_sql(SOURCES[source], chosen, each), metric_type, chosen)


ALL_COUNTER = ("Sum", "SumSq", "Mean", "Min", "Max", "Count", "Stdev")
ALL_GAUGE = ("Last", "Sum", "SumSq", "Mean", "Min", "Max", "Count", "Stdev")

simple("counter_sum_1h", "C", R.COUNTER, S.event_counters)
simple("counter_all_types_1d", "C", R.COUNTER, S.event_counters, ALL_COUNTER, ("1d:400d",))
simple("gauge_last_1h", "G", R.GAUGE, S.event_gauges)
simple("gauge_all_types", "G", R.GAUGE, S.event_gauges, ALL_GAUGE, ("6h:40d",))
simple("timer_default_types", "T", R.TIMER, S.shipping_timers, (), ("7d:400d",))
simple("timer_many_quantiles", "T", R.TIMER, S.shipping_timers, ("Median", "P10", "P25", "P75", "P90", "P999", "P9999"), ("30d:400d",))
simple("custom_min", "G", R.GAUGE, S.event_gauges, ("Min",), ("1d:40d",))
simple("custom_min_max", "G", R.GAUGE, S.event_gauges, ("Min", "Max"), ("1d:40d",))
simple("multi_resolution_fanout", "C", R.COUNTER, S.event_counters, ("Sum", "Count", "Max"), ("1m:2d", "1h:40d", "1d:400d", "1h:40d"))
simple("default_policies", "C", R.COUNTER, S.event_counters, (), ())
simple("weekly_window_alignment", "C", R.COUNTER, S.event_counters, (), ("7d:400d", "7s:1d"))
simple("id_naming", "T", R.TIMER, S.shipping_timers, ("Min", "P99", "Count"), ("1d:40d",))


@query("timer_batch_explode", named_sql(windows_sql(
    "SELECT 'orders.' || o_orderpriority AS id, unnest(v) AS value, epoch_us(date_trunc('day', d)) * 1000 AS t, 0 AS seq FROM (SELECT o_orderpriority, date_trunc('day', o_orderdate) AS d, list(o_totalprice) AS v FROM orders GROUP BY ALL)",
    ("Sum", "Count", "P95", "Max"), R.policies("30d:400d")), R.TIMER, ("Sum", "Count", "P95", "Max")))
def timer_batch_explode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.untimed(S.values_of(S.order_batches(spark, d)), R.TIMER, ("Sum", "Count", "P95", "Max"), R.policies("30d:400d"), EXACT))


@query("coarse_from_fine", f"""SELECT id, CAST(w AS BIGINT) AS window_nanos, n AS "count", s AS "sum", mn AS "min", mx AS "max", l AS "last" FROM (
  SELECT id, {start_sql('t', 86400)} + 86400 * {NS} AS w, count(*) AS n, round(sum(value), 4) AS s, min(value) AS mn, max(value) AS mx, arg_max(value, (t, seq)) AS l FROM ({SOURCES['G']}) GROUP BY ALL)""")
def coarse_from_fine(spark: SparkSession, d: str) -> DataFrame:
    fine = A.in_windows(A.fan_out(S.event_gauges(spark, d), R.policies("1h:2d"))).groupBy(*A.WINDOW_KEYS).agg(
        F.count("value").alias("count"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sumsq"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.struct("arrival_nanos", "seq")).alias("last"), F.max(F.struct("arrival_nanos", "seq")).alias("last_order"))
    return A.coarser(fine, R.StoragePolicy.parse("1d:40d")).select("id", "window_nanos", "count", F.round("sum", 4).alias("sum"), "min", "max", "last")


# ---- admission ----

def delayed(spark: SparkSession, d: str) -> DataFrame:
    """Timed samples that come up to three hours late, or early."""
    return S.event_gauges(spark, d).withColumn("arrival_nanos", F.col("ts_nanos") + (F.col("seq") * 7919 % 14400 - 3600) * NANOS)


DELAYED = f"SELECT *, t + (seq * 7919 % 14400 - 3600) * {NS} AS a FROM ({SOURCES['G']})"


@query("timed_admission", named_sql(windows_sql(DELAYED, ("Sum", "Count"), R.policies("1h:2d"), f"t - a <= 60 * {NS} AND a - t <= 3660 * {NS}"), R.GAUGE, ("Sum", "Count"), bare=True))
def timed_admission(spark: SparkSession, d: str) -> DataFrame:
    good, _ = admission.timed(delayed(spark, d), 3600)
    return rounded(A.named(A.aggregate(good, R.GAUGE, ("Sum", "Count"), R.policies("1h:2d")), R.GAUGE, ("Sum", "Count"), bare=True))


@query("timed_late_filter", f"SELECT seq AS event_id, id FROM ({DELAYED}) WHERE t - a <= 60 * {NS} AND a - t > 3660 * {NS}")
def timed_late_filter(spark: SparkSession, d: str) -> DataFrame:
    return admission.timed(delayed(spark, d), 3600)[1].where("reject = 'too_far_in_the_past'").select(F.col("seq").alias("event_id"), "id")


@query("timed_future_filter", f"SELECT seq AS event_id, id FROM ({DELAYED}) WHERE t - a > 60 * {NS}")
def timed_future_filter(spark: SparkSession, d: str) -> DataFrame:
    return admission.timed(delayed(spark, d), 3600)[1].where("reject = 'too_far_in_the_future'").select(F.col("seq").alias("event_id"), "id")


def forwarded(spark: SparkSession, d: str) -> DataFrame:
    """Forwarded batches: aligned to minutes, from eight sources, over one or two hops."""
    g = delayed(spark, d)
    return g.select("type", F.concat(F.lit("fwd."), F.col("seq") % 20).alias("id"), window_start(F.col("ts_nanos"), F.lit(3600)).alias("ts_nanos"), F.array("value", F.col("value") * 2).alias("values"), "arrival_nanos", "seq", (F.col("seq") % 8).cast("int").alias("source_id"), (1 + F.col("seq") % 2).cast("int").alias("num_forwarded"))


FORWARDED = f"SELECT 'fwd.' || (seq % 20) AS id, {start_sql('t', 3600)} AS w, [value, value * 2] AS v, a, seq, seq % 8 AS source_id, 1 + seq % 2 AS hops FROM ({DELAYED})"


@query("forwarded_lateness", f"SELECT seq AS event_id FROM ({FORWARDED}) WHERE a - w > 3600 * hops * {NS}")
def forwarded_lateness(spark: SparkSession, d: str) -> DataFrame:
    return admission.forwarded(forwarded(spark, d), 3600)[1].select(F.col("seq").alias("event_id"))


@query("forwarded_dedupe", named_sql(windows_sql(
    f"SELECT id, w, unnest(v) AS value, a AS t, seq FROM (SELECT *, row_number() OVER (PARTITION BY id, w, source_id ORDER BY a, seq) AS n FROM ({FORWARDED})) WHERE n = 1",
    ("Sum", "Count"), R.policies("1h:2d"), at="w"), R.GAUGE, ("Sum", "Count")))
def forwarded_dedupe(spark: SparkSession, d: str) -> DataFrame:
    first = admission.first_from_each_source(forwarded(spark, d), ["type", "id", "ts_nanos", "source_id"])
    values = first.withColumn("value", F.explode("values"))
    return rounded(A.named(A.aggregate(values, R.GAUGE, ("Sum", "Count"), R.policies("1h:2d"), aligned=True), R.GAUGE, ("Sum", "Count")))


LIMITED = f"SELECT *, sum(n) OVER (PARTITION BY id, t // (3600 * {NS}) ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, 1 + seq % 3 AS n FROM ({SOURCES['C']}))"


@query("value_rate_limit", f"SELECT id, seq AS event_id FROM ({LIMITED}) WHERE used <= 8")
def value_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    # an hour counts as a second here: the events are far apart
    c = S.event_counters(spark, d).withColumn("arrival_nanos", whole(F.col("ts_nanos"), 3600))
    good, _ = admission.value_rate_limit(c, 8, 1 + F.col("seq") % 3)
    return good.select("id", F.col("seq").alias("event_id"))


@query("new_series_rate_limit")
def new_series_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    g = S.event_gauges(spark, d).withColumn("arrival_nanos", whole(F.col("ts_nanos"), 3600))
    return admission.new_series_rate_limit(g, 2, sharding.shard(F.col("id"), 4)).where("accepted").select("id", F.col("seq").alias("event_id"))


@query("writable_range", f"SELECT event_id, t >= {T0 + 86400 * NANOS - 600 * NANOS} AND t < {T0 + 10 * 86400 * NANOS + 3600 * NANOS} AS writable, t >= {T0 + 86400 * NANOS - 600 * NANOS} AND t <= {T0 + 10 * 86400 * NANOS + 3600 * NANOS} AS client_may_write FROM (SELECT seq AS event_id, t FROM ({SOURCES['G']}))")
def writable_range(spark: SparkSession, d: str) -> DataFrame:
    now, cutover, cutoff = F.col("arrival_nanos"), T0 + 86400 * NANOS, T0 + 10 * 86400 * NANOS
    return S.event_gauges(spark, d).select(
        F.col("seq").alias("event_id"), admission.writable(now, F.lit(cutover), F.lit(cutoff), 600 * NANOS, 3600 * NANOS).alias("writable"),
        admission.client_may_write(now, F.lit(cutover), F.lit(cutoff), 600 * NANOS, 3600 * NANOS).alias("client_may_write"))


_DAILY = windows_sql(SOURCES["C"], ("Sum",), R.policies("1d:40d"))


@query("flush_range", named_sql(f"SELECT * FROM ({rate_sql(_DAILY)}) WHERE w > {T0 + 5 * 86400 * NANOS} AND w <= {T0 + 20 * 86400 * NANOS}", R.COUNTER, ("Sum",)))
def flush_range(spark: SparkSession, d: str) -> DataFrame:
    """What is discarded before the cutover still moves the derivative's state."""
    rows = P.per_second(A.aggregate(S.event_counters(spark, d), R.COUNTER, policies=R.policies("1d:40d")))
    return rounded(A.named(rows.where(admission.flushed_locally(F.col("window_nanos"), F.lit(T0 + 5 * 86400 * NANOS), F.lit(T0 + 20 * 86400 * NANOS))), R.COUNTER))


_ENDS, _TARGET, _KEEP = (T0 + 5 * 86400 * NANOS, T0 + 15 * 86400 * NANOS), T0 + 25 * 86400 * NANOS, 4 * 86400 * NANOS


@query("flush_actions", f"""SELECT id, CAST(w AS BIGINT) AS window_nanos, CASE WHEN w > {_TARGET} THEN 'retain' WHEN w <= {_ENDS[0]} THEN 'discard' WHEN w <= {_ENDS[1]} THEN 'consume'
    WHEN w <= {_TARGET - _KEEP} THEN 'discard' ELSE 'retain' END AS action FROM ({_DAILY})""")
def flush_actions(spark: SparkSession, d: str) -> DataFrame:
    """A shard that is given up: what comes behind the cutoff is kept for four days."""
    rows = A.aggregate(S.event_counters(spark, d), R.COUNTER, policies=R.policies("1d:40d"))
    return rows.select("id", "window_nanos", admission.flush_action(F.col("window_nanos"), _TARGET, *_ENDS, _KEEP).alias("action"))


@query("entry_expiry", f"SELECT id, max(t) AS last_nanos FROM ({SOURCES['G']}) GROUP BY id HAVING {T0 + 31 * 86400 * NANOS} > max(t) + 86400 * {NS}")
def entry_expiry(spark: SparkSession, d: str) -> DataFrame:
    last = S.event_gauges(spark, d).groupBy("id").agg(F.max("arrival_nanos").alias("last_nanos"))
    return admission.expired(last, T0 + 31 * 86400 * NANOS, 86400 * NANOS)


# ---- metadata ----

def _meta(cutover: int, tombstoned: bool, *policies: tuple[int, int], pipelines: int = 1) -> str:
    each = ", ".join(f"named_struct('resolution_s', {r}L, 'retention_s', {k}L)" for r, k in policies)
    pipes = f"array(named_struct('agg_types', array('Sum'), 'policies', array({each})))" if pipelines else "cast(array() as array<struct<agg_types:array<string>,policies:array<struct<resolution_s:bigint,retention_s:bigint>>>>)"
    return f"named_struct('cutover_nanos', {cutover}L, 'tombstoned', {str(tombstoned).lower()}, 'pipelines', {pipes})"


def with_metas(spark: SparkSession, d: str, *metas: str) -> DataFrame:
    return S.event_counters(spark, d).withColumn("metas", F.expr(f"array({', '.join(metas)})"))


def by_metadata(resolved: DataFrame) -> DataFrame:
    """Samples fanned out by the metadata that they carry, each different key once."""
    keys = F.array_distinct(F.flatten(F.transform("meta.pipelines", lambda p: p["policies"])))
    return resolved.select("type", "id", "value", "ts_nanos", "arrival_nanos", "seq", F.inline(keys))


_CUT = T0 + 10 * 86400 * NANOS


def _cutover_sql(first: str, second: str) -> str:
    p1, p2 = R.policies(first), R.policies(second)
    return named_sql(windows_sql(SOURCES["C"], ("Sum",), p1, f"t < {_CUT}") + " UNION ALL " + windows_sql(SOURCES["C"], ("Sum",), p2, f"t >= {_CUT}"), R.COUNTER, ("Sum",))


@query("staged_metadata_cutover", _cutover_sql("1h:2d", "1d:40d"))
def staged_metadata_cutover(spark: SparkSession, d: str) -> DataFrame:
    metas = _meta(0, False, (3600, 172800)), _meta(_CUT, False, (86400, 3456000))
    good, _ = admission.resolve_metadata(with_metas(spark, d, *metas))
    return rounded(A.named(A.aggregate(by_metadata(good), R.COUNTER, fanned=True), R.COUNTER))


@query("tombstoned_drop", named_sql(windows_sql(SOURCES["C"], ("Sum",), R.policies("1h:2d"), f"t < {_CUT}"), R.COUNTER, ("Sum",)))
def tombstoned_drop(spark: SparkSession, d: str) -> DataFrame:
    metas = _meta(0, False, (3600, 172800)), _meta(_CUT, True, (86400, 3456000))
    good, _ = admission.resolve_metadata(with_metas(spark, d, *metas))
    return rounded(A.named(A.aggregate(by_metadata(good), R.COUNTER, fanned=True), R.COUNTER))


@query("stale_metadata", f"""WITH s AS (SELECT *, seq % 10 = 0 AS new, max(CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seen FROM ({SOURCES['C']}))
""" + named_sql(windows_sql("SELECT * FROM s", ("Sum",), R.policies("1h:2d"), "seen = 0") + " UNION ALL " + windows_sql("SELECT * FROM s", ("Sum",), R.policies("1d:40d"), "seen = 1"), R.COUNTER, ("Sum",)))
def stale_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the samples carry newer metadata; from then on the series' older ones go under it, too."""
    c = S.event_counters(spark, d).withColumn("metas", F.expr(f"array(if(seq % 10 = 0, {_meta(2, False, (86400, 3456000))}, {_meta(1, False, (3600, 172800))}))"))
    good, _ = admission.resolve_metadata(c)
    return rounded(A.named(A.aggregate(by_metadata(good), R.COUNTER, fanned=True), R.COUNTER))


@query("metadata_rejects", f"SELECT seq AS event_id, CASE WHEN seq % 3 = 0 THEN 'empty_metadatas' WHEN seq % 3 = 1 THEN 'no_applicable_metadata' ELSE 'no_pipelines' END AS reject FROM ({SOURCES['C']})")
def metadata_rejects(spark: SparkSession, d: str) -> DataFrame:
    later, empty = _meta(T0 * 2, False, (3600, 172800)), _meta(0, False, pipelines=0)
    c = S.event_counters(spark, d).withColumn("metas", F.expr(f"CASE WHEN seq % 3 = 0 THEN slice(array({later}), 1, 0) WHEN seq % 3 = 1 THEN array({later}) ELSE array({empty}) END"))
    return admission.resolve_metadata(c)[1].select(F.col("seq").alias("event_id"), "reject")


@query("duplicate_keys_once", named_sql(windows_sql(SOURCES["C"], ("Sum",), R.policies("1h:2d", "1d:40d")), R.COUNTER, ("Sum",)))
def duplicate_keys_once(spark: SparkSession, d: str) -> DataFrame:
    good, _ = admission.resolve_metadata(with_metas(spark, d, _meta(0, False, (3600, 172800), (86400, 3456000), (3600, 172800))))
    return rounded(A.named(A.aggregate(by_metadata(good), R.COUNTER, fanned=True), R.COUNTER))


# ---- aggregation driven by metadata ----

def _rolled(rows: str, types: tuple[str, ...], policy: str, cast: str = "value", rollup: str = "all") -> str:
    return windows_sql(f"SELECT '{rollup}' AS id, {cast} AS value, w, w AS t, 0 AS seq FROM ({rows}) WHERE NOT isnan(value)", types, R.policies(policy), at="w")


_HOP1 = _rolled(windows_sql(SOURCES["C"], ("Sum",), R.policies("1h:2d")), ("Sum", "Count"), "1h:2d", rollup="hop1")
_HOP2_SQL = _rolled(_HOP1, ("Max", "Count"), "1h:2d", "CAST(trunc(value) AS BIGINT)", "hop2")
_RATED_SQL = _rolled(rate_sql(f"SELECT * REPLACE (abs(value) AS value) FROM ({windows_sql(SOURCES['C'], ('Sum',), R.policies('1d:40d'))})"), ("Sum",), "1d:40d", "CAST(trunc(value) AS BIGINT)")


def _pipes(*pipelines: R.PipelineMetadata, cutover: int = 0) -> R.StagedMetadata:
    return R.StagedMetadata(cutover, False, pipelines)


def governed(samples: DataFrame, *metas: R.StagedMetadata) -> DataFrame:
    good, _ = admission.resolve_metadata(samples.withColumn("metas", G.metadata(metas)))
    return G.untimed(good)


@query("metadata_driven_types", " UNION ALL ".join([
    named_sql(windows_sql(SOURCES["G"], ("Sum", "Max"), R.policies("1d:40d"), "seq % 2 = 0"), R.GAUGE, ("Sum", "Max")),
    named_sql(windows_sql(SOURCES["G"], ("Last",), R.policies("6h:2d", "1d:40d"), "seq % 2 = 0"), R.GAUGE, ("Last",)),
    named_sql(windows_sql(SOURCES["C"], ("Count",), R.policies("1h:2d")), R.COUNTER, ("Count",)),
    named_sql(windows_sql(SOURCES["T"], ("Max", "P95"), R.policies("30d:400d")), R.TIMER, ("Max", "P95"))]))
def metadata_driven_types(spark: SparkSession, d: str) -> DataFrame:
    """Samples of all types, each with rules of its own in its rows: types and policies, some of them twice, some for half of the samples."""
    g = S.event_gauges(spark, d).where("seq % 2 = 0")
    P_ = R.PipelineMetadata
    gauges = governed(g, _pipes(P_(("Sum", "Max"), R.policies("1d:40d")), P_((), R.policies("6h:2d", "1d:40d", "6h:2d")), P_(("Sum", "Max", "Sum"), R.policies("1d:40d"))))
    counters = governed(S.event_counters(spark, d), _pipes(P_(("Count",), R.policies("1h:2d"))))
    timers = governed(S.shipping_timers(spark, d), _pipes(P_(("Max", "P95"), R.policies("30d:400d"))))
    return rounded(G.run(gauges.unionByName(counters).unionByName(timers), 0, EXACT))


@query("metadata_driven_pipelines", " UNION ALL ".join([
    named_sql(_HOP2_SQL, R.COUNTER, ("Max", "Count")), named_sql(windows_sql(SOURCES["C"], ("Sum",), R.policies("1h:2d")), R.COUNTER, ("Sum",)),
    named_sql(_RATED_SQL, R.COUNTER, ("Sum",))]))
def metadata_driven_pipelines(spark: SparkSession, d: str) -> DataFrame:
    """Three pipelines in one metadata: none, two rollups, and a derivative before a rollup."""
    P_, hour = R.PipelineMetadata, R.policies("1h:2d")
    two = (R.Rollup("hop1", ("Sum", "Count")), R.Rollup("hop2", ("Max", "Count")))
    rated = (R.Transformation("Absolute"), R.Transformation("PerSecond"), R.Rollup("all"))
    keyed = governed(S.event_counters(spark, d).withColumn("value", F.expr("try_cast(value AS bigint)") * 1.0), _pipes(P_((), hour), P_((), hour, two), P_((), R.policies("1d:40d"), rated)))
    return rounded(G.run(keyed, 2))


@query("entry_categories", " UNION ALL ".join([
    named_sql(windows_sql(f"SELECT 'same' AS id, value, t, seq FROM ({SOURCES['G']}) WHERE seq % 3 = 0", ("Sum",), R.policies("1d:40d")), R.GAUGE, ("Sum",)),
    named_sql(windows_sql(f"SELECT 'same' AS id, value, t, seq FROM ({SOURCES['G']}) WHERE seq % 3 = 1", ("Sum",), R.policies("1d:40d")), R.GAUGE, ("Sum",), bare=True),
    named_sql(windows_sql(f"SELECT 'same' AS id, value, {start_sql('t', 86400)} AS w, t, seq, 1 + seq % 2 AS hops FROM ({SOURCES['G']}) WHERE seq % 3 = 2", ("Sum",), R.policies("1d:40d"), "hops = 1", at="w"), R.GAUGE, ("Sum",)),
    named_sql(windows_sql(f"SELECT 'same' AS id, value, {start_sql('t', 86400)} AS w, t, seq, 1 + seq % 2 AS hops FROM ({SOURCES['G']}) WHERE seq % 3 = 2", ("Sum",), R.policies("1d:40d"), "hops = 2", at="w"), R.GAUGE, ("Sum",))]))
def entry_categories(spark: SparkSession, d: str) -> DataFrame:
    """One id and type as untimed, timed and forwarded samples over one or two hops: four aggregations, not one."""
    g = S.event_gauges(spark, d).withColumn("id", F.lit("same"))
    own = {"agg_types": F.array(F.lit("Sum")), "resolution_s": F.lit(86400).cast("bigint"), "retention_s": F.lit(3456000).cast("bigint")}
    plain = governed(g.where("seq % 3 = 0"), _pipes(R.PipelineMetadata(("Sum",), R.policies("1d:40d"))))
    timed = G.timed(g.where("seq % 3 = 1").withColumns(own))
    moved = G.forwarded(g.where("seq % 3 = 2").withColumns(own | {"ts_nanos": window_start(F.col("ts_nanos"), F.lit(86400)), "ops": F.array().cast(f"array<{S.OP}>"), "num_forwarded": (1 + F.col("seq") % 2).cast("int")})).drop("num_forwarded")
    return rounded(G.run(plain.unionByName(timed).unionByName(moved), 0))


@query("forwarding_latency", f"""SELECT hops AS num_forwarded, CAST(least(40, floor(greatest(0, a - w) / (2.0 * 3600 * hops * 1e9 / 40))) AS INTEGER) AS bucket, count(*) AS n FROM ({FORWARDED}) GROUP BY 1, 2""")
def forwarding_latency(spark: SparkSession, d: str) -> DataFrame:
    return G.latency(forwarded(spark, d), 3600).select("num_forwarded", "bucket", "n")


# ---- transformations and rollups ----

def _signed(spark: SparkSession, d: str) -> DataFrame:
    return S.event_gauges(spark, d).withColumn("value", F.when(F.col("seq") % 2 == 0, F.col("value")).otherwise(-F.col("value")))


SIGNED = f"SELECT id, CASE WHEN seq % 2 = 0 THEN value ELSE -value END AS value, t, seq FROM ({SOURCES['G']})"
_G1D, _C1H = windows_sql(SIGNED, ("Last",), R.policies("1d:40d")), windows_sql(SOURCES["C"], ("Sum",), R.policies("1h:2d"))
_ABS = f"SELECT * REPLACE (abs(value) AS value) FROM ({_G1D})"
ABSOLUTE, PER_SECOND = R.Transformation("Absolute"), R.Transformation("PerSecond")


@query("absolute_transform", named_sql(_ABS, R.GAUGE, ("Last",)))
def absolute_transform(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.named(P.transform(A.aggregate(_signed(spark, d), R.GAUGE, policies=R.policies("1d:40d")), (ABSOLUTE,)), R.GAUGE))


@query("per_second_rate", named_sql(rate_sql(_C1H), R.COUNTER, ("Sum",), 6))
def per_second_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.named(P.transform(A.aggregate(S.event_counters(spark, d), R.COUNTER, policies=R.policies("1h:2d")), (PER_SECOND,)), R.COUNTER), 6)


@query("absolute_then_per_second", named_sql(rate_sql(_ABS), R.GAUGE, ("Last",), 6))
def absolute_then_per_second(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.named(P.transform(A.aggregate(_signed(spark, d), R.GAUGE, policies=R.policies("1d:40d")), (ABSOLUTE, PER_SECOND)), R.GAUGE), 6)


@query("nan_keep", named_sql(rate_sql(_C1H), R.COUNTER, ("Sum",), 6, keep_nan=True))
def nan_keep(spark: SparkSession, d: str) -> DataFrame:
    rows = P.transform(A.aggregate(S.event_counters(spark, d), R.COUNTER, policies=R.policies("1h:2d"), options=KEEP_NAN), (PER_SECOND,))
    return rounded(A.named(rows, R.COUNTER, options=KEEP_NAN), 6)


@query("nan_discard", f"SELECT CASE WHEN isnan(value) THEN 'nan' ELSE 'number' END AS kind, count(*) AS n FROM ({rate_sql(_C1H)}) WHERE NOT isnan(value) GROUP BY 1")
def nan_discard(spark: SparkSession, d: str) -> DataFrame:
    rows = A.discard_nan(P.per_second(A.aggregate(S.event_counters(spark, d), R.COUNTER, policies=R.policies("1h:2d"))))
    return rows.groupBy(F.when(F.isnan("value"), "nan").otherwise("number").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_RATES = rate_sql(windows_sql(SOURCES["G"], ("Sum",), R.policies("1d:40d")))


@query("rollup_sum", named_sql(_rolled(_RATES, ("Sum",), "1d:40d"), R.GAUGE, ("Sum",)))
def rollup_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.output(S.event_gauges(spark, d), R.GAUGE, ("Sum",), R.policies("1d:40d"), (PER_SECOND, R.Rollup("all", ("Sum",)))))


@query("rollup_two_hop", named_sql(_HOP2_SQL, R.COUNTER, ("Max", "Count")))
def rollup_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Both of the first hop's types feed the second, without a label."""
    return rounded(P.output(S.event_counters(spark, d), R.COUNTER, (), R.policies("1h:2d"), (R.Rollup("hop1", ("Sum", "Count")), R.Rollup("hop2", ("Max", "Count")))))


@query("rollup_counter_truncation", named_sql(_rolled(rate_sql(windows_sql(f"SELECT id, value * 100000 AS value, t, seq FROM ({SOURCES['C']})", ("Sum",), R.policies("1d:40d"))), ("Sum",), "1d:40d", "CAST(trunc(value) AS BIGINT)"), R.COUNTER, ("Sum",)))
def rollup_counter_truncation(spark: SparkSession, d: str) -> DataFrame:
    c = S.event_counters(spark, d).withColumn("value", F.expr("try_cast(value AS bigint)") * 100000)
    return rounded(P.output(c, R.COUNTER, (), R.policies("1d:40d"), (PER_SECOND, R.Rollup("all"))))


@query("same_id_multi_type", " UNION ALL ".join(
    f"SELECT '{t}' AS type, id, CAST(w AS BIGINT) AS window_nanos, round(value, 4) AS value FROM ({windows_sql(f"SELECT 'same' AS id, {v} AS value, t, seq FROM ({SOURCES['G']}) WHERE seq % 3 = {k}", ('Sum',), R.policies('1d:40d'))})"
    for k, (t, v) in enumerate([("counter", "CAST(trunc(value) AS BIGINT)"), ("gauge", "value"), ("timer", "value")])))
def same_id_multi_type(spark: SparkSession, d: str) -> DataFrame:
    g = S.event_gauges(spark, d).withColumn("id", F.lit("same")).withColumn("type", F.element_at(F.array(*map(F.lit, (R.COUNTER, R.GAUGE, R.TIMER))), (F.col("seq") % 3 + 1).cast("int")))
    parts = [A.aggregate(g, t, ("Sum",), R.policies("1d:40d")).select("type", "id", "window_nanos", F.round("value", 4).alias("value")) for t in (R.COUNTER, R.GAUGE, R.TIMER)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- shards and sketches ----

def murmur3_sql(text: str) -> str:
    """32-bit murmur3 of an ASCII text, in DuckDB."""
    m = 2**32
    let = lambda x, v, body: f"list_transform([{x}], lambda {v}: {body})[1]"
    mul = lambda x, c: f"CAST(CAST({x} AS HUGEINT) * {c} % {m} AS BIGINT)"
    rotate = lambda x, r: let(x, f"r{r}", f"(r{r} * {2**r}) % {m} + r{r} // {2 ** (32 - r)}")
    mixed = lambda k: mul(rotate(mul(k, 0xCC9E2D51), 15), 0x1B873593)
    code = lambda i: f"CAST(coalesce(ascii(nullif(substr({text}, {i}, 1), '')), 0) AS BIGINT)"
    word = lambda j: " + ".join(f"{code(f'4 * {j} + {b + 1}')} * {256**b}" for b in range(4))
    blocks = f"list_prepend(CAST(0 AS BIGINT), list_transform(range(0, length({text}) // 4), lambda j: {mixed(word('j'))}))"
    body = f"list_reduce({blocks}, lambda h, k: ({rotate('xor(h, k)', 13)} * 5 + {0xE6546B64}) % {m})"
    with_tail = f"xor(xor({body}, {mixed(word(f'(length({text}) // 4)'))}), length({text}))"
    shifted = lambda x, r, v: let(x, v, f"xor({v}, {v} // {2**r})")
    return shifted(mul(shifted(mul(shifted(with_tail, 16, "a"), 0x85EBCA6B), 13, "b"), 0xC2B2AE35), 16, "c")


_SHARDS = f"SELECT id, CAST({murmur3_sql('id')} % {SHARDS} AS INTEGER) AS shard, CAST({murmur3_sql('name')} % {SHARDS} AS INTEGER) AS output_shard FROM (SELECT DISTINCT 'user.' || user_id AS id, 'stats.gauges.user.' || user_id AS name FROM events)"


@query("shard_route", _SHARDS)
def shard_route(spark: SparkSession, d: str) -> DataFrame:
    ids = S.event_gauges(spark, d).select("id").distinct()
    return ids.select("id", sharding.shard(F.col("id"), SHARDS).alias("shard"), sharding.aggregated_shard(F.lit("stats.gauges."), F.col("id"), F.lit(""), SHARDS).alias("output_shard"))


@query("shard_filter", f"SELECT * FROM ({_SHARDS}) WHERE shard <= 63")
def shard_filter(spark: SparkSession, d: str) -> DataFrame:
    return shard_route(spark, d).where(F.col("shard").isin(*sharding.shard_set("0..63")))


@query("tdigest_quantile")
def tdigest_quantile(spark: SparkSession, d: str) -> DataFrame:
    return tdigest.quantiles(S.shipping_timers(spark, d), ["id"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})


@query("approximate_quantile")
def approximate_quantile(spark: SparkSession, d: str) -> DataFrame:
    return A.untimed(S.shipping_timers(spark, d), R.TIMER, ("Median", "P95", "P99"), R.policies("30d:400d"))


def within_rank(found: DataFrame, values: DataFrame, keys: list[str], error: float) -> DataFrame:
    """``found`` (keys, agg_type, value) with ``within``: whether the value's rank among ``values`` (keys, v) is off by ``error`` of them at most."""
    q = F.element_at(F.create_map(*[F.lit(x) for p in R.QUANTILES.items() for x in p]), F.col("agg_type"))
    ranked = found.withColumn("q", q).join(values, keys).groupBy(*keys, "agg_type", "q").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    return ranked.select(*keys, "agg_type", ((F.col("below") <= (F.col("q") + error) * F.col("n")) & (F.col("upto") >= (F.col("q") - error) * F.col("n"))).alias("within"))


_BOUNDED = "SELECT DISTINCT id, CAST(w AS BIGINT) AS window_nanos, agg_type, true AS within FROM ({rows})"


@query("sketch_rank_error", _BOUNDED.format(rows=windows_sql(SOURCES["T"], ("Median", "P95", "P99"), R.policies("30d:400d"))))
def sketch_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Every quantile of the default sketch has the rank it should have, but for a thousandth."""
    timers, policy = S.shipping_timers(spark, d), R.policies("30d:400d")
    found = A.aggregate(timers, R.TIMER, ("Median", "P95", "P99"), policy).select("id", "window_nanos", "agg_type", "value")
    return within_rank(found, A.in_windows(A.fan_out(timers, policy)).select("id", "window_nanos", F.col("value").alias("v")), ["id", "window_nanos"], 1e-3)


@query("tdigest_rank_error", "SELECT DISTINCT 'ship.' || l_returnflag AS id, unnest(['Median', 'P95', 'P99']) AS agg_type, true AS within FROM lineitem")
def tdigest_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """The same for t-digests, within a hundredth."""
    timers = S.shipping_timers(spark, d)
    found = tdigest.quantiles(timers, ["id"], "value", {"Median": 0.5, "P95": 0.95, "P99": 0.99}).unpivot("id", ["Median", "P95", "P99"], "agg_type", "value")
    return within_rank(found, timers.select("id", F.col("value").alias("v")), ["id"], 1e-2)


@query("message_dispatch", "SELECT CASE event_id % 4 WHEN 0 THEN 'counter' WHEN 1 THEN 'timer' WHEN 2 THEN 'gauge' END AS type, CASE WHEN event_id % 4 = 3 THEN 'unknown_message_type' END AS reject, count(*) AS n FROM events GROUP BY 1, 2")
def message_dispatch(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("counter_with_metadatas", "batch_timer_with_metadatas", "gauge_with_metadatas", "something_else"))), (F.col("event_id") % 4 + 1).cast("int"))
    lines = e.select(F.to_json(F.struct(kind.alias("msg_type"), F.lit("m").alias("id"), F.col("value").alias("gauge"))).alias("value"))
    return S.decode(lines).groupBy("type", "reject").agg(F.count(F.lit(1)).alias("n"))
