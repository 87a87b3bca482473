import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import sharding, tdigest
from metricloom.operators import admission
from metricloom.operators import aggregate as A
from metricloom.operators import pipeline as P
from metricloom.plans import rules as R
from metricloom.sources import samples as S
from metricloom.sources import sinks

NS = 10**9
COLUMNS = "type string, id string, value double, ts_nanos bigint, arrival_nanos bigint, seq bigint"


def samples(spark, rows, metric_type="gauge"):
    """rows: (id, seconds, value)"""
    return spark.createDataFrame([(metric_type, i, None if v is None else float(v), int(t * NS), int(t * NS), n) for n, (i, t, v) in enumerate(rows)], COLUMNS)


def values(df):
    return {r.agg_type: r.value for r in df.collect()}


@pytest.mark.parametrize("kind", ["counter", "gauge", "timer"])
def test_one_to_hundred(spark, kind):
    types = ("Sum", "Count", "Mean", "Min", "Max", "SumSq", "Stdev") + {"gauge": ("Last",), "timer": ("P50", "P95", "P99"), "counter": ()}[kind]
    got = values(A.aggregate(samples(spark, [("a", 1, v) for v in range(1, 101)], kind), kind, types, R.policies("10s:2d")))
    want = {"Sum": 5050, "Count": 100, "Mean": 50.5, "Min": 1, "Max": 100, "SumSq": 338350, "Last": 100, "P50": 50, "P95": 95, "P99": 99}
    assert {k: v for k, v in got.items() if k != "Stdev"} == {k: float(v) for k, v in want.items() if k in types}
    assert got["Stdev"] == pytest.approx(29.01149, abs=1e-3)


def test_batch_timer_defaults(spark):
    batch = spark.createDataFrame([("timer", "t", None, [1.0, 3.5, 2.2, 6.5, 4.8], None, 5 * NS, 5 * NS, 0), ("timer", "t", None, [], None, 5 * NS, 5 * NS, 1)], "type string, id string, counter bigint, timer array<double>, gauge double, ts_nanos bigint, arrival_nanos bigint, seq bigint")
    out = A.untimed(S.values_of(batch), "timer", (), R.policies("10s:2d"), R.Options(exact_quantiles=True)).collect()
    got = {r.metric_id: r.value for r in out}
    assert got["stats.timers.t.sum"] == 18.0 and got["stats.timers.t.sum_sq"] == pytest.approx(83.38) and got["stats.timers.t.stdev"] == pytest.approx(2.15522620622523)
    assert got["stats.timers.t.median"] == got["stats.timers.t.p50"] == 3.5 and got["stats.timers.t.p95"] == got["stats.timers.t.p99"] == 6.5
    assert {r.ts_nanos for r in out} == {10 * NS} and len(out) == 11


def test_windows_and_names(spark):
    got = A.untimed(samples(spark, [("g", 216, 1), ("g", 217, 2), ("g", 221, 3)]), "gauge", (), R.policies("10s:2d")).orderBy("ts_nanos").collect()
    assert [(r.metric_id, r.ts_nanos // NS, r.value) for r in got] == [("stats.gauges.g", 220, 2.0), ("stats.gauges.g", 230, 3.0)]
    week = A.in_windows(A.fan_out(samples(spark, [("g", 1704412800, 1)]), R.policies("7d:40d"))).first()
    assert week.window_nanos == (1704067200 + 7 * 86400) * NS  # weeks start on Mondays


def test_nan_and_single_values(spark):
    got = values(A.aggregate(samples(spark, [("a", 1, math.nan), ("a", 1, 5)]), "gauge", ("Max", "Min", "Count", "Sum"), R.policies("10s:2d")))
    assert got["Max"] == 5 and got["Min"] == 5 and got["Count"] == 2 and math.isnan(got["Sum"])
    assert values(A.aggregate(samples(spark, [("a", 1, 5)]), "gauge", ("Stdev",), R.policies("10s:2d"))) == {"Stdev": 0.0}
    only = values(A.aggregate(samples(spark, [("a", 1, math.nan)]), "gauge", ("Max", "Min"), R.policies("10s:2d")))
    assert only["Min"] > 1e308 and only["Max"] < -1e308
    assert values(A.aggregate(samples(spark, [("a", 1, -3.7), ("a", 1, math.nan)], "counter"), "counter", (), R.policies("10s:2d"))) == {"Sum": -3.0}


def test_absolute_rate_and_rollups(spark):
    s = samples(spark, [("c", 212, -123), ("c", 221, -456), ("c", 235, -589)], "counter")
    ops = (R.Transformation("Absolute"), R.Transformation("PerSecond"), R.Rollup("foo.bar", ("Count",)), R.Rollup("foo.baz", ("Max",)))
    head = P.transform(A.aggregate(s, "counter", (), R.policies("10s:2d")), ops[:2]).orderBy("window_nanos").collect()
    assert [r.window_nanos // NS for r in head] == [220, 230, 240] and math.isnan(head[0].value)
    assert [r.value for r in head[1:]] == [pytest.approx(33.3), pytest.approx(13.3)]
    out = P.output(s, "counter", (), R.policies("10s:2d"), ops).orderBy("ts_nanos").collect()
    assert [(r.metric_id, r.ts_nanos // NS, r.value) for r in out] == [("stats.counts.foo.baz.upper", 230, 1.0), ("stats.counts.foo.baz.upper", 240, 1.0)]


def test_forwarding_pipeline_of_two_gauges(spark):
    rows = [(f"foo{i}", k, 0 if k % 2 == 0 else k + i) for i in range(2) for k in range(12)]
    s = samples(spark, [(i, t, v if t % 2 else t) for i, t, v in rows])  # last of each 2 s window: k + id
    ops = (R.Transformation("PerSecond"), R.Rollup("pipeline", ("Sum",)))
    got = P.output(s, "gauge", (), R.policies("2s:1h", "4s:24h"), ops).orderBy("resolution_s", "ts_nanos").collect()
    assert [(r.resolution_s, r.value) for r in got] == [(2, 2.0)] * 5 + [(4, 2.0)] * 2
    kept = P.output(s, "gauge", (), R.policies("2s:1h"), ops, R.Options(discard_nan=False)).orderBy("ts_nanos").collect()
    assert math.isnan(kept[0].value) and [r.value for r in kept[1:]] == [2.0] * 5


def test_timed_borders(spark):
    now = 1000
    df = spark.createDataFrame([("gauge", str(t), 1.0, int(t * NS), now * NS, i) for i, t in enumerate((now + 60, now + 60.000000001, now - 70, now - 71))], COLUMNS)
    good, bad = admission.timed(df, 10)
    assert sorted(r.seq for r in good.collect()) == [0, 2]
    assert {r.seq: r.reject for r in bad.collect()} == {3: "too_far_in_the_past"} or {r.seq: r.reject for r in bad.collect()} == {1: "too_far_in_the_future", 3: "too_far_in_the_past"}


def test_value_limit_counts_rejected(spark):
    df = samples(spark, [("a", 1.1, 1), ("a", 1.2, 1), ("a", 1.3, 1), ("a", 2.1, 1)])
    good, bad = admission.value_rate_limit(df, 3, F.when(F.col("seq") == 1, 5).otherwise(1))
    assert sorted(r.seq for r in good.collect()) == [0, 3] and sorted(r.seq for r in bad.collect()) == [1, 2]


def test_new_series_limit(spark):
    df = samples(spark, [("a", 1.1, 1), ("b", 1.2, 1), ("a", 1.3, 1), ("b", 2.1, 1), ("c", 2.2, 1)])
    got = {r.seq: r.accepted for r in admission.new_series_rate_limit(df, 1, F.lit(0)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False}
    assert all(r.accepted for r in admission.new_series_rate_limit(df, 0, F.lit(0), warm_up_until_nanos=10 * NS).collect())




def test_first_source_wins(spark):
    df = samples(spark, [("a", 1, 5), ("a", 1, 7), ("a", 1, 9)]).withColumn("source_id", F.when(F.col("seq") < 2, 1).otherwise(2))
    got = admission.first_from_each_source(df, ["type", "id", "ts_nanos", "source_id"]).collect()
    assert sorted(r.value for r in got) == [5.0, 9.0]


def test_tdigest():
    rng = np.random.default_rng(0)
    for data in (np.arange(20000.0), np.arange(20000.0)[::-1], rng.normal(size=20000)):
        whole, parts = tdigest.TDigest().add(data), tdigest.TDigest()
        for piece in np.array_split(data, 7):
            parts.merge(tdigest.TDigest().add(piece))
        for d in (whole, parts):
            assert len(d.mean) < 250 and d.min() == data.min() and d.max() == data.max()
            for q in (0.0, 0.01, 0.5, 0.95, 0.99, 1.0):
                assert abs(d.quantile(q) - np.quantile(data, q)) <= 0.01 * (data.max() - data.min())
    assert math.isnan(tdigest.TDigest().add([1.0]).quantile(-1)) and math.isnan(tdigest.TDigest().quantile(10))
    assert tdigest.TDigest().quantile(0.5) == 0.0
    assert tdigest.TDigest(precision=2).add([1.23456]).quantile(0.5) == 1.23
    with pytest.raises(ValueError):
        tdigest.TDigest(compression=5)


def test_shard_column_matches_bytes(spark):
    ids = ["", "a", "foo", "barbaz", "é" * 9, None]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", sharding.shard(F.col("id"), 1024).alias("s")).collect()
    assert {r.id: r.s for r in got} == {i: sharding.murmur3_32((i or "").encode()) % 1024 for i in ids}


def test_sinks(spark, tmp_path):
    rows = A.untimed(samples(spark, [(f"g{i}", 1, i) for i in range(20)]), "gauge", (), R.policies("10s:2d"))
    path = str(tmp_path / "out")
    sinks.broadcast(sinks.blackhole(), sinks.sharded_files(path, 4, only={0, 1}), sinks.logging_sink(1))(rows, 0)
    back = spark.read.parquet(path)
    assert {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1}
    assert back.count() == sinks.with_shard(rows, 4).where("shard < 2").count()
    sinks.controlled(lambda *_: pytest.fail("not allowed"), lambda: False)(rows, 0)
    with pytest.raises(ExceptionGroup):
        sinks.broadcast(lambda *_: 1 / 0, sinks.blackhole())(rows, 0)
    for bad in ({"type": "x"}, {"type": "forward"}, {"type": "forward", "static": {}, "dynamic": {}}, {"type": "forward", "static": {"path": "a", "shards": []}}, {"type": "forward", "static": {"total_shards": 3, "shards": [{"set": "0..1", "path": "a"}]}}):
        with pytest.raises(sinks.SinkConfigError):
            sinks.from_config(bad)


def test_logging_sink_logs_every_row(spark, tmp_path, monkeypatch, caplog):
    rows = [sinks.Row(id=i) for i in range(50)]
    with caplog.at_level("INFO"):
        sinks._log_rows(iter(rows), 3)
    assert [r.getMessage() for r in caplog.records] == [f"batch 3: {r}" for r in rows]

    out = str(tmp_path)

    def to_file(part, batch):
        import uuid

        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{batch} {r.id}\n" for r in part)

    monkeypatch.setattr(sinks, "_log_rows", to_file)
    sinks.from_config({"type": "logging"})(spark.range(50).repartition(3), 3)
    assert sorted(x for f in tmp_path.iterdir() for x in f.read_text().splitlines()) == sorted(f"3 {i}" for i in range(50))
