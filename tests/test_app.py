import json
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from metricloom.app import App, Config
from metricloom.operators import admission
from metricloom.operators import aggregate as A
from metricloom.operators import governed as G
from metricloom.plans import rules as R
from metricloom.sources import samples as S
from metricloom.sources import sinks
from metricloom.sources.capture import Capture
from metricloom.sources.client import Client, may_write, split_batches
from metricloom.streaming import engine as E

from .test_engine import COLUMNS, NS, samples


def test_flush_actions(spark):
    at = [5, 10, 11, 20, 21, 24, 25, 30, 31]
    df = spark.createDataFrame([(x,) for x in at], "w bigint")

    def actions(target, cutover, cutoff, buffer):
        return [r.a for r in df.select("w", admission.flush_action(F.col("w"), target, cutover, cutoff, buffer).alias("a")).orderBy("w").collect()]

    d, c, k = "discard", "consume", "retain"
    assert actions(30, 0, 2**62, 5) == [c] * 8 + [k]
    assert actions(10, 10, 40, 5) == [d, d] + [k] * 7  # all that is flushed is before the cutover
    assert actions(30, 10, 40, 5) == [d, d] + [c] * 6 + [k]
    assert actions(30, 10, 20, 10) == [d, d, c, c, k, k, k, k, k]  # the buffer reaches back to the cutoff
    assert actions(30, 10, 20, 5) == [d, d, c, c, d, d, d, k, k]


def test_owned_shards(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "shard int")
    mine, others = admission.owned(df, F.col("shard"), {1, 2})
    assert [r.shard for r in mine.collect()] == [1]
    assert [(r.shard, r.reject) for r in others.orderBy("shard").collect()] == [(None, "shard_not_owned"), (0, "shard_not_owned")]


def test_encode_times(spark):
    df = spark.range(1000)
    count = lambda rate: sinks.with_encode_time(df, rate).where("encoded_nanos IS NOT NULL").count()
    assert count(0) == 0 and count(1) == 1000 and 300 < count(0.5) < 700
    with pytest.raises(sinks.SinkConfigError):
        sinks.with_encode_time(df, 1.5)


def untimed(spark, rows, column):
    made = spark.createDataFrame(rows, f"id string, {column}, ts_nanos bigint, arrival_nanos bigint, seq bigint")
    return made.withColumn("metas", G.metadata([R.StagedMetadata()]))


def test_client_writes_what_decode_reads_and_capture_keeps_it(spark, tmp_path):
    client = Client(str(tmp_path / "out"), 8, max_timer_batch=2)
    client.untimed("counter", untimed(spark, [("c", 2**60 + 1, 5, 5, 0)], "counter bigint"))
    client.untimed("timer", untimed(spark, [("t", [1.0, 2.0, 3.0], 5, 5, 1), ("empty", [], 5, 5, 2)], "timer array<double>"))
    client.untimed("gauge", untimed(spark, [("g", -0.5, 5, 5, 3)], "gauge double"))
    client.timed(spark.createDataFrame([("gauge", "x", 1.5, 7, 8, 4, 10)], COLUMNS + ", resolution_s bigint"))
    client.forwarded(spark.createDataFrame([("counter", "y", [1.0, 2.0], 7, 8, 5, 3, 1)], "type string, id string, `values` array<double>, ts_nanos bigint, arrival_nanos bigint, seq bigint, source_id int, num_forwarded int"))
    with pytest.raises(ValueError):
        client.untimed("histogram", spark.range(1))
    assert not (tmp_path / "out").exists()
    client.close()
    with pytest.raises(RuntimeError):
        client.close()
    with pytest.raises(RuntimeError):
        client.timed(spark.range(1))
    got = S.decode(spark.read.text(str(tmp_path / "out")))
    assert got.where("reject IS NOT NULL").count() == 0 and got.count() == 7
    first = {r.id: r for r in got.collect() if r.id != "t"}
    assert first["c"].counter == 2**60 + 1 and first["c"].type == "counter" and first["c"].metas[0].cutover_nanos == 0
    assert first["empty"].timer == [] and first["g"].gauge == -0.5 and first["x"].value == 1.5 and first["y"]["values"] == [1.0, 2.0] and first["y"].source_id == 3
    assert sorted(r.timer for r in got.where("id = 't'").collect()) == [[1.0, 2.0], [3.0]]

    capture = Capture(spark, str(tmp_path / "capture"))
    assert capture.num_metrics_added() == 0 and capture.snapshot() == {}
    good = got.drop("reject")
    capture.add_untimed(good.where("msg_type LIKE '%metadatas'"))
    capture.add_timed(good.where("id = 'x'"))
    capture.add_forwarded(good.where("id = 'y'"))
    with pytest.raises(Exception, match="not for this call"):
        capture.add_timed(good.where("id = 'y'"))
    assert capture.num_metrics_added() == 7
    kept = capture.snapshot()
    assert {k: v.count() for k, v in kept.items()} == {"counter_with_metadatas": 1, "batch_timer_with_metadatas": 3, "gauge_with_metadatas": 1, "timed_metric_with_metadata": 1, "forwarded_metric_with_metadata": 1}
    assert capture.num_metrics_added() == 0 and capture.snapshot() == {}
    sink = capture.sink()
    for _ in range(2):
        sink(good, 0)
    assert capture.num_metrics_added() == 7


def test_client_range_and_unsplit_batches(spark, tmp_path):
    client = Client(str(tmp_path / "out"), 1, in_range=may_write(F.col("arrival_nanos"), {0: (10, 20)}, 2, 3))
    client.untimed("gauge", untimed(spark, [(str(t), 1.0, t, t, t) for t in (7, 8, 23, 24)], "gauge double"))
    client.flush()
    assert sorted(int(r.id) for r in S.decode(spark.read.text(str(tmp_path / "out"))).collect()) == [8, 23]
    timers = spark.createDataFrame([([1.0, 2.0],)], "timer array<double>")
    assert split_batches(timers, 0) is timers


def test_config_is_checked(tmp_path):
    good = {"source": "in", "checkpoint": "c", "sink": {"type": "blackhole"}}
    plain = Config.parse(good)
    assert plain.options == R.Options() and plain.policies == R.DEFAULT_POLICIES and plain.types == R.DEFAULT_TYPES
    full = good | {"types": {"timer": ["P99", "Max"]}, "policies": ["1h:40d"], "metric_prefix": "a.", "prefixes": {"gauge": "g."}, "buffer_past": "10s", "buffer_future": "5m", "max_single_delay": "5s",
                   "max_jitters": [{"flush_interval": "10s", "max_jitter_percent": 0.5}], "discard_nan": False, "quantile_eps": 0.01, "interval": "500ms", "resign_timeout": "1m"}
    c = Config.parse(full)
    assert c.types["timer"] == ("P99", "Max") and c.types["counter"] == ("Sum",) and c.policies == R.policies("1h:40d") and c.interval == "500 milliseconds" and c.resign_timeout_s == 60
    assert c.options.prefixes == {"counter": "a.stats.counts.", "timer": "a.stats.timers.", "gauge": "a.g."} and c.options.buffer_past_s(10) == 20 and c.options.buffer_future_s == 300
    assert c.options.max_forwarding_delay_s(10, 2) == 5 + 10 and not c.options.discard_nan and c.options.quantile_eps == 0.01
    for bad in ({"sink": {"type": "?"}}, {"source": ""}, {"policies": []}, {"types": {"counter": ["P99"]}}, {"prefixes": {"x": ""}}, {"quantile_eps": 0.5}, {"unknown": 1},
                {"buffer_past": "soon"}, {"max_jitters": [{"flush_interval": "1s", "max_jitter_percent": 2}]}):
        with pytest.raises(ValueError):
            Config.parse(good | bad)
    (tmp_path / "c.json").write_text(json.dumps(full))
    assert Config.load(str(tmp_path / "c.json")) == c
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(json.dumps(full))
    assert Config.load(str(tmp_path / "c.yaml")) == c


def test_app_writes_closed_windows(spark, tmp_path):
    client = Client(str(tmp_path / "in"), 2)
    rows = [(f"c{i % 3}", i, i * NS, i * NS, i) for i in range(100)] + [("late", 1, 100_000 * NS, 100_000 * NS, 100)]
    client.untimed("counter", untimed(spark, rows, "counter bigint"))
    client.close()
    config = {"source": str(tmp_path / "in"), "checkpoint": str(tmp_path / "check"), "policies": ["10s:2d", "1m:40d"], "types": {"counter": ["Sum", "Max"]},
              "sink": {"type": "broadcast", "sinks": [{"type": "blackhole"}, {"type": "forward", "static": {"path": str(tmp_path / "out")}}]}}
    app = App(spark, Config.parse(config))
    app.start(available_now=True)
    assert app.engine.wait(180) and app.engine.healthy() and len(app.engine.status()) == 6
    got = spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("query=counter*/batch=*")])
    app.close()
    df = samples(spark, [(r[0], r[2] // NS, r[1]) for r in rows[:-1]], "counter")
    want = A.untimed(df, "counter", ("Sum", "Max"), R.policies("10s:2d", "1m:40d"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_idle_series_are_forgotten_and_limits_change(spark, tmp_path):
    src = str(tmp_path / "in")
    metas = lambda c: G.metadata([R.StagedMetadata(cutover_nanos=c)])
    one = samples(spark, [("a", 10, 1)]).withColumn("metas", metas(5 * NS))
    two = samples(spark, [("a", 11, 2)]).withColumn("metas", metas(3 * NS))
    one.write.parquet(src)
    out, used = [], []
    engine = E.Engine(spark, str(tmp_path / "check"))
    limits = R.RuntimeLimits()
    limits.update(values_per_second=1)
    read = lambda: spark.readStream.schema(one.schema).parquet(src)
    engine.add("meta", E.by_newest_metadata(read(), ttl_ms=1500), lambda df, _: out.extend((r.value, json.loads(r.meta)["cutover_nanos"]) for r in df.collect()), interval="300 milliseconds")
    engine.add("used", E.value_usage(read().drop("metas")), E.under(limits, lambda df, _: used.extend(r.value for r in df.collect())), interval="300 milliseconds")

    def until(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            time.sleep(0.2)
        return done()

    assert until(lambda: out == [(1.0, 5 * NS)] and used == [1.0])
    time.sleep(3)
    two.write.mode("append").parquet(src)
    assert until(lambda: len(out) == 2 and len(used) == 2)
    assert out[1] == (2.0, 3 * NS)  # not under the newer metadata, which went with the series
    more = samples(spark, [("a", 11, 3), ("a", 11, 4)]).withColumn("metas", metas(3 * NS))
    more.where("value = 3").write.mode("append").parquet(src)
    assert until(lambda: len(out) == 3)
    limits.update(values_per_second=9)
    more.where("value = 4").write.mode("append").parquet(src)
    assert until(lambda: used == [1.0, 2.0, 4.0])
    assert until(lambda: engine.tick()["used"]["active"] == 1)
    assert set(engine.tick()["meta"]) == {"active", "expired", "bytes"}
    engine.close()


def test_process_stops_on_a_signal(tmp_path):
    (tmp_path / "in").mkdir()
    config = {"source": str(tmp_path / "in"), "checkpoint": str(tmp_path / "check"), "policies": ["10s:2d"], "sink": {"type": "blackhole"}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    p = subprocess.Popen([sys.executable, "-m", "metricloom.app", str(tmp_path / "c.json")], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        end = time.time() + 90
        while len(list((tmp_path / "check").glob("*/metadata"))) < 3 and time.time() < end and p.poll() is None:
            time.sleep(0.5)
        time.sleep(3)
        assert p.poll() is None
        p.send_signal(signal.SIGTERM)
        assert p.wait(60) == 0
    finally:
        p.kill()
