import math

import pytest
from pyspark.sql import functions as F

from metricloom.functions.windows import whole
from metricloom.operators import admission
from metricloom.operators import aggregate as A
from metricloom.operators import governed as G
from metricloom.operators import pipeline as P
from metricloom.plans import rules as R
from metricloom.sources import samples as S
from metricloom.sources import sinks
from metricloom.streaming import engine as E

from .test_engine import COLUMNS, NS, samples, values


def test_nanoseconds_are_not_rounded_into_the_next_second(spark):
    last = 1704067199999999999
    df = spark.createDataFrame([("gauge", "a", 1.0, last, last, 0), ("gauge", "a", 1.0, last + 1, last + 1, 1), ("gauge", "a", 1.0, -1, -1, 2)], COLUMNS)
    got = {r.seq: (r.s, r.ts) for r in df.select("seq", whole(F.col("ts_nanos"), NS).alias("s"), whole(F.col("ts_nanos"), 1000).alias("ts")).collect()}
    assert got == {0: (1704067199, 1704067199999999), 1: (1704067200, 1704067200000000), 2: (-1, -1)}
    assert {r.seq: r.us for r in E.with_time(df).select("seq", F.unix_micros("ts").alias("us")).collect()}[0] == 1704067199999999
    good, bad = admission.value_rate_limit(df.where("seq < 2"), 1)
    assert good.count() == 2 and bad.count() == 0


def test_large_counters(spark):
    df = samples(spark, [("c", 1, 4e9), ("c", 1, 4e9)], "counter")
    assert values(A.aggregate(df, "counter", ("SumSq",), R.policies("10s:2d"))) == {"SumSq": 3.2e19}
    big = 2**53 + 1
    raw = spark.createDataFrame([("counter", "c", big, None, None, 5 * NS, 5 * NS, 0), ("counter", "c", -(2**53), None, None, 5 * NS, 5 * NS, 1)], "type string, id string, counter bigint, timer array<double>, gauge double, ts_nanos bigint, arrival_nanos bigint, seq bigint")
    assert values(A.aggregate(S.values_of(raw), "counter", ("Sum",), R.policies("10s:2d"))) == {"Sum": 1.0}
    keyed = G.untimed(S.values_of(raw).withColumn("meta", G.metadata([R.StagedMetadata()])[0]))
    assert {r.value for r in G.run(keyed, 0).collect()} == {1.0}


def test_operations_behind_the_last_rollup_are_refused(spark):
    ops = (R.Rollup("a"), R.Transformation("Absolute"))
    with pytest.raises(R.RuleError):
        P.run(samples(spark, [("g", 1, 1)]), "gauge", (), R.policies("10s:2d"), ops)
    s = samples(spark, [("g", 1, 1)])
    bad = [ops, (R.Transformation("Log"), R.Rollup("a")), (R.Transformation("PerSecond"), R.Transformation("PerSecond"), R.Rollup("a")), (R.Transformation("Absolute"),)]
    fine = [(), (R.Rollup("a"), R.Rollup("b")), (R.Transformation("PerSecond"), R.Rollup("a"), R.Transformation("PerSecond"), R.Rollup("b"))]
    for each, want in [(x, True) for x in bad] + [(x, False) for x in fine]:
        meta = G.metadata([R.StagedMetadata(pipelines=(R.PipelineMetadata(ops=each),))])
        assert s.select(G.invalid_ops(meta[0]["pipelines"][0]["ops"]).alias("x")).first().x is want


def test_a_batch_tried_twice_is_written_once(spark, tmp_path):
    rows = A.untimed(samples(spark, [(f"g{i}", 1, i) for i in range(20)]), "gauge", (), R.policies("10s:2d"))
    for sink, path in ((sinks.files(str(tmp_path / "a")), "a"), (sinks.sharded_files(str(tmp_path / "b"), 4), "b")):
        for batch in (0, 1, 1):
            sink(rows, batch)
        assert spark.read.parquet(str(tmp_path / path)).count() == 40
    groups = {"type": "forward", "static": {"total_shards": 4, "shards": [{"set": "0..1", "path": str(tmp_path / "c")}, {"set": [2, 3], "path": str(tmp_path / "d")}]}}
    sinks.from_config(groups)(rows, 0)
    assert sum(spark.read.parquet(str(tmp_path / x)).count() for x in "cd") == 20


def test_the_sketch_is_the_default_and_close(spark):
    df = samples(spark, [("t", 1, (i * 7919) % 20011) for i in range(20000)], "timer")
    exact = values(A.aggregate(df, "timer", ("Median", "P95", "P99"), R.policies("10s:2d"), R.Options(exact_quantiles=True)))
    rough = values(A.aggregate(df, "timer", ("Median", "P95", "P99"), R.policies("10s:2d")))
    order = sorted((i * 7919) % 20011 for i in range(20000))
    for t, q in (("Median", 0.5), ("P95", 0.95), ("P99", 0.99)):
        assert exact[t] == order[math.ceil(q * 20000) - 1]
        assert abs(order.index(rough[t]) - q * 20000) <= 20000 * 1e-3 + 1


def test_the_sketch_keeps_its_bound_at_every_size(spark):
    sizes = spark.createDataFrame([(f"t{n}", n) for n in [*range(990, 1030), *range(1030, 6000, 97), 60500, 70500]], "id string, n bigint")
    v = F.explode(F.expr("sequence(0L, n - 1)"))
    df = sizes.select(F.lit("timer").alias("type"), "id", v.alias("i"), "n").select("type", "id", F.expr("CAST(i * 1000003 % n AS DOUBLE)").alias("value"), *[F.lit(NS).alias(c) for c in ("ts_nanos", "arrival_nanos")], F.col("i").alias("seq"))
    for parts in (1, 3):
        for r in A.aggregate(df.repartition(parts), "timer", ("Median", "P95", "P99"), R.policies("10s:2d")).collect():
            n, q = int(r.id[1:]), {"Median": 500, "P95": 950, "P99": 990}[r.agg_type]
            assert 1000 * r.value <= (q + 1) * n and 1000 * (r.value + 1) >= (q - 1) * n, (r.id, r.agg_type, r.value)  # r.value values are below it


def test_keys_of_metadata(spark):
    """Pipelines x policies, defaults filled in, each key once; invalid types make no rows."""
    P_ = R.PipelineMetadata
    s = samples(spark, [("g", 1, 1)])
    keys = lambda *p: sorted((tuple(r.agg_types), r.resolution_s, len(r.ops)) for r in G.untimed(s.withColumn("meta", G.metadata([R.StagedMetadata(pipelines=p)])[0])).collect())
    assert keys(P_()) == [(("Last",), 10, 0), (("Last",), 60, 0)]
    assert keys(P_(), P_(policies=R.policies("1m:40d", "1h:1d"))) == [(("Last",), 10, 0), (("Last",), 60, 0), (("Last",), 3600, 0)]
    assert keys(P_(("Min", "Min"), R.policies("10s:2d")), P_(("Min",), R.policies("10s:2d"))) == [(("Min",), 10, 0)]
    assert keys(P_((), R.policies("10s:2d"), (R.Rollup("a"),)), P_((), R.policies("10s:2d"))) == [(("Last",), 10, 0), (("Last",), 10, 1)]
    bad = G.untimed(s.withColumn("meta", G.metadata([R.StagedMetadata(pipelines=(P_(("P99",)),))])[0]))
    assert G.run(bad, 0).count() == 0


def test_pipelines_deeper_than_said_are_an_error(spark):
    ops = (R.Rollup("a"), R.Rollup("b"), R.Rollup("c"))
    keyed = G.untimed(samples(spark, [("g", 1, 1)]).withColumn("meta", G.metadata([R.StagedMetadata(pipelines=(R.PipelineMetadata(("Sum",), R.policies("10s:2d"), ops),))])[0]))
    assert [r.metric_id for r in G.run(keyed, 3).collect()] == ["stats.gauges.c"]
    with pytest.raises(Exception, match="more rollups than hops"):
        G.run(keyed, 2).collect()


def test_stale_metadata_goes_under_the_newest(spark):
    metas = lambda c: G.metadata([R.StagedMetadata(cutover_nanos=c)])
    df = samples(spark, [("a", t, t) for t in range(1, 6)])
    df = df.withColumn("metas", F.when(F.col("seq") == 2, metas(2)).when(F.col("seq") == 3, metas(1)).otherwise(metas(0)))
    got = {r.seq: r.c for r in admission.resolve_metadata(df)[0].select("seq", F.col("meta.cutover_nanos").alias("c")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}
