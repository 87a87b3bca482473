import math

import pytest

from pyspark.sql import functions as F

from metricloom.functions.windows import NANOS
from metricloom.operators import admission
from metricloom.operators import aggregate as A
from metricloom.operators import governed as G
from metricloom.operators import pipeline as P
from metricloom.plans import rules as R
from metricloom.sources import sinks
from metricloom.streaming import engine as E

from .test_engine import COLUMNS, samples


def rows(df):
    return sorted((r.id, r.agg_type, r.window_nanos, r.value) for r in df.collect())


def test_stream_is_like_batch_and_rates_follow(spark, tmp_path):
    data = samples(spark, [(f"g{i % 3}", t, t * (i % 3 + 1)) for i, t in enumerate(range(0, 300, 4))])
    last = samples(spark, [("g0", 100000, 1)])
    src = str(tmp_path / "in")
    data.coalesce(1).write.parquet(src)
    last.coalesce(1).write.mode("append").parquet(src)
    policy = R.StoragePolicy.parse("10s:2d")
    batch = A.aggregate(data, "gauge", ("Sum", "Max"), (policy,))
    out, rates = [], []
    engine = E.Engine(spark, str(tmp_path / "check"))
    stream = lambda: E.windowed(spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(src), "gauge", ("Sum", "Max"), policy)
    closed = str(tmp_path / "closed")
    engine.add("windows", stream(), sinks.broadcast(sinks.files(closed), lambda df, _: out.extend(rows(df))), available_now=True)
    with pytest.raises(ValueError):
        engine.add("windows", stream(), lambda *_: None)
    assert engine.wait(60)
    windows = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 100).parquet(closed)
    engine.add("rates", E.rates(windows), lambda df, _: rates.extend(rows(df)), available_now=True)
    assert engine.wait(60)
    assert engine.healthy() and set(engine.status()) == {"windows", "rates"}
    engine.close()
    with pytest.raises(RuntimeError):
        engine.close()
    assert sorted(out) == rows(batch)
    want = rows(P.per_second(batch))
    clean = lambda x: [(a, b, c, None if math.isnan(d) else round(d, 9)) for a, b, c, d in sorted(x, key=lambda r: r[:3])]
    assert clean(rates) == clean(want)
    assert NANOS == 10**9


def streamed(spark, df, path, parts=3):
    """The rows of ``df`` as a stream of several files, in order of arrival."""
    for k in range(parts):
        df.where((F.col("seq") * parts / 1000).cast("int") == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(spark, engine, name, rows, path):
    """What a query writes, as a table."""
    engine.add(name, rows, sinks.files(path), available_now=True)
    assert engine.wait(120) and engine.healthy()
    return spark.read.parquet(path).drop("batch")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_metadata_and_limits_by_state_are_like_batch(spark, tmp_path):
    df = samples(spark, [(f"g{i % 3}", i / 7, i) for i in range(1000)])
    cutovers = F.when(F.col("seq") % 50 == 7, F.col("seq").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    df = df.withColumn("metas", F.transform(G.metadata([R.StagedMetadata()]), lambda m: m.withField("cutover_nanos", cutovers)))
    engine = E.Engine(spark, str(tmp_path / "check"))
    got = finished(spark, engine, "meta", E.by_newest_metadata(streamed(spark, df, str(tmp_path / "in"))), str(tmp_path / "meta"))
    want = admission.resolve_metadata(df)[0].select("seq", F.col("meta.cutover_nanos").alias("c"))
    same(got.select("seq", F.get_json_object("meta", "$.cutover_nanos").cast("bigint").alias("c")), want)
    limits = R.RuntimeLimits()
    limits.update(values_per_second=2)
    plain = df.drop("metas")
    got = finished(spark, engine, "limit", E.value_rate_limit(streamed(spark, plain, str(tmp_path / "in2")), limits), str(tmp_path / "limit"))
    same(got.select("seq"), admission.value_rate_limit(plain, 2)[0])
    engine.close()


def test_two_hops_in_a_stream_are_like_batch(spark, tmp_path):
    policy, end = R.StoragePolicy.parse("10s:2d"), [("x", 100_000, 1)]
    df = samples(spark, [(f"c{i % 4}", i / 3, i % 17) for i in range(999)], "counter")
    hops = (R.Rollup("hop1", ("Sum", "Count")), R.Rollup("hop2", ("Max", "Count")))
    want = P.run(df, "counter", (), (policy,), hops)
    last = samples(spark, end, "counter").withColumn("seq", F.lit(999).cast("bigint"))
    engine = E.Engine(spark, str(tmp_path / "check"))
    path = lambda n: str(tmp_path / n)
    closed = finished(spark, engine, "windows", E.windowed(streamed(spark, df.union(last), path("in"), 4), "counter", (), policy), path("w"))
    # a late window of each stage closes those before it
    after = lambda rows, k: rows.limit(1).withColumn("window_nanos", F.lit(100_000 * NANOS).cast("bigint")).withColumn("id", F.lit("x")).withColumn("batch", F.lit(900 + k))

    def stream(name, rows, k):
        after(rows, k).drop("batch").write.parquet(path(f"{name}/batch={900 + k}"))
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path(name)).drop("batch")

    one = finished(spark, engine, "hop1", E.hop(stream("w", closed, 0), hops[0], "counter", policy), path("h1"))
    two = finished(spark, engine, "hop2", E.hop(stream("h1", one, 1), hops[1], "counter", policy), path("h2"))
    same(two.select("id", "window_nanos", "agg_type", "value"), want)
    engine.close()


def test_first_of_each_source_and_admission_in_a_stream(spark, tmp_path):
    df = samples(spark, [(f"f{i % 2}", 5000 + 10 * (i // 100), i) for i in range(1000)]).withColumns({"source_id": (F.col("seq") % 7).cast("int"), "num_forwarded": F.lit(1)})
    df = df.withColumn("arrival_nanos", F.col("ts_nanos") + (F.col("seq") % 30) * NANOS)
    keys = ["type", "id", "ts_nanos", "source_id"]
    stream = E.admitted(streamed(spark, df, str(tmp_path / "in")), 10, forwarded=True)
    engine = E.Engine(spark, str(tmp_path / "check"))
    got = finished(spark, engine, "sources", E.distinct_sources(stream, keys, 1000), str(tmp_path / "out"))
    want = admission.first_from_each_source(admission.forwarded(df, 10)[0], keys)
    same(got.select(*keys), want)
    engine.close()
