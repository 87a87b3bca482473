import pytest

from metricloom.functions import sharding
from metricloom.plans import rules as R


def test_storage_policy():
    assert R.StoragePolicy.parse("10s:2d") == R.StoragePolicy(10, 172800)
    assert R.StoragePolicy.parse("1m:40d") == R.StoragePolicy(60, 3456000)
    for bad in ("10s", "x:2d", "10:2d", "5ms:1d"):
        with pytest.raises(R.RuleError):
            R.StoragePolicy.parse(bad)


def test_types_by_metric():
    assert R.check_types("timer", ()) == R.DEFAULT_TYPES["timer"]
    assert R.check_types("gauge", ("Min", "Max", "Min")) == ("Min", "Max")
    for kind, t in (("counter", "Last"), ("timer", "Last"), ("gauge", "P99"), ("counter", "Median"), ("gauge", "Nope"), ("histogram", "Sum")):
        with pytest.raises(R.RuleError):
            R.check_types(kind, (t,))


def test_pipelines():
    absolute, rate, roll = R.Transformation("Absolute"), R.Transformation("PerSecond"), R.Rollup("foo", ("Count",))
    parsed = R.parse_pipeline((absolute, rate, roll, R.Rollup("bar", ("Max",))))
    assert parsed.head == (absolute, rate) and parsed.rollup == roll and parsed.remainder == (R.Rollup("bar", ("Max",)),)
    assert R.parse_pipeline(()).rollup is None
    for bad in ((absolute,), (rate, rate, roll), (R.Transformation("Log"), roll), ("x", roll)):
        with pytest.raises(R.RuleError):
            R.parse_pipeline(bad)


def test_shards():
    assert [sharding.murmur3_32(x) % 1024 for x in (b"foo", b"bar", b"baz")] == [32, 397, 234]
    assert [sharding.murmur3_32(x) % 1024 for x in (b"bar", b"foobar", b"barbaz", b"foobarbaz")] == [397, 189, 350, 950]
    assert sharding.shard_set("0..3") == {0, 1, 2, 3} and sharding.shard_set("5") == {5} and sharding.shard_set([7, "1..2"]) == {1, 2, 7}
    for bad in ("a", "3..1", "1-2"):
        with pytest.raises(ValueError):
            sharding.shard_set(bad)


def test_config_arithmetic():
    assert R.per_shard_limit(1000, 16, 2) == 32 and R.per_shard_limit(1, 16, 2) == 1
    buckets = [R.JitterBucket(60, 1.0), R.JitterBucket(600, 0.5), R.JitterBucket(3600, 0.25)]
    assert [R.max_jitter_s(s, buckets) for s in (1, 60, 600, 3600, 7200)] == [1.0, 60.0, 300.0, 900.0, 1800.0]
    assert R.Options().max_forwarding_delay_s(10, 2) == 20
    for eps in (0, 0.5, -1):
        with pytest.raises(R.RuleError):
            R.Options(quantile_eps=eps)


@pytest.mark.parametrize("jitter, want", [(True, [6, 16, 10, 20, 155, 165]), (False, [6, 16, 15, 25, 605, 615])])
def test_forwarding_delay_is_the_first_jitter_and_each_hop(jitter, want):
    buckets = (R.JitterBucket(1, 1.0), R.JitterBucket(60, 0.5), R.JitterBucket(3600, 0.25))
    o = R.Options(max_single_delay_s=5, jitter=buckets if jitter else None)
    assert [o.max_forwarding_delay_s(r, hops) for r in (1, 10, 600) for hops in (1, 3)] == want


def test_limits_change_while_running():
    limits, seen = R.RuntimeLimits(), []
    limits.watch(lambda x: seen.append((x.values_per_second, x.new_series_per_second)))
    limits.update(values_per_second=5)
    limits.update(new_series_per_second=7, warm_up_s=1)
    assert seen == [(0, 0), (5, 0), (5, 7)]
    for bad in ({"nope": 1}, {"warm_up_s": -1}):
        with pytest.raises(R.RuleError):
            limits.update(**bad)
