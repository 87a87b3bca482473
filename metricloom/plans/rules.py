"""Storage policies, aggregation types, pipelines and metadata, with their defaults and checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

COUNTER, TIMER, GAUGE = "counter", "timer", "gauge"
METRIC_TYPES = (COUNTER, TIMER, GAUGE)

# Aggregation types, and those that stand for a quantile.
SIMPLE_TYPES = ("Last", "Min", "Max", "Mean", "Count", "Sum", "SumSq", "Stdev")
QUANTILES = {"Median": 0.5, "P10": 0.1, "P20": 0.2, "P25": 0.25, "P30": 0.3, "P40": 0.4, "P50": 0.5, "P60": 0.6, "P70": 0.7, "P75": 0.75, "P80": 0.8, "P90": 0.9, "P95": 0.95, "P99": 0.99, "P999": 0.999, "P9999": 0.9999}
DEFAULT_TYPES = {
    COUNTER: ("Sum",),
    TIMER: ("Sum", "SumSq", "Mean", "Min", "Max", "Count", "Stdev", "Median", "P50", "P95", "P99"),
    GAUGE: ("Last",),
}
SUFFIXES = {"Last": ".last", "Min": ".lower", "Max": ".upper", "Mean": ".mean", "Count": ".count", "Sum": ".sum", "SumSq": ".sum_sq", "Stdev": ".stdev", "Median": ".median"} | {p: f".{p.lower()}" for p in QUANTILES if p != "Median"}
PREFIXES = {COUNTER: "stats.counts.", TIMER: "stats.timers.", GAUGE: "stats.gauges."}

_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
NANOS = 10**9


class RuleError(ValueError):
    """A rule that no sample could be aggregated under."""


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration such as ``10s`` or ``1h30m``."""
    parts = re.findall(r"(\d+)(ns|us|ms|s|m|h|d|w)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise RuleError(f"not a duration: {text!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


@dataclass(frozen=True, order=True)
class StoragePolicy:
    resolution_s: int
    retention_s: int

    @classmethod
    def parse(cls, text: str) -> StoragePolicy:
        """``resolution:retention``, such as ``10s:2d``."""
        resolution, colon, retention = text.partition(":")
        if not colon:
            raise RuleError(f"not a storage policy: {text!r}")
        r, keep = parse_duration(resolution), parse_duration(retention)
        if r < NANOS or r % NANOS or keep % NANOS:
            raise RuleError(f"whole seconds are asked for: {text!r}")
        return cls(r // NANOS, keep // NANOS)


DEFAULT_POLICIES = (StoragePolicy.parse("10s:2d"), StoragePolicy.parse("1m:40d"))


def policies(*texts: str) -> tuple[StoragePolicy, ...]:
    return tuple(map(StoragePolicy.parse, texts))


@dataclass(frozen=True)
class Transformation:
    kind: str  # Absolute or PerSecond

    @property
    def is_binary(self) -> bool:
        return self.kind == "PerSecond"


@dataclass(frozen=True)
class Rollup:
    id: str
    agg_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class ParsedPipeline:
    """Transformations that run where the sample is, then the rollup they feed, then what travels on."""

    head: tuple[Transformation, ...] = ()
    rollup: Rollup | None = None
    remainder: tuple = ()


def parse_pipeline(ops: tuple) -> ParsedPipeline:
    for op in ops:
        if isinstance(op, Transformation):
            if op.kind not in ("Absolute", "PerSecond"):
                raise RuleError(f"unknown transformation {op.kind}")
        elif not isinstance(op, Rollup):
            raise RuleError(f"unknown pipeline operation {op!r}")
    if not ops:
        return ParsedPipeline()
    at = next((i for i, op in enumerate(ops) if isinstance(op, Rollup)), None)
    if at is None:
        raise RuleError("a pipeline needs a rollup")
    head = tuple(ops[:at])
    if sum(op.is_binary for op in head) > 1:
        raise RuleError("more than one derivative before the rollup")
    return ParsedPipeline(head, ops[at], tuple(ops[at + 1:]))


def stages(ops: tuple) -> list[ParsedPipeline]:
    """The stages of a pipeline, one for each rollup; what follows the last rollup must be nothing."""
    out = []
    while ops:
        out.append(parse_pipeline(ops))
        ops = out[-1].remainder
    return out


def check_types(metric_type: str, agg_types: tuple[str, ...]) -> tuple[str, ...]:
    """The aggregation types to compute: the metric type's defaults if none is given; each once, in order."""
    if metric_type not in METRIC_TYPES:
        raise RuleError(f"unknown metric type {metric_type!r}")
    for t in agg_types:
        if t not in SIMPLE_TYPES and t not in QUANTILES:
            raise RuleError(f"unknown aggregation type {t!r}")
        if t == "Last" and metric_type != GAUGE or t in QUANTILES and metric_type != TIMER:
            raise RuleError(f"{t} is not for a {metric_type}")
    return tuple(dict.fromkeys(agg_types)) or DEFAULT_TYPES[metric_type]


@dataclass(frozen=True)
class PipelineMetadata:
    agg_types: tuple[str, ...] = ()
    policies: tuple[StoragePolicy, ...] = ()
    ops: tuple = ()


@dataclass(frozen=True)
class StagedMetadata:
    cutover_nanos: int = 0
    tombstoned: bool = False
    pipelines: tuple[PipelineMetadata, ...] = (PipelineMetadata(),)


@dataclass(frozen=True)
class JitterBucket:
    flush_interval_s: int
    max_jitter_percent: float


def max_jitter_s(interval_s: int, buckets: list[JitterBucket]) -> float:
    """Jitter of a flush interval: that of the first bucket at least as long, else of the last."""
    if not buckets:
        return 0.0
    ordered = sorted(buckets, key=lambda b: b.flush_interval_s)
    chosen = next((b for b in ordered if interval_s <= b.flush_interval_s), ordered[-1])
    return chosen.max_jitter_percent * interval_s


@dataclass(frozen=True)
class Options:
    """Defaults that change results."""

    prefixes: dict[str, str] = field(default_factory=lambda: dict(PREFIXES))
    discard_nan: bool = True
    keep_resets: bool = False  # a derivative below 0 is NaN unless this is set
    exact_quantiles: bool = False  # exact ones hold all values of a group; the sketch has a bounded size
    quantile_eps: float = 1e-3
    buffer_future_s: int = 60
    buffer_past_extra_s: int = 60
    max_single_delay_s: float | None = None  # None: a resolution for each hop
    jitter: tuple[JitterBucket, ...] | None = None  # None: flushing may start anywhere in a resolution

    def __post_init__(self) -> None:
        if not 0 < self.quantile_eps < 0.5:
            raise RuleError("the rank error of quantiles is above 0 and below 0.5")

    def buffer_past_s(self, resolution_s: int) -> int:
        return resolution_s + self.buffer_past_extra_s

    def forwarding_delay(self, resolution_s: int) -> tuple[float, float]:
        """Seconds that forwarded samples may take: before the first hop, and for each hop."""
        if self.max_single_delay_s is None:
            return 0.0, float(resolution_s)
        first = resolution_s if self.jitter is None else max_jitter_s(resolution_s, list(self.jitter))
        return float(first), float(self.max_single_delay_s)

    def max_forwarding_delay_s(self, resolution_s: int, hops: int) -> float:
        first, each = self.forwarding_delay(resolution_s)
        return first + each * hops


def suffix(metric_type: str, agg_type: str, only_default: bool) -> str:
    """Counters and gauges under their default type have the bare name; all other values say which type they are."""
    return "" if metric_type != TIMER and only_default else SUFFIXES[agg_type]


def per_shard_limit(cluster_limit: int, shards: int, replicas: int) -> int:
    return -(-cluster_limit // (shards * replicas))


@dataclass
class RuntimeLimits:
    """Limits that may change while the engine runs: a batch is admitted under what holds when it begins."""

    values_per_second: int = 0  # 0: none
    new_series_per_second: int = 0
    warm_up_s: int = 0
    watchers: list = field(default_factory=list, repr=False)

    def update(self, **limits: int) -> None:
        for name, value in limits.items():
            if name not in ("values_per_second", "new_series_per_second", "warm_up_s") or value < 0:
                raise RuleError(f"no such limit: {name}={value}")
        for name, value in limits.items():
            setattr(self, name, value)
        for watch in self.watchers:
            watch(self)

    def watch(self, each) -> None:
        """Call ``each`` with the limits now and after every change."""
        self.watchers.append(each)
        each(self)
