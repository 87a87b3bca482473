"""An engine from a configuration file: ``python -m metricloom.app config.yaml`` (or .json).

Messages come from a folder (JSON, one a line), each metric type and policy is a query of its own, and
output rows go to the sink. It runs until the queries end or a signal comes, and then leaves a
checkpoint that the next run goes on from.
"""

from __future__ import annotations

import json
import signal
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregate as A
from .plans.rules import DEFAULT_POLICIES, DEFAULT_TYPES, METRIC_TYPES, NANOS, PREFIXES, JitterBucket, Options, RuleError, StoragePolicy, check_types, parse_duration
from .sources import samples as S
from .sources import sinks
from .streaming.engine import Engine, windowed


def seconds(text: str) -> float:
    return parse_duration(text) / NANOS


@dataclass(frozen=True)
class Config:
    source: str
    checkpoint: str
    sink: dict
    types: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DEFAULT_TYPES))
    policies: tuple[StoragePolicy, ...] = DEFAULT_POLICIES
    options: Options = field(default_factory=Options)
    interval: str = "1 second"
    resign_timeout_s: float = 300.0

    @classmethod
    def parse(cls, raw: dict) -> Config:
        """Checks everything that can be checked before a query starts; an unknown key is an error."""
        raw = dict(raw)
        missing = [k for k in ("source", "checkpoint", "sink") if not raw.get(k)]
        if missing:
            raise RuleError(f"missing: {', '.join(missing)}")
        kept = {k: raw.pop(k) for k in ("source", "checkpoint", "sink")}
        sinks.from_config(kept["sink"])
        given = raw.pop("types", {})
        types = DEFAULT_TYPES | {t: check_types(t, tuple(names)) for t, names in given.items()}
        if "policies" in raw:
            kept["policies"] = tuple(map(StoragePolicy.parse, raw.pop("policies")))
            if not kept["policies"]:
                raise RuleError("at least one storage policy")
        prefix, own = raw.pop("metric_prefix", ""), raw.pop("prefixes", {})
        if unknown := set(own) - set(METRIC_TYPES):
            raise RuleError(f"unknown metric types: {sorted(unknown)}")
        more = {"prefixes": {t: prefix + p for t, p in (PREFIXES | own).items()}}
        for key in ("discard_nan", "keep_resets", "exact_quantiles", "quantile_eps"):
            if key in raw:
                more[key] = raw.pop(key)
        if "buffer_future" in raw:
            more["buffer_future_s"] = seconds(raw.pop("buffer_future"))
        if "buffer_past" in raw:
            more["buffer_past_extra_s"] = seconds(raw.pop("buffer_past"))
        if "max_single_delay" in raw:
            more["max_single_delay_s"] = seconds(raw.pop("max_single_delay"))
        if "max_jitters" in raw:
            more["jitter"] = tuple(_jitter(b) for b in raw.pop("max_jitters"))
        if "interval" in raw:
            kept["interval"] = f"{int(1000 * seconds(raw.pop('interval')))} milliseconds"
        if "resign_timeout" in raw:
            kept["resign_timeout_s"] = seconds(raw.pop("resign_timeout"))
        if raw:
            raise RuleError(f"unknown keys: {sorted(raw)}")
        return cls(types=types, options=Options(**more), **kept)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return cls.parse(json.load(f))
            import yaml

            return cls.parse(yaml.safe_load(f))


def _jitter(bucket: dict) -> JitterBucket:
    if not 0 <= bucket["max_jitter_percent"] <= 1:
        raise RuleError("a jitter is between 0 and 1")
    return JitterBucket(int(seconds(bucket["flush_interval"])), bucket["max_jitter_percent"])


class App:
    def __init__(self, spark: SparkSession, config: Config):
        self.config, self.spark = config, spark
        self.engine = Engine(spark, config.checkpoint, config.options)

    def messages(self) -> DataFrame:
        return S.decode(self.spark.readStream.format("text").option("recursiveFileLookup", True).load(self.config.source))

    def start(self, available_now: bool = False) -> None:
        """A query for each metric type and policy; rows of one batch go to a folder (or topic) that all of them share."""
        c = self.config
        for t in METRIC_TYPES:
            for p in c.policies:
                name = f"{t}-{p.resolution_s}s-{p.retention_s}s"
                own = {k: v for k, v in S.MESSAGE_TYPES.items() if v == t}
                rows = windowed(S.values_of(S.branch(self.messages(), *own)), t, c.types[t], p, c.options)
                out = A.named(rows, t, c.types[t], c.options)
                self.engine.add(name, out, sinks.from_config(_under(c.sink, name)), available_now, c.interval)

    def run(self) -> None:
        """Until the queries end or SIGTERM or SIGINT comes."""
        stopped = []
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: stopped.append(True))
        self.start()
        while not stopped and self.engine.healthy() and any(q.isActive for q in self.engine.queries.values()):
            time.sleep(1)
        healthy = self.engine.healthy()
        self.close()
        if not healthy:
            raise RuntimeError("a query has failed")

    def close(self) -> None:
        self.spark.conf.set("spark.sql.streaming.stopTimeout", int(1000 * self.config.resign_timeout_s))
        self.engine.close()


def _under(sink: dict, name: str) -> dict:
    """A sink's configuration with a folder of its own for each query, as each counts its batches from 0."""
    out = dict(sink)
    if out.get("type") == "broadcast":
        return out | {"sinks": [_under(s, name) for s in out["sinks"]]}
    if static := out.get("static"):
        path = lambda p: f"{p.rstrip('/')}/query={name}"
        out["static"] = static | ({"path": path(static["path"])} if static.get("path") else {"shards": [g | {"path": path(g["path"])} for g in static["shards"]]})
    return out


def main(argv: list[str]) -> None:
    if len(argv) != 1:
        sys.exit("usage: python -m metricloom.app CONFIG")
    config = Config.load(argv[0])
    App(SparkSession.builder.appName("metricloom").getOrCreate(), config).run()


if __name__ == "__main__":
    main(sys.argv[1:])
