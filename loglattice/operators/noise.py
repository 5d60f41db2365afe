"""Noise rules: named patterns that drop records, with protected levels and services."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.canonical import JAVA_FLAGS, bind, sql_literal


class NoiseConfigError(ValueError):
    """The rule configuration is incomplete or holds a bad pattern."""


@dataclass(frozen=True)
class NoiseRule:
    name: str
    pattern: str
    reason: str

    def __post_init__(self) -> None:
        try:
            re.compile(self.pattern)
        except re.error as err:
            raise NoiseConfigError(f"rule {self.name!r}: bad pattern {self.pattern!r}: {err}") from err
        if "(?P" in self.pattern:
            raise NoiseConfigError(f"rule {self.name!r}: named groups are not portable to the JVM")


@dataclass(frozen=True)
class NoiseConfig:
    enabled: bool
    always_keep_levels: frozenset[str]
    always_keep_services: frozenset[str]
    drop_patterns: tuple[NoiseRule, ...] = field(default=())

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> NoiseConfig:
        absent = {"enabled", "always_keep_levels", "always_keep_services", "drop_patterns"} - set(data)
        if absent:
            raise NoiseConfigError(f"configuration lacks {sorted(absent)}")
        rules = []
        for position, entry in enumerate(data["drop_patterns"]):
            lacking = {"name", "pattern", "reason"} - set(entry)
            if lacking:
                raise NoiseConfigError(f"drop pattern {position} lacks {sorted(lacking)}")
            rules.append(NoiseRule(entry["name"], entry["pattern"], entry["reason"]))
        return cls(
            bool(data["enabled"]),
            frozenset(data["always_keep_levels"]),
            frozenset(data["always_keep_services"]),
            tuple(rules),
        )

    @classmethod
    def from_yaml(cls, path: str) -> NoiseConfig:
        try:
            import yaml
        except ImportError as err:  # optional dependency
            raise NoiseConfigError("PyYAML is needed to read a YAML configuration") from err
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle))

    @classmethod
    def default(cls) -> NoiseConfig:
        return cls.from_dict(DEFAULT_CONFIG)


# The default protected sets and the housekeeping messages that are dropped.
DEFAULT_CONFIG: dict[str, Any] = {
    "enabled": True,
    "always_keep_levels": ["FATAL", "CRITICAL", "ERROR", "WARN", "WARNING"],
    "always_keep_services": [
        "ssh.service", "sshd", "systemd-logind.service", "docker.service", "containerd.service",
        "kubelet.service", "nginx.service", "postgresql.service", "mariadb.service",
        "mysql.service", "redis.service",
    ],
    "drop_patterns": [
        {"name": name, "pattern": pattern, "reason": reason}
        for name, pattern, reason in (
            ("loki_table_manager_upload", r'caller=table_manager\.go.*msg="uploading tables"', "index upload"),
            ("loki_table_manager_sync", r'caller=table_manager\.go.*msg="syncing tables"', "table sync"),
            ("loki_table_manager_clean", r'caller=table_manager\.go.*msg="cleaning tables cache"', "cache cleanup"),
            ("loki_table_manager_handover", r'caller=table_manager\.go.*msg="handing over indexes"', "index handover"),
            ("loki_table_manager_readiness", r'caller=table_manager\.go.*msg="query readiness"', "readiness check"),
            ("loki_compactor_start", r'caller=compactor\.go.*msg="compacting table"', "compaction start"),
            ("loki_compactor_finish", r'caller=compactor\.go.*msg="finished compacting"', "compaction end"),
            ("loki_checkpoint", r"caller=checkpoint\.go", "WAL checkpoint"),
            ("loki_table_list", r'caller=table\.go.*msg="listed files"', "file listing"),
            ("loki_spanlogger_cache_built", r'caller=spanlogger\.go.*msg="table cache built"', "cache built"),
            ("loki_spanlogger_building", r'caller=spanlogger\.go.*msg="building table', "cache building"),
            ("loki_spanlogger_names", r'caller=spanlogger\.go.*msg="table names cache', "names cache"),
        )
    ],
}


def first_match(text: Column, named_patterns: Iterable[tuple[str, str]]) -> Column:
    """Name of the first pattern found in the text, else null.

    The text is bound once, so a computed message is not evaluated again for every pattern.
    """
    arms = " ".join(
        f"WHEN m RLIKE {sql_literal(JAVA_FLAGS + pattern)} THEN {sql_literal(name)}" for name, pattern in named_patterns
    )
    return bind(text, f"m -> CASE {arms} END") if arms else F.lit(None).cast("string")


def drop_reason(
    config: NoiseConfig, level: Column | None = None, service: Column | None = None, message: Column | None = None
) -> Column:
    """Name of the first matching rule; null for a kept record, whose protected ones see no pattern at all."""
    if not config.enabled or not config.drop_patterns:
        return F.lit(None).cast("string")
    level = F.coalesce(F.col("level") if level is None else level, F.lit("INFO"))
    service = F.coalesce(F.col("service") if service is None else service, F.lit(""))
    message = F.coalesce(F.col("message") if message is None else message, F.lit(""))
    protected = level.isin(*sorted(config.always_keep_levels)) | service.isin(*sorted(config.always_keep_services))
    return F.when(~protected, first_match(message, [(r.name, r.pattern) for r in config.drop_patterns]))


def classify(events: DataFrame, config: NoiseConfig) -> DataFrame:
    return events.withColumn("drop_reason", drop_reason(config))


def keep(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def stats_by_rule(classified: DataFrame) -> DataFrame:
    """Dropped records per rule."""
    return (
        classified.filter(F.col("drop_reason").isNotNull())
        .groupBy("drop_reason")
        .agg(F.count(F.lit(1)).alias("dropped"))
    )


def batch_stats(classified: DataFrame) -> DataFrame:
    """(drop_reason, n) of a batch, null for what is kept: a row for each rule that matched."""
    return classified.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def _counters() -> Iterable[Column]:
    return (
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"),
    )


def summary(classified: DataFrame) -> DataFrame:
    """One row: seen, dropped, kept and the drop rate in percent."""
    return classified.agg(*_counters()).select(
        "seen",
        "dropped",
        (F.col("seen") - F.col("dropped")).alias("kept"),
        F.round(F.try_divide(F.col("dropped") * 100.0, F.col("seen")), 1).alias("drop_rate_pct"),
    )


def observed(classified: DataFrame, name: str = "noise") -> tuple[DataFrame, Observation]:
    """Running statistics gathered as the records pass, without a second read."""
    observation = Observation(name)
    return classified.observe(observation, *_counters()), observation
