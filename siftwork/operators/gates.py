"""Policies and quality gates over findings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import glob
from ..functions.text import any_of


@dataclass(frozen=True)
class Policy:
    max_findings: dict[str, int] = field(default_factory=dict)
    blocked_rules: tuple[str, ...] = ()
    fail_on_new: bool = False
    required_rules: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Gate:
    """Limits of counts; -1 is none."""

    max_critical: int = 0
    max_high: int = 5
    max_medium: int = 20
    max_low: int = 50
    max_total: int = 100
    max_secrets: int = 0
    fail_on_new_secrets: bool = True
    min_confidence: float = 0.0
    #: (path pattern, rules) that are left out; a rule is an id, a category or `*`.
    ignore: tuple[tuple[str, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class Settings:
    """What a scan is run with; files and the environment override defaults, in that order."""

    min_severity: str = "low"
    confidence: str = "high"
    format: str = "pretty"
    exclude: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    no_ignore_comments: bool = False


def _read(path: str) -> dict[str, Any]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _fill(default: Any, values: dict[str, Any]) -> Any:
    known = {k.replace("-", "_"): v for k, v in values.items()}
    out = {}
    for k, v in known.items():
        if k in default.__dataclass_fields__:
            out[k] = tuple(v) if isinstance(v, list) else v
    return replace(default, **out)


def load_policy(path: str) -> Policy | None:
    """None, and so no restriction, without a file."""
    return _fill(Policy(), _read(path)) if os.path.exists(path) else None


def load_gate(*paths: str) -> Gate:
    """Defaults, overlaid by each file in turn."""
    out = Gate()
    for path in paths:
        values = _read(path)
        ignore = tuple((x.get("path", ""), tuple(x.get("rules") or ())) for x in values.pop("ignore", None) or [])
        out = replace(_fill(out, values), **({"ignore": ignore} if ignore else {}))
    return out


def load_settings(path: str, prefix: str = "SIFTWORK_") -> Settings:
    out = _fill(Settings(), _read(path))
    env = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    parsed = {}
    for k, v in env.items():
        kind = type(getattr(out, k, None))
        parsed[k] = v.lower() in ("1", "true", "yes") if kind is bool else tuple(x.strip() for x in v.split(",")) if kind is tuple else v
    return _fill(out, parsed)


def policy_violations(findings: DataFrame, policy: Policy | None, new: DataFrame | None = None) -> DataFrame:
    """kind, subject, found, allowed: one row for each broken limit, each finding of a blocked rule, and new findings."""
    spark = findings.sparkSession
    empty = spark.createDataFrame([], "kind string, subject string, found long, allowed long")
    if policy is None:
        return empty
    for p in policy.exclude_paths:
        findings = findings.where(~F.col("file").rlike(glob(p)))
    out = empty
    if policy.max_findings:
        limits = spark.createDataFrame(list(policy.max_findings.items()), "severity string, allowed long")
        counts = findings.groupBy("severity").agg(F.count("*").alias("found"))
        over = limits.join(counts, "severity", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found > allowed")
        out = out.unionByName(over.select(F.lit("max_findings").alias("kind"), F.col("severity").alias("subject"), "found", "allowed"))
    if policy.blocked_rules:
        blocked = findings.where(F.col("rule_id").isin(*policy.blocked_rules))
        out = out.unionByName(blocked.select(F.lit("blocked_rule").alias("kind"), F.col("rule_id").alias("subject"), F.lit(1).cast("long").alias("found"), F.lit(0).cast("long").alias("allowed")))
    if policy.fail_on_new and new is not None:
        some = new.agg(F.count("*").alias("found")).where("found > 0")
        out = out.unionByName(some.select(F.lit("new_findings").alias("kind"), F.lit("baseline").alias("subject"), "found", F.lit(0).cast("long").alias("allowed")))
    return out


def exit_code(violations: DataFrame, findings: DataFrame) -> int:
    """2 with violations, 1 with findings, else 0."""
    return 2 if not violations.isEmpty() else 1 if not findings.isEmpty() else 0


def unignored(findings: DataFrame, gate: Gate) -> DataFrame:
    left_out = [
        F.col("file").rlike(glob(path)) & (F.lit("*" in rules) | F.col("rule_id").isin(*rules) | F.col("category").isin(*rules)) for path, rules in gate.ignore if rules
    ]
    return findings.where(~any_of(left_out)) if left_out else findings


def gate_counts(findings: DataFrame, gate: Gate) -> DataFrame:
    """One row of counts after what the gate leaves out."""
    kept = unignored(findings, gate)
    if gate.min_confidence > 0:
        kept = kept.where(F.col("confidence_score") >= gate.min_confidence)
    s = F.col("severity")
    return kept.agg(
        F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("critical", "high", "medium", "low")],
        F.count_if(F.col("category").isin("secrets", "hardcoded-secrets")).alias("secrets"),
    )


def gate_violations(findings: DataFrame, gate: Gate) -> DataFrame:
    """check, found, allowed of every limit that is broken."""
    limits = {"critical": gate.max_critical, "high": gate.max_high, "medium": gate.max_medium, "low": gate.max_low, "total": gate.max_total, "secrets": gate.max_secrets}
    checks = [F.when(F.lit(n >= 0) & (F.col(c) > n), F.struct(F.lit(f"max_{c}").alias("check"), F.col(c).alias("found"), F.lit(n).cast("long").alias("allowed"))) for c, n in limits.items()]
    zero = F.when(F.lit(gate.fail_on_new_secrets) & (F.col("secrets") > 0), F.struct(F.lit("no_secrets").alias("check"), F.col("secrets").alias("found"), F.lit(0).cast("long").alias("allowed")))
    return gate_counts(findings, gate).select(F.explode(F.array_compact(F.array(*checks, zero))).alias("v")).select("v.*")
