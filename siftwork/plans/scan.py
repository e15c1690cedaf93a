"""The scan as one lazy plan: files to lines, lines joined with rules, findings refined against comments and baselines."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, match, modules, refine, secrets, suppress, syntax, taint
from ..sources import files as source
from ..sources import rules as catalog


@dataclass(frozen=True)
class Config:
    min_severity: str = "low"
    confidence: str = "high"
    frameworks: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    comments: bool = True
    secrets: bool = False
    #: Take all files, not just those of a code scan.
    everything: bool = False
    per_file: int = refine.PER_FILE
    per_rule: int = refine.PER_RULE


@dataclass
class Result:
    """Lazy relations; nothing runs before one of them is used."""

    findings: DataFrame
    new: DataFrame | None
    known: DataFrame | None
    suppressed: DataFrame
    rules: list[dict[str, Any]] = field(default_factory=list)


def ruleset_hash(rules: list[dict[str, Any]]) -> str:
    return hashlib.sha256(json.dumps(rules, sort_keys=True, default=str).encode()).hexdigest()[:16]


def raw_findings(files: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Findings of all phases before refinement. Context is joined to findings, not findings to every line."""
    lines = source.lines(files)
    found = match.where(source.with_lines(match.findings(lines, rules), files)).drop("lines", "pattern_type")
    if any(p[0] in ("ast-query", "ast") for r in rules for p in r["patterns"]):
        found = found.unionByName(syntax.findings(files, rules), allowMissingColumns=True)
    if any(p[0] == "taint" for r in rules for p in r["patterns"]):
        imports, exports = modules.imports(lines, files), modules.exports(lines, files)
        seeds = modules.tainted_names(imports, files, modules.tainted_exports(exports, files))
        found = found.unionByName(taint.findings(files, rules, seeds), allowMissingColumns=True)
    return found


def scan(files: DataFrame, rules: list[dict[str, Any]] | None = None, config: Config = Config(), baseline: DataFrame | None = None) -> Result:
    """Scan `files` (path, content)."""
    chosen = catalog.prune(rules if rules is not None else catalog.load(), config.min_severity, config.confidence, config.frameworks)
    taken = files.select("path", "content") if config.everything else source.scannable(files.select("path", "content"), config.exclude)
    found = raw_findings(taken, chosen)
    parsed = suppress.parse(source.lines(taken))
    counts = suppress.suppressed_counts(found, parsed)
    if config.comments:
        found = suppress.unsuppressed(found, parsed)
    found = refine.breaker(refine.dedup(found), config.per_file, config.per_rule)
    new = known = None
    if baseline is not None:
        new, known = compare.new(found, baseline), compare.known(found, baseline)
    if config.secrets:
        own = secrets.detect(source.lines(files.where(secrets.takes(F.col("path")))))
        found = found.unionByName(secrets.as_findings(own), allowMissingColumns=True)
    return Result(found, new, known, counts, chosen)


def scan_text(spark: SparkSession, code: str, language: str | None = None, rules: list[dict[str, Any]] | None = None) -> DataFrame:
    """Findings of a snippet, at the lowest confidence, with the rules of its language (guessed if not given)."""
    from ..functions.text import LANGUAGES, MORE_LANGUAGES, language_of_code

    if language is None:
        language = spark.createDataFrame([(code,)], "c string").select(language_of_code(F.col("c"))).first()[0]
    endings = {v: k for k, v in reversed([*LANGUAGES.items(), *MORE_LANGUAGES.items()])}
    files = source.from_strings(spark, {f"snippet{endings.get(language, '.txt')}": code})
    every = rules if rules is not None else catalog.load()
    frameworks = tuple({f for r in every for f in r["frameworks"]})
    return scan(files, every, Config(confidence="", min_severity="", frameworks=frameworks, everything=True)).findings


def incremental(files: DataFrame, cache: DataFrame, rules: list[dict[str, Any]], config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(findings of files that the cache doesn't know, cache entries that are still good)."""
    hashed = compare.hashed(files, ruleset_hash(rules))
    return scan(compare.stale(hashed, cache), rules, config).findings, compare.fresh(hashed, cache)


def ci(files: DataFrame, rules: list[dict[str, Any]] | None = None, least: str = "low", exclude: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Findings at any confidence and without frameworks, and the exit code: 1 if any is at or above `least`."""
    found = scan(files, rules, Config(confidence="", exclude=exclude, comments=False)).findings
    return found, int(refine.failing(found, least).first()[0] > 0)
