"""Rules: YAML documents to a relation, validation, pruning and search."""

from __future__ import annotations

import os
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import regexes
from ..functions.text import CONFIDENCE_RANK, SEVERITY_RANK, confidence_rank, severity_rank

PACK = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rulepack")
TYPES = ("regex", "literal", "ast-query", "ast", "taint")


def _pattern(p: dict[str, Any]) -> tuple:
    inside, outside = p.get("inside") or {}, p.get("not-inside") or {}
    where = [
        (bool(w.get("not-constant")), list(w.get("not-sanitized") or []) or None, bool(w.get("not-test-file")), w.get("inside-function"))
        for w in p.get("where") or []
    ]
    return (
        p.get("type", "regex"), p.get("pattern"), p.get("query"), p.get("sources"), p.get("sinks"), p.get("sanitizers"), where,
        inside.get("type"), inside.get("pattern"), outside.get("type"), outside.get("pattern"),
    )


def parse(document: dict[str, Any], ordinal: int = 0) -> dict[str, Any] | None:
    """A rule, or None without an id; unknown keys are ignored."""
    if not isinstance(document, dict) or not document.get("id"):
        return None
    text = lambda key: str(document[key]).strip() if document.get(key) is not None else ""
    fix = document.get("fix")
    return {
        "id": text("id"), "name": text("name"), "description": text("description"), "severity": text("severity"), "category": text("category"),
        "confidence": text("confidence"), "cwe": text("cwe"), "languages": list(document.get("languages") or []),
        "frameworks": list(document.get("frameworks") or []), "patterns": [_pattern(p) for p in document.get("patterns") or [] if isinstance(p, dict)],
        "fix": (fix.get("description"), fix.get("pattern"), fix.get("replace")) if fix else None,
        "references": list(document.get("references") or []), "message": text("message"), "rule_ord": ordinal,
    }


def load(*folders: str) -> list[dict[str, Any]]:
    """Rules of all YAML files below `folders`, hidden folders left out; the first of an id wins, broken files are skipped."""
    found: dict[str, dict[str, Any]] = {}
    for folder in folders or (PACK,):
        for at, names, files in os.walk(folder):
            names[:] = sorted(n for n in names if not n.startswith("."))
            for file in sorted(files):
                if not file.endswith((".yaml", ".yml")) or file.endswith(".fixture.yaml"):
                    continue
                try:
                    with open(os.path.join(at, file), encoding="utf-8") as f:
                        documents = list(yaml.safe_load_all(f))
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                for document in documents:
                    for one in document if isinstance(document, list) else [document]:
                        rule = parse(one, len(found))
                        if rule and rule["id"] not in found:
                            found[rule["id"]] = rule
    return list(found.values())


def catalog(spark: SparkSession, rules: list[dict[str, Any]]) -> DataFrame:
    order = [c.strip().split()[0] for c in "id,name,description,severity,category,confidence,cwe,languages,frameworks,patterns,fix,references,message,rule_ord".split(",")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rules], schemas.RULES)


def first_of_id(rules: DataFrame) -> DataFrame:
    """The first rule of each id in load order."""
    order = Window.partitionBy("id").orderBy("rule_ord")
    return rules.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prune(rules: list[dict[str, Any]], min_severity: str = "low", min_confidence: str = "high", frameworks: tuple[str, ...] = (), strict: bool = True) -> list[dict[str, Any]]:
    """Rules that can fire at all. Not `strict`: a confidence of `critical` counts as high."""
    known = {f.lower() for f in frameworks}
    level = lambda c: CONFIDENCE_RANK.get("high" if c == "critical" and not strict else c, 0)
    return [
        r for r in rules
        if level(r["confidence"]) >= CONFIDENCE_RANK.get(min_confidence, 0)
        and SEVERITY_RANK.get(r["severity"], 0) >= SEVERITY_RANK.get(min_severity, 0)
        and (not r["frameworks"] or known & {f.lower() for f in r["frameworks"]})
    ]


def pruned(rules: DataFrame, min_severity: str = "low", min_confidence: str = "high", frameworks: tuple[str, ...] = ()) -> DataFrame:
    """`prune` as a filter on the relation."""
    known = F.array(*[F.lit(f.lower()) for f in frameworks]).cast("array<string>")
    return rules.where(
        (confidence_rank("confidence") >= CONFIDENCE_RANK.get(min_confidence, 0))
        & (severity_rank("severity") >= SEVERITY_RANK.get(min_severity, 0))
        & ((F.size("frameworks") == 0) | F.arrays_overlap(F.transform("frameworks", F.lower), known))
    )


def quality(rules: DataFrame) -> DataFrame:
    """Rules with quality_score: a base, points for each pattern's type, the confidence, frameworks and languages."""
    points = F.aggregate(
        F.transform("patterns", lambda p: p["type"]), F.lit(50),
        lambda total, t: total + F.when(t.isin("ast-query", "ast"), 20).when(t == "taint", 15).when(t == "regex", 5).when(t == "literal", 8).otherwise(0),
    )
    sure = F.when(F.col("confidence") == "high", 10).when(F.col("confidence") == "medium", 5).when(F.col("confidence") == "low", -10).otherwise(0)
    framed = F.when(F.size("frameworks") > 0, 10).otherwise(0)
    spoken = F.when((F.size("languages") > 0) & ~F.array_contains("languages", "*"), 5).otherwise(0)
    return rules.withColumn("quality_score", points + sure + framed + spoken)


def search(rules: DataFrame, word: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "id", "name", "category", "description", F.array_join("languages", " ")))
    return rules.where(text.contains(word.lower()))


def listed(rules: DataFrame, language: str | None = None, min_severity: str | None = None) -> DataFrame:
    out = rules
    if language:
        out = out.where(F.exists("languages", lambda x: F.lower(x) == language.lower()))
    return out.where(severity_rank("severity") >= SEVERITY_RANK.get(min_severity, 0)) if min_severity else out


def by_category(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def violations(rules: list[dict[str, Any]]) -> list[tuple[str, str]]:
    """(rule id, what is wrong with it)."""
    out = []
    for r in rules:
        for key in ("name", "severity", "category", "message"):
            if not r[key]:
                out.append((r["id"], f"{key} is missing"))
        if r["severity"] and r["severity"] not in schemas.SEVERITIES:
            out.append((r["id"], f"unknown severity {r['severity']}"))
        if r["confidence"] and r["confidence"] not in schemas.CONFIDENCES:
            out.append((r["id"], f"unknown confidence {r['confidence']}"))
        if not r["patterns"]:
            out.append((r["id"], "no patterns"))
        for p in r["patterns"]:
            if p[0] not in TYPES:
                out.append((r["id"], f"unknown pattern type {p[0]}"))
            elif p[0] == "regex":
                try:
                    compiled = regexes.translate(p[1] or "")
                    if "\\n" in compiled.source:
                        out.append((r["id"], "a newline can't match within a line"))
                except Exception as e:  # noqa: BLE001
                    out.append((r["id"], f"pattern doesn't compile: {e}"))
            elif p[0] in ("ast-query", "ast"):
                from ..operators.syntax import compile_query

                try:
                    compile_query(p[2] or p[1] or "")
                except ValueError as e:
                    out.append((r["id"], f"query doesn't compile: {e}"))
            elif p[0] == "taint" and not (p[3] and p[4]):
                out.append((r["id"], "sources and sinks are needed"))
    return out


def explain(rules: DataFrame, rule_id: str) -> DataFrame:
    """One rule as text."""
    return rules.where(F.col("id") == rule_id).select(
        "id", F.format_string("# %s\n\nSeverity: %s\nCategory: %s\nCWE: %s\n\n%s\n", "name", "severity", "category", "cwe", "description").alias("text")
    )
