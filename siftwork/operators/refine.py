"""Relations of findings made smaller, ranked, grouped and related."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import severity_rank

PER_FILE, PER_RULE = 30, 100


def dedup(findings: DataFrame) -> DataFrame:
    """The first finding of each file, line and rule, in the order of phases, rules, patterns and columns."""
    order = Window.partitionBy("file", "line", "rule_id").orderBy("phase", "rule_ord", "pattern_ord", "column")
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def breaker(findings: DataFrame, per_file: int = PER_FILE, per_rule: int = PER_RULE, note: str = "[noisy rule] ") -> DataFrame:
    """Drop rules with too many findings; lower those with too many in one file, in all files.

    Counts are aggregated by rule and file first and joined back by rule, so that a rule with a third of all findings is
    counted in every task and never gathered.
    """
    by_file = findings.groupBy("rule_id", "file").agg(F.count("*").alias("c"))
    noise = by_file.groupBy("rule_id").agg(F.sum("c").alias("_all"), F.max("c").alias("_most"))
    loud = F.col("_most") > per_file
    kept = findings.join(noise, "rule_id").where(F.col("_all") <= per_rule)
    return kept.withColumns({
        "confidence": F.when(loud, "low").otherwise(F.col("confidence")),
        "message": F.when(loud, F.concat(F.lit(note), "message")).otherwise(F.col("message")),
    }).drop("_all", "_most").select(*findings.columns)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: total and a count for each severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    return findings.agg(F.count("*").alias("total"), *counts)


def has_fixes(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.bool_or("fix_available"), F.lit(False)).alias("has_fixes"))


def failing(findings: DataFrame, least: str = "low") -> DataFrame:
    """Number of findings at or above a severity."""
    return findings.agg(F.count_if(severity_rank("severity") >= severity_rank(F.lit(least))).alias("failing"))


def per_document(findings: DataFrame) -> DataFrame:
    """Critical and high, medium, and other findings of each file."""
    s = F.col("severity")
    return findings.groupBy("file").agg(
        F.count_if(s.isin("critical", "high")).alias("errors"), F.count_if(s == "medium").alias("warnings"), F.count_if(~s.isin("critical", "high", "medium")).alias("others")
    )


def first_on_line(findings: DataFrame) -> DataFrame:
    """The first finding of each file and line."""
    order = Window.partitionBy("file", "line").orderBy("phase", "rule_ord", "pattern_ord", "column")
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def by_rule(findings: DataFrame) -> DataFrame:
    """Findings of each rule as a sorted list of places; a rule's list is as long as its findings, so after `breaker`."""
    return findings.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("file", "line", "column"))).alias("places"), F.count("*").alias("n"))


def taxonomy(findings: DataFrame) -> DataFrame:
    """Distinct rules with a first message, severity and CWE."""
    first = F.min(F.struct("file", "line", "column", "message", "severity", "cwe", "rule_name"))
    return findings.groupBy("rule_id").agg(first.alias("f"), F.count("*").alias("n")).select("rule_id", "f.rule_name", "f.message", "f.severity", "f.cwe", "n")


def related(findings: DataFrame) -> DataFrame:
    """Findings with the size of their group, which is a file's category."""
    return findings.withColumn("group_size", F.count("*").over(Window.partitionBy("file", "category")))


def proximity(findings: DataFrame, reach: int = 20) -> DataFrame:
    """Findings with `proximity`: other rules' findings within `reach` lines over the size of the group; 0 alone."""
    group, own = Window.partitionBy("file", "category"), Window.partitionBy("file", "category", "rule_id")
    near = lambda w: F.count("*").over(w.orderBy("line").rangeBetween(-reach, reach))
    size = F.count("*").over(group)
    return findings.withColumn("proximity", F.when(size > 1, (near(group) - near(own)) / size).otherwise(F.lit(0.0)))


def boosted(findings: DataFrame) -> DataFrame:
    """Confidence scores raised by a tenth of the proximity, 1 at most."""
    return proximity(findings).withColumn("confidence_score", F.least(F.col("confidence_score") + 0.1 * F.col("proximity"), F.lit(1.0)))


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then by place."""
    return findings.orderBy(severity_rank("severity").desc(), "file", "line", "column", "rule_id")


