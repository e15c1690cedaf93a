"""Secrets in lines: named patterns, and quoted strings of high entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import translate
from ..functions.text import any_of, byte_column, entropy
from ..sources.files import SECRET_EXTENSIONS

# Type, name, severity, pattern.
SECRETS = (
    ("aws_key", "AWS Access Key ID", "critical", r"(?i)AKIA[0-9A-Z]{16}"),
    ("aws_secret", "AWS Secret Access Key", "critical", r"""(?i)['"\s][0-9a-zA-Z/+]{40}['"\s]"""),
    ("api_key", "Generic API Key", "high", r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*['"\s]?([a-zA-Z0-9_\-]{16,})['"\s]?"""),
    ("private_key", "Private Key", "critical", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("github_token", "GitHub Token", "critical", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("slack_token", "Slack Token", "high", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}([a-zA-Z0-9-]*)?"),
    ("jwt", "JWT Token", "high", r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*"),
    ("password", "Password in Code", "high", r"""(?i)(password|passwd|pwd)\s*[:=]\s*['"\s]?([^'"\s]{8,})['"\s]?"""),
    ("db_connection", "Database Connection String", "critical", r"(?i)(mongodb|postgres|mysql)://[^:]+:[^@]+@"),
    ("secret_key", "Generic Secret Key", "high", r"""(?i)(secret[_-]?key|secret_token|auth[_-]?secret)\s*[:=]\s*['"\s]?([a-zA-Z0-9_\-!@#$%^&*+=]{8,})['"\s]?"""),
    ("bearer_token", "Bearer Token", "critical", r"(?i)bearer\s+[a-zA-Z0-9_\-\.]{20,}"),
)
# What is known not to be a secret, whole or as a beginning or end.
DUMMIES = ("your_key_here", "my_api_key", "sample_key", "dummy_", "password123", "abc123", "changeme", "default_password", "test_key", "test_secret", "test_token")
QUOTED = r"""["']([a-zA-Z0-9!@#$%^&*+/=_\-]{16,})["']"""
LONGEST, THRESHOLD = 128, 4.2


def is_dummy(value: Column) -> Column:
    low = F.lower(value)
    return low.isin(*DUMMIES) | any_of([low.startswith(d) | low.endswith(d) for d in DUMMIES])


def named(lines: DataFrame) -> DataFrame:
    """path, line_no, column, type, name, severity, match, snippet of all matches of all patterns."""
    found = []
    for kind, name, severity, source in SECRETS:
        p = translate(source)
        groups = source.count("(") - source.count("(?") - source.count("\\(")
        whole = F.regexp_extract_all("text", F.lit(p.java), F.lit(0))
        # The value is the last group where it isn't empty.
        value = F.regexp_extract_all("text", F.lit(p.java), F.lit(groups)) if groups else whole
        each = F.transform(F.arrays_zip(whole.alias("w"), value.alias("v")), lambda x: F.struct(
            F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), x["w"].alias("whole"), F.when(x["v"] != "", x["v"]).otherwise(x["w"]).alias("match")))
        found.append(F.when(F.col("text").rlike(p.java), each))
    rows = lines.select("path", "line_no", "text", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("m"))
    at = F.call_function("instr", F.col("text"), F.col("m.whole"))
    return rows.select(
        "path", "line_no", byte_column(F.col("text"), at).cast("int").alias("column"), "m.type", "m.name", "m.severity", "m.match", F.trim("text").alias("snippet")
    ).where(~is_dummy(F.col("match")))


def quoted(lines: DataFrame) -> DataFrame:
    """path, line_no, text, match, entropy of every quoted token of 16 characters or more."""
    rows = lines.select("path", "line_no", "text", F.explode(F.regexp_extract_all("text", F.lit("(?d)" + QUOTED), F.lit(1))).alias("match"))
    return rows.withColumn("entropy", entropy("match"))


def random_looking(lines: DataFrame, threshold: float = THRESHOLD, shortest: int = 16) -> DataFrame:
    """Quoted strings of high entropy that no named pattern matches."""
    other = any_of([F.col("match").rlike(translate(s).java) for *_, s in SECRETS])
    found = quoted(lines).where(F.length("match").between(shortest, LONGEST) & (F.col("entropy") >= threshold) & ~is_dummy(F.col("match")) & ~other)
    at = F.call_function("instr", F.col("text"), F.col("match"))
    return found.select(
        "path", "line_no", byte_column(F.col("text"), at).cast("int").alias("column"), F.lit("high_entropy").alias("type"),
        F.lit("High-Entropy String (Possible Secret)").alias("name"), F.lit("medium").alias("severity"), "match", F.trim("text").alias("snippet"),
    )


def detect(lines: DataFrame) -> DataFrame:
    return named(lines).unionByName(random_looking(lines))


def takes(path: Column) -> Column:
    """Files that are searched for secrets."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SECRET_EXTENSIONS)


def as_findings(found: DataFrame) -> DataFrame:
    """In the columns of findings, as far as secrets have them."""
    kind = F.when(F.col("type") == "high_entropy", "entropy").otherwise(F.col("type"))
    return found.select(
        F.concat(F.lit("secret-"), kind).alias("rule_id"), F.col("name").alias("rule_name"), "severity", F.col("path").alias("file"), F.col("line_no").alias("line"),
        "column", "snippet", F.concat(F.lit("Possible secret: "), F.col("name")).alias("message"), F.lit("high").alias("confidence"),
    )
