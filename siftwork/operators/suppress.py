"""Comments that suppress findings: parsed to relations, applied as anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

MARKER = "scan-ignore"
# How a comment starts, by language; elsewhere with two slashes.
COMMENT = {
    "go": "//", "javascript": "//", "typescript": "//", "python": "#", "java": "//", "php": "//", "ruby": "#", "csharp": "//",
    "rust": "//", "kotlin": "//", "swift": "//", "c": "//", "cpp": "//", "dart": "//", "elixir": "#", "scala": "//", "lua": "--",
    "solidity": "//", "bash": "#", "dockerfile": "#", "terraform": "#", "yaml": "#",
}


def comment_of(text: Column) -> Column:
    """What follows the first two slashes, else the first hash, else the inside of a block comment; trimmed."""
    s = F.trim(text)
    after = lambda mark: F.trim(F.substring(s, F.instr(s, mark) + len(mark), F.length(s)))
    block = s.startswith("/*") & s.endswith("*/") & (F.length(s) >= 4)
    return F.when(s.contains("//"), after("//")).when(s.contains("#"), after("#")).when(block, F.trim(F.substring(s, F.lit(3), F.length(s) - 4))).otherwise("")


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def parse(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """path, line_no, next_line, rules (lower case; none: all), effective_line of every directive in `lines`."""
    following = rf"(?i)\b{marker}-next-line(?:\s*:\s*([\w\-,\s]+))?"
    same = rf"(?i)\b{marker}\s*:\s*([\w\-,\s]+)"
    c = F.col("c")
    entry = lambda test, rules, offset: F.when(test, F.struct(F.lit(bool(offset)).alias("next_line"), rules.alias("rules"), F.lit(offset).alias("offset")))
    lower = lambda rx: F.transform(_list(F.regexp_extract(c, rx, 1)), F.lower)
    entries = F.array_compact(F.array(entry(c.rlike(following), lower(following), 1), entry(c.rlike(same), lower(same), 0)))
    marked = lines.where(F.lower("text").contains(marker.lower())).withColumn("c", comment_of(F.col("text")))
    out = marked.select("path", "line_no", F.explode(entries).alias("e"))
    return out.select("path", "line_no", "e.next_line", "e.rules", (F.col("line_no") + F.col("e.offset")).alias("effective_line"))


def _hit() -> Column:
    named = (F.size("_rules") == 0) | F.array_contains("_rules", F.lower("rule_id")) | F.array_contains("_rules", F.lit("all"))
    return (F.col("file") == F.col("_path")) & (F.col("line") == F.col("_line")) & named


def _entries(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("_path"), F.col("effective_line").alias("_line"), F.col("rules").alias("_rules"))


def unsuppressed(findings: DataFrame, parsed: DataFrame) -> DataFrame:
    return findings.join(_entries(parsed), _hit(), "left_anti")


def suppressed_counts(findings: DataFrame, parsed: DataFrame) -> DataFrame:
    return findings.join(_entries(parsed), _hit(), "left_semi").groupBy("rule_id").agg(F.count("*").alias("suppressed"))


def annotations(lines: DataFrame, marker: str = "#" + MARKER) -> DataFrame:
    """Line and block annotations: path, line_start, line_end, all_rules, rule_ids, cwes, categories, justification.

    In a block nothing but its end is read; a block without an end is dropped. Which lines are in a block follows from
    the last begin before, so a window over a file's marked lines (few) decides it.
    """
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COMMENT.items() for x in kv]), F.col("language")), F.lit("//"))
    s = F.trim("text")
    has = lambda suffix: F.contains(s, F.concat(prefix, F.lit(" " + marker + suffix)))
    marked = lines.where(has("")).select("path", "line_no", s.alias("s"), F.when(has("-end"), "end").when(has("-begin"), "begin").otherwise("line").alias("kind"))
    per_file = Window.partitionBy("path").orderBy("line_no")
    # A line is in a block after a begin without an end in between. A begin in a block opens none, so the first of a run counts.
    ends = F.sum(F.when(F.col("kind") == "end", 1).otherwise(0)).over(per_file.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("part", F.coalesce(ends, F.lit(0)))
    own = Window.partitionBy("path", "part").orderBy("line_no")
    opened = F.min(F.when(F.col("kind") == "begin", F.col("line_no"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    closed = F.max(F.when(F.col("kind") == "end", F.col("line_no"))).over(Window.partitionBy("path", "part"))
    marked = marked.withColumns({"opened": opened, "closed": closed})
    line = marked.where("kind = 'line' AND opened IS NULL").select("path", "s", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))
    block = marked.where("kind = 'begin' AND opened IS NULL AND closed IS NOT NULL").select("path", "s", F.col("line_no").alias("line_start"), F.col("closed").alias("line_end"))
    both = line.union(block)
    content = F.trim(F.substring(F.col("s"), F.instr("s", marker) + len(marker), F.length("s")))
    content = F.trim(F.regexp_replace(content, "^(-begin)?(-end)?", ""))
    parts = F.split(content, "--", 2)
    target = F.trim(parts[0])
    items = F.filter(F.split(target, r"\s+"), lambda x: x != "")
    every = (target == "") | F.exists(items, lambda x: x == "*")
    named = F.filter(items, lambda x: ~x.startswith("CWE-") & ~x.startswith("cwe-") & (x != "*"))
    return both.select(
        "path", "line_start", "line_end", every.alias("all_rules"), named.alias("rule_ids"),
        F.transform(F.filter(items, lambda x: x.startswith("CWE-") | x.startswith("cwe-")), F.upper).alias("cwes"), named.alias("categories"),
        F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("justification"),
    )


def unannotated(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings that no annotation covers: an anti-join by file and blocks of lines (see `ranges`), what is named being the residual."""
    a = notes.select(*[F.col(c).alias("_" + c) for c in notes.columns])
    named = F.array_contains("_rule_ids", F.col("rule_id")) | F.array_contains("_cwes", F.col("cwe")) | F.exists("_categories", lambda x: F.lower(x) == F.lower(F.col("category")))
    return ranges.split(findings, a, ("file", "_path"), "line", "_line_start", "_line_end", ["rule_id", "cwe", "category"], F.col("_all_rules") | named, "left_anti")
