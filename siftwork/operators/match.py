"""Lines joined with rules: findings of literal and regular-expression patterns, and their contextual predicates.

Three physical forms. `fused` puts every pattern into one projection as a constant, so that matching stays in the JVM with
one compiled pattern each; it suits small packs, as its cost grows with the pack. `patternindex.indexed` looks up the
patterns that a line may match at all and verifies these alone; it suits packs of any size. `arrow_matches` matches in
Python workers. All yield the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regexes
from ..functions.text import byte_column, fill, is_constant, window
from ..sources.files import is_test_file, lines_near, with_lines
from ..sources.files import lines as lines_of
from . import patternindex

MOST_FUSED = 50
KEYS = "path string, line_no int, text string, k int, start int, stop int, metavars map<string,string>"


def plan(rules: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Line patterns of `rules`, translated; those that don't compile are left out, as they can't match."""
    out = []
    for rule in rules:
        for n, p in enumerate(rule["patterns"]):
            if p[0] not in ("regex", "literal"):
                continue
            try:
                source = re.escape(p[1]) if p[0] == "literal" else p[1]
                found = regexes.translate(source)
            except (re.error, KeyError, TypeError, ValueError):
                continue
            where = p[6] or []
            out.append({
                "k": len(out), "rule": rule, "pattern_ord": n, "regex": found, "type": p[0], "where": where, "text": p[1],
                "languages": sorted({x.lower() for x in rule["languages"]}) if "*" not in rule["languages"] else [],
                # On test-like paths only patterns with a clause that doesn't exclude them run.
                "in_tests": any(not w[2] for w in where), "inside": p[7:9], "not_inside": p[9:11],
            })
    return out


def _applies(p: dict[str, Any]) -> Column:
    spoken = F.lit(True) if not p["languages"] else F.col("language").isin(*p["languages"])
    return spoken & (F.lit(True) if p["in_tests"] else ~F.col("is_test_file"))


def fused(lines: DataFrame, patterns: list[dict[str, Any]], keep: tuple[str, ...] = ()) -> DataFrame:
    """KEYS of the first match of each pattern in each line, and the line's columns `keep`."""
    if not patterns and not keep:
        return lines.sparkSession.createDataFrame([], KEYS)
    tests = []
    for p in patterns:
        java = p["regex"].java
        test = F.col("text").contains(p["text"]) if p["type"] == "literal" else F.col("text").rlike(java)
        must = regexes.literal(p["regex"].source) if p["type"] == "regex" else None
        if must:
            test = F.contains(F.lower("text"), F.lit(must)) & test
        start = F.instr("text", p["text"]) if p["type"] == "literal" else F.regexp_instr("text", F.lit(java))
        size = F.lit(len(p["text"])) if p["type"] == "literal" else F.length(F.regexp_extract("text", java, 0))
        variables = F.create_map(*[x for name, n in p["regex"].groups for x in (F.lit(name), F.regexp_extract("text", java, n))]) if p["regex"].groups else F.create_map().cast("map<string,string>")
        hit = F.struct(F.lit(p["k"]).alias("k"), (start - 1).cast("int").alias("start"), (start - 1 + size).cast("int").alias("stop"), variables.alias("metavars"))
        tests.append(F.when(_applies(p) & test, hit))
    none = F.array().cast("array<struct<k:int,start:int,stop:int,metavars:map<string,string>>>")
    hits = lines.select("path", "line_no", "text", *keep, F.explode(F.array_compact(F.array(*tests)) if tests else none).alias("m"))
    return hits.select("path", "line_no", "text", "m.k", "m.start", "m.stop", "m.metavars", *keep)


def arrow_matches(lines: DataFrame, patterns: list[dict[str, Any]]) -> DataFrame:
    """As `fused`, with patterns compiled once in each worker."""
    plain = [(p["k"], p["regex"].python, regexes.literal(p["regex"].source) if p["type"] == "regex" else p["text"].lower(), frozenset(p["languages"]), p["in_tests"], p["regex"].groups) for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(source, re.ASCII), must, spoken, tests, groups) for k, source, must, spoken, tests, groups in plain]
        by_kind: dict[tuple[str, bool], list] = {}
        for batch in batches:
            out: list[tuple] = []
            for path, language, test, nr, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "is_test_file", "line_no", "text"))):
                own = by_kind.get((language, test))
                if own is None:
                    own = by_kind[language, test] = [c for c in compiled if (not c[3] or language in c[3]) and (c[4] or not test)]
                low = text.lower()
                for k, pattern, must, _, _, groups in own:
                    if must is None or must in low:
                        m = pattern.search(text)
                        if m:
                            out.append((path, nr, text, k, m.start(), m.end(), [(name, m.group(n) or "") for name, n in groups]))
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "line_no", "text", "k", "start", "stop", "metavars"])

    return lines.select("path", "language", "is_test_file", "line_no", "text").mapInArrow(run, KEYS)


def quality_of(rule: dict[str, Any]) -> int:
    points = {"ast-query": 20, "ast": 20, "taint": 15, "regex": 5, "literal": 8}
    score = 50 + sum(points.get(p[0], 0) for p in rule["patterns"]) + {"high": 10, "medium": 5, "low": -10}.get(rule["confidence"], 0)
    return score + (10 if rule["frameworks"] else 0) + (5 if rule["languages"] and "*" not in rule["languages"] else 0)


def described(spark, patterns: list[dict[str, Any]]) -> DataFrame:
    """What findings take from their rule, by pattern: a row for each pattern of the pack."""
    from .. import schemas

    rows = [
        (p["k"], r["id"], r["name"], r["severity"], r["category"], r["cwe"], r["message"], r["fix"], r["references"], r["confidence"], quality_of(r), r["rule_ord"], p["pattern_ord"],
         [(w[0], w[1], w[2], w[3]) for w in p["where"]], p["inside"][0], p["inside"][1], p["not_inside"][0], p["not_inside"][1], p["type"])
        for p in patterns for r in [p["rule"]]
    ]
    return spark.createDataFrame(
        rows,
        "k int, rule_id string, rule_name string, severity string, category string, cwe string, template string, "
        f"fix_template {schemas.FIX}, references array<string>, confidence string, quality_score int, rule_ord int, pattern_ord int, "
        "where array<struct<not_constant:boolean,not_sanitized:array<string>,not_test_file:boolean,inside_function:string>>, "
        "inside_type string, inside_pattern string, not_inside_type string, not_inside_pattern string, pattern_type string",
    )


def findings(lines: DataFrame, rules: list[dict[str, Any]], phase: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the line patterns of `rules`, with their pattern's clauses still to be checked (see `where`), and the line's columns `keep`."""
    patterns = plan(rules)
    hits = fused(lines, patterns, keep) if keep or len(patterns) <= MOST_FUSED else patternindex.indexed(lines, patterns)
    # The pack is driver-side data: as many rows as it has patterns.
    known = F.broadcast(described(lines.sparkSession, patterns))
    out = hits.join(known, "k")
    fix = F.when(F.col("fix_template").isNotNull(), F.struct(
        F.col("fix_template.description").alias("description"), F.col("fix_template.pattern").alias("pattern"), fill(F.col("fix_template.replace"), F.col("metavars")).alias("replace")))
    return out.select(
        "rule_id", "rule_name", "severity", "category", "cwe", fill(F.col("template"), F.col("metavars")).alias("message"),
        F.col("path").alias("file"), F.col("line_no").alias("line"), byte_column(F.col("text"), F.col("start") + 1).cast("int").alias("column"),
        window(F.col("text"), F.col("start"), F.col("stop")).alias("snippet"), fix.alias("fix"), F.col("fix_template").isNotNull().alias("fix_available"),
        "references", "confidence", F.lit(0.0).alias("confidence_score"), "quality_score", "metavars", F.lit(phase).alias("phase"), "rule_ord", "pattern_ord",
        "where", "inside_type", "inside_pattern", "not_inside_type", "not_inside_pattern", "pattern_type", *keep,
    )


def findings_near(files: DataFrame, rules: list[dict[str, Any]], reach: int, mark: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Findings of `files` with `lines`, the `mark` of each line up to `reach` around, and `at`, the own line's place in them.

    A file's lines are at hand where it is taken apart, so that no array of a whole file is joined to each of its findings. Only
    files that share a path, or have none, are looked up by it as `with_lines` does; paths are counted for that first.
    """
    again = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1 OR path IS NULL").select(F.col("path").alias("_again"))
    if again.isEmpty():
        return findings(lines_near(files, reach, mark), rules, keep=("lines", "at"))
    shared = F.col("path").eqNullSafe(F.col("_again"))
    lone, few = files.join(again, shared, "left_anti"), files.join(again, shared, "left_semi")
    joined = with_lines(findings(lines_of(few), rules), few).withColumns({"lines": F.transform("lines", mark), "at": F.col("line")})
    return findings(lines_near(lone, reach, mark), rules, keep=("lines", "at")).unionByName(joined)


def span(lines: Column, first: Column, last: Column) -> Column:
    """Lines `first` to `last` (from 1, both included) of an array, as far as there are any."""
    a, b = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    return F.when(b >= a, F.slice(lines, a, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def sanitized(lines: Column, line: Column, words: Column) -> Column:
    """Whether one of `words` stands between four lines before and two after."""
    return F.exists(span(lines, line - 4, line + 2), lambda x: F.exists(words, lambda w: F.contains(x, w)))


def inside_function(lines: Column, line: Column, pattern: Column) -> Column:
    """Whether `pattern` matches one of the 19 lines before."""
    return F.exists(span(lines, line - 19, line - 1), lambda x: F.rlike(x, pattern))


def where(found: DataFrame) -> DataFrame:
    """Findings (with `lines`) that satisfy all clauses and the file-level contexts of their pattern."""

    def holds(w: Column) -> Column:
        constant = F.coalesce(w["not_constant"], F.lit(False)) & is_constant(F.col("snippet"))
        clean = w["not_sanitized"].isNotNull() & sanitized(F.col("lines"), F.col("line"), F.coalesce(w["not_sanitized"], F.array().cast("array<string>")))
        tested = F.coalesce(w["not_test_file"], F.lit(False)) & is_test_file(F.col("file"))
        outside = w["inside_function"].isNotNull() & ~inside_function(F.col("lines"), F.col("line"), F.coalesce(w["inside_function"], F.lit("")))
        return ~(constant | clean | tested | outside)

    def matches(kind: str, pattern: str) -> Column:
        whole = F.array_join("lines", "\n")
        return F.when(F.col(kind) == "literal", F.contains(whole, F.col(pattern))).otherwise(F.rlike(whole, F.concat(F.lit("(?d)"), F.col(pattern))))

    inside = F.col("inside_pattern").isNull() | matches("inside_type", "inside_pattern")
    outside = F.col("not_inside_pattern").isNull() | ~matches("not_inside_type", "not_inside_pattern")
    clauses = ["where", "inside_type", "inside_pattern", "not_inside_type", "not_inside_pattern"]
    return found.where(F.forall("where", holds) & inside & outside).drop(*clauses)


# ---- the operator language: patterns, alternatives, negations and ranges of context ----

REACH = 20


def find_pattern(lines: DataFrame, *alternatives: str) -> DataFrame:
    """path, line_no, column, text: first place of each alternative in each line."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").contains(a), F.struct(F.lit(a).alias("m"), F.instr("text", a).alias("at"))) for a in alternatives]))
    out = lines.select("path", "line_no", F.col("text").alias("line_text"), F.explode(hits).alias("h"))
    return out.select("path", "line_no", byte_column(F.col("line_text"), F.col("h.at")).cast("int").alias("column"), F.col("h.m").alias("text"), "line_text")


def find_regex(lines: DataFrame, source: str) -> DataFrame:
    """As `find_pattern`, by the first match of an expression."""
    java = regexes.translate(source).java
    at = F.regexp_instr("line_text", F.lit(java))
    out = lines.select("path", "line_no", F.col("text").alias("line_text")).where(F.col("line_text").rlike(java))
    return out.select("path", "line_no", byte_column(F.col("line_text"), at).cast("int").alias("column"), F.regexp_extract("line_text", java, 0).alias("text"), "line_text")


def find_metavariable(lines: DataFrame, source: str, name: str, second: str) -> DataFrame:
    """Matches whose group `name` is not empty and matches `second`: the group's place and value."""
    first = regexes.translate(source)
    n = dict(first.groups)[name]
    java, other = first.java, regexes.translate(second).java
    # Where a group begins: as far into the match as what precedes it reaches.
    value, whole = F.regexp_extract("line_text", java, n), F.regexp_extract("line_text", java, 0)
    at = F.regexp_instr("line_text", F.lit(java)) + F.call_function("instr", whole, value) - 1
    out = lines.select("path", "line_no", F.col("text").alias("line_text")).where(F.col("line_text").rlike(java))
    out = out.withColumns({"value": value, "at": at})
    return out.where((F.col("value") != "") & F.col("value").rlike(other)).select("path", "line_no", byte_column(F.col("line_text"), F.col("at")).cast("int").alias("column"), F.col("value").alias("text"), "line_text")


def exclude_pattern(hits: DataFrame, text: str) -> DataFrame:
    return hits.where(~F.col("line_text").contains(text))


def exclude_regex(hits: DataFrame, source: str) -> DataFrame:
    """Hits whose line doesn't match; all of them if the expression doesn't compile."""
    try:
        return hits.where(~F.col("line_text").rlike(regexes.translate(source).java))
    except (re.error, KeyError, ValueError):
        return hits


def _near(hits: DataFrame, lines: DataFrame, context: str) -> tuple[DataFrame, Column]:
    """A range join by windows of REACH lines: a context line opens its own window and the next, so equality joins them."""
    at = lines.where(F.col("text").contains(context)).select(F.col("path").alias("_path"), F.col("line_no").alias("_line"))
    slot = F.floor(F.col("_line") / (REACH + 1))
    at = at.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    near = (F.col("path") == F.col("_path")) & (F.floor(F.col("line_no") / (REACH + 1)) == F.col("_slot")) & (F.col("line_no") - F.col("_line")).between(0, REACH)
    return at, near


def require_inside(hits: DataFrame, lines: DataFrame, context: str) -> DataFrame:
    """Hits on, or up to REACH lines after, a line with `context`."""
    at, near = _near(hits, lines, context)
    return hits.join(at, near, "left_semi")


def exclude_inside(hits: DataFrame, lines: DataFrame, context: str) -> DataFrame:
    at, near = _near(hits, lines, context)
    return hits.join(at, near, "left_anti")


def operate(lines: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """One expression of the operator language: pattern, either, regex, not, not_inside, inside, not_regex, metavariable."""
    parts = []
    if spec.get("either"):
        parts.append(find_pattern(lines, *spec["either"]))
    elif spec.get("pattern"):
        parts.append(find_pattern(lines, spec["pattern"]))
    if spec.get("regex"):
        parts.append(find_regex(lines, spec["regex"]))
    if spec.get("metavariable"):
        parts.append(find_metavariable(lines, *spec["metavariable"]))
    if not parts:
        return find_pattern(lines.where("false"), "")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    if spec.get("not"):
        out = exclude_pattern(out, spec["not"])
    if spec.get("not_inside"):
        out = exclude_inside(out, lines, spec["not_inside"])
    if spec.get("inside"):
        out = require_inside(out, lines, spec["inside"])
    return exclude_regex(out, spec["not_regex"]) if spec.get("not_regex") else out

