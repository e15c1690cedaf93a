"""The engine's operators as named queries over the driver's tables, each with the same in DuckDB SQL where SQL can say it.

Documents stand for files: their paths, with endings and folders that make every predicate go both ways, are one SQL
expression that both sides use, and so are a few rules that fire on the corpus.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.regexes import glob
from ..operators import blocks, compare, cubes, dependencies, fixes, frameworks, gates, match, modules, patternindex, ranges, refine, reports, scores, secrets, store, suppress, syntax, taint
from ..sources import files as source
from ..sources import rules as catalog
from ..sources import walk
from ..streaming import replay, state, watch
from . import scan as scanning

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PATH = (
    "source || '/' || CASE doc_id % 8 WHEN 0 THEN 'tests/' WHEN 1 THEN 'lib/' ELSE '' END || 'doc' || cast(doc_id AS string)"
    " || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '_test.go' WHEN 3 THEN '.md' ELSE '.java' END"
)
#: id, name, severity, category, pattern.
RULES = (
    ("email", "E-mail address", "medium", "secrets", r"[a-zA-Z0-9._]+@[a-zA-Z0-9.]+\.com"),
    ("card", "Card number", "high", "secrets", r"[0-9]{16}"),
    ("license", "License line", "info", "crypto", r"(?i)license"),
    ("common", "Common word", "critical", "sqli", r"(the|les|der|los) [a-z]+"),
    ("shout", "Noise", "low", "xss", r"(!!|###|%%%)"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.lines(files(spark, sf_dir))


def rules(names: tuple[str, ...] = ()) -> list[dict]:
    return [
        catalog.parse({"id": i, "name": n, "severity": s, "category": c, "confidence": "high", "cwe": "CWE-200", "message": "found " + i, "patterns": [{"type": "regex", "pattern": p, "where": [{"not-test-file": False}]}]}, k)
        for k, (i, n, s, c, p) in enumerate(RULES) if not names or i in names
    ]


def findings(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return match.findings(lines(spark, sf_dir), rules(names)).drop("where", "inside_type", "inside_pattern", "not_inside_type", "not_inside_pattern")


def with_context(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return source.with_lines(findings(spark, sf_dir, *names), files(spark, sf_dir))


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


FILES = f"files AS (SELECT {PATH} AS path, text AS content FROM documents WHERE text IS NOT NULL)"
LINES = (
    FILES + ", arrays AS (SELECT path, content, string_split(content, chr(10)) AS ls FROM files),"
    " lines AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM arrays)"
)


def found(*names: str) -> str:
    """CTE of the findings of RULES (all, or by name): as many columns as the comparison needs."""
    parts = [
        f"SELECT {lit(i)} AS rule_id, {lit(n)} AS rule_name, {lit(s)} AS severity, {lit(c)} AS category, 'found {i}' AS message, path AS file, line_no AS line, text, regexp_extract(text, {lit(p)}, 0) AS hit, {k} AS rule_ord FROM lines WHERE regexp_matches(text, {lit(p)})"
        for k, (i, n, s, c, p) in enumerate(RULES) if not names or i in names
    ]
    return (
        f"raw AS ({' UNION ALL '.join(parts)}), placed AS (SELECT *, instr(text, hit) AS pos FROM raw),"
        " findings AS (SELECT *, strlen(substring(text, 1, pos - 1)) + 1 AS col, CASE WHEN strlen(text) > 120 THEN"
        " (CASE WHEN pos - 1 - 40 > 0 THEN '...' ELSE '' END) || substring(text, greatest(pos - 1 - 40, 0) + 1, least(pos - 1 + length(hit) + 40, length(text)) - greatest(pos - 1 - 40, 0))"
        " || (CASE WHEN pos - 1 + length(hit) + 40 < length(text) THEN '...' ELSE '' END) ELSE text END AS snippet FROM placed)"
    )


FOUND = LINES + ", " + found()
SLICE = "list_slice(ls, greatest({a}, 1)::BIGINT, least({b}, len(ls))::BIGINT)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def context_sql(*names: str) -> str:
    return LINES + ", " + found(*names) + ", near AS (SELECT f.*, a.ls FROM findings f JOIN arrays a ON a.path = f.file)"


# ---- sources and selection ----


def _like(words, column="lower(path)") -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


@query(
    "source_file_selection",
    f"WITH {FILES}, b AS (SELECT path, regexp_extract(path, '[^/]*$', 0) AS base, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM files)"
    f" SELECT path, ext, ({' OR '.join('regexp_matches(base, ' + lit(glob(p)) + ')' for p in source.EXCLUDED_NAMES)}"
    f" OR len(list_intersect(string_split(lower(path), '/'), [{', '.join(map(lit, source.EXCLUDED_SEGMENTS))}])) > 0) AS excluded,"
    f" (ext IN ({', '.join(map(lit, source.EXTENSIONS))}) OR lower(base) IN ({', '.join(map(lit, source.BARE_NAMES))})) AS supported FROM b",
)
def source_file_selection(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", fn.extension(p).alias("ext"), source.is_excluded(p).alias("excluded"), source.is_supported(p).alias("supported"))


_LANG = "CASE regexp_extract(path, '(\\.[^./]*)$', 1) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fn.LANGUAGES.items()) + " ELSE '' END"


@query(
    "source_language_and_tests",
    f"WITH {FILES} SELECT path, {_LANG} AS language, {_like(source.TEST_LIKE)} AS is_test_like, {_like(source.TEST_FILE, 'path')} AS is_test_file, sha256(content) AS sha FROM files",
)
def source_language_and_tests(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select(
        "path", fn.language_of(p, full=False).alias("language"), source.is_test_like(p).alias("is_test_like"), source.is_test_file(p).alias("is_test_file"), F.sha2("content", 256).alias("sha")
    )


@query("source_lines", f"WITH {LINES} SELECT path, max(line_no)::BIGINT AS n_lines, sum(length(text))::BIGINT AS n_chars, max(strlen(text))::BIGINT AS longest FROM lines GROUP BY path")
def source_lines(spark, sf_dir):
    out = lines(spark, sf_dir).groupBy("path")
    return out.agg(F.max("line_no").cast("long").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.max(F.octet_length("text")).cast("long").alias("longest"))


@query(
    "language_of_code",
    "WITH c AS (SELECT page_id AS id, html || CASE page_id % 11 WHEN 0 THEN 'package a func main' WHEN 1 THEN 'def f(): pass' WHEN 2 THEN 'let x = 1' WHEN 3 THEN 'public class A' WHEN 4 THEN '<?php'"
    " WHEN 5 THEN 'fn f() -> i32' WHEN 6 THEN 'class A end' WHEN 7 THEN 'class A { public ' WHEN 8 THEN 'func f() -> Int' WHEN 9 THEN 'fun f' ELSE '' END AS code FROM pages)"
    " SELECT id, CASE WHEN contains(code, 'func ') AND contains(code, 'package ') THEN 'go' WHEN contains(code, 'def ') AND (contains(code, ':') OR contains(code, 'import ')) THEN 'python'"
    " WHEN contains(code, 'function ') OR contains(code, 'const ') OR contains(code, 'let ') THEN 'javascript' WHEN contains(code, 'public class ') OR contains(code, 'import java.') THEN 'java'"
    " WHEN contains(code, '<?php') THEN 'php' WHEN contains(code, 'fn ') AND contains(code, '->') THEN 'rust' WHEN contains(code, 'class ') AND contains(code, 'end') THEN 'ruby'"
    " WHEN contains(code, 'class ') AND contains(code, '{') AND contains(code, 'public ') THEN 'csharp' WHEN contains(code, 'func ') AND contains(code, '->') AND NOT contains(code, 'package ') THEN 'swift'"
    " WHEN contains(code, 'fun ') OR contains(code, 'val ') OR contains(code, 'var ') THEN 'kotlin' ELSE '' END AS language FROM c",
)
def language_of_code(spark, sf_dir):
    tail = (
        "html || CASE page_id % 11 WHEN 0 THEN 'package a func main' WHEN 1 THEN 'def f(): pass' WHEN 2 THEN 'let x = 1' WHEN 3 THEN 'public class A' WHEN 4 THEN '<?php'"
        " WHEN 5 THEN 'fn f() -> i32' WHEN 6 THEN 'class A end' WHEN 7 THEN 'class A { public ' WHEN 8 THEN 'func f() -> Int' WHEN 9 THEN 'fun f' ELSE '' END"
    )
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), fn.language_of_code(F.expr(tail)).alias("language"))


# ---- matching ----


@query("match_regex", f"WITH {FOUND} SELECT rule_id, severity, category, message, file, line::BIGINT AS line, col::BIGINT AS col, snippet FROM findings")
def match_regex(spark, sf_dir):
    return findings(spark, sf_dir).select("rule_id", "severity", "category", "message", "file", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "snippet")


@query("match_regex_arrow", f"WITH {FOUND} SELECT rule_id, file, line::BIGINT AS line, (pos - 1)::BIGINT AS start, (pos - 1 + length(hit))::BIGINT AS stop FROM findings")
def match_regex_arrow(spark, sf_dir):
    patterns = match.plan(rules())
    names = F.array(*[F.lit(p["rule"]["id"]) for p in patterns])
    out = match.arrow_matches(lines(spark, sf_dir), patterns)
    return out.select(F.element_at(names, F.col("k") + 1).alias("rule_id"), F.col("path").alias("file"), F.col("line_no").cast("long").alias("line"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


_STEMS = "ander ation chent derun einhe enten ereau hatin keitu reand schen tiono".split()
_ENDINGS = "ing ed ion er en".split()
_CALLS = "read write open close send load parse exec fetch delete update create query render sign hash copy move mount watch trace dump".split()
_OBJECTS = "user token cookie session header secret password query path file socket shell page form image cache token config header key".split()


def _pack() -> list[tuple[str, str]]:
    """(id, pattern) of a large pack by rule: calls on objects, which texts hold rarely, and after every seventh of these a
    stem that takes letters before an ending."""
    calls = [(f"{c}-{o}-{n}", rf"(?i){c}_?{o}\s*\(") for n, o in enumerate(_OBJECTS) for c in _CALLS]
    words = [(f"{s}-{e}", ("(^|[ (])" if k % 3 else "") + s + "[a-z]{0,4}" + e + ("([., ]|$)" if k % 2 else "")) for k, (e, s) in enumerate((e, s) for e in _ENDINGS for s in _STEMS)]
    out = []
    while calls or words:
        out += calls[:7] + words[:1]
        calls, words = calls[7:], words[1:]
    return out


def pack(size: int) -> list[dict]:
    return [catalog.parse({"id": i, "confidence": "high", "patterns": [{"type": "regex", "pattern": p, "where": [{"not-test-file": False}]}]}, k) for k, (i, p) in enumerate(_pack()[:size])]


def _pack_sql(size: int = 500) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches(text, {lit(p)}) THEN {{'id': '{i}', 'hit': regexp_extract(text, {lit(p)}, 0)}} END" for i, p in _pack()[:size])
    return f"WITH {LINES}, m AS (SELECT path, line_no, text, unnest([{each}]) AS m FROM lines) SELECT m.id AS rule_id, path AS file, line_no::BIGINT AS line, (instr(text, m.hit) - 1)::BIGINT AS start, length(m.hit)::BIGINT AS size FROM m WHERE m IS NOT NULL"


@query("match_pack", _pack_sql())
def match_pack(spark, sf_dir, size=500):
    """500 patterns at once, through the index of what they must hold."""
    patterns = match.plan(pack(size))
    names = F.array(*[F.lit(p["rule"]["id"]) for p in patterns])
    out = patternindex.indexed(lines(spark, sf_dir), patterns)
    return out.select(F.element_at(names, F.col("k") + 1).alias("rule_id"), F.col("path").alias("file"), F.col("line_no").cast("long").alias("line"), F.col("start").cast("long").alias("start"), (F.col("stop") - F.col("start")).cast("long").alias("size"))


@query("match_literal", f"WITH {LINES} SELECT path, line_no::BIGINT AS line, (strlen(substring(text, 1, instr(text, ' the ') - 1)) + 1)::BIGINT AS col FROM lines WHERE contains(text, ' the ')")
def match_literal(spark, sf_dir):
    rule = catalog.parse({"id": "the", "patterns": [{"type": "literal", "pattern": " the ", "where": [{"not-test-file": False}]}]})
    out = match.findings(lines(spark, sf_dir), [rule])
    return out.select(F.col("file").alias("path"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"))


@query(
    "match_languages_and_tests",
    f"WITH {LINES}, l AS (SELECT *, {_LANG} AS language, {_like(source.TEST_LIKE)} AS t FROM lines)"
    " SELECT path, line_no::BIGINT AS line, 'spoken' AS rule_id FROM l WHERE language IN ('python', 'java') AND NOT t AND contains(text, ' a ')"
    " UNION ALL SELECT path, line_no::BIGINT, 'every' FROM l WHERE contains(text, ' a ')",
)
def match_languages_and_tests(spark, sf_dir):
    some = [
        catalog.parse({"id": "spoken", "languages": ["Python", "java"], "patterns": [{"type": "literal", "pattern": " a ", "where": [{"not-test-file": True}]}]}, 0),
        catalog.parse({"id": "every", "languages": ["*"], "patterns": [{"type": "literal", "pattern": " a ", "where": [{"not-test-file": False}]}]}, 1),
    ]
    out = match.findings(lines(spark, sf_dir), some)
    return out.select(F.col("file").alias("path"), F.col("line").cast("long").alias("line"), "rule_id")


@query(
    "match_metavariables",
    f"WITH {LINES} SELECT path, line_no::BIGINT AS line, 'mail of ' || regexp_extract(text, '([a-zA-Z0-9._]+)@([a-zA-Z0-9.]+)[.]com', 1) || ' at ' || regexp_extract(text, '([a-zA-Z0-9._]+)@([a-zA-Z0-9.]+)[.]com', 2) AS message"
    " FROM lines WHERE regexp_matches(text, '([a-zA-Z0-9._]+)@([a-zA-Z0-9.]+)[.]com')",
)
def match_metavariables(spark, sf_dir):
    rule = catalog.parse({"id": "mail", "message": "mail of $user at ${user_host}", "patterns": [{"type": "regex", "pattern": r"(?P<user>[a-zA-Z0-9._]+)@(?P<user_host>[a-zA-Z0-9.]+)[.]com", "where": [{"not-test-file": False}]}]})
    out = match.findings(lines(spark, sf_dir), [rule])
    return out.select(F.col("file").alias("path"), F.col("line").cast("long").alias("line"), "message")


@query(
    "where_sanitized",
    f"WITH {context_sql('email', 'card')} SELECT rule_id, file, line::BIGINT AS line FROM near WHERE NOT list_bool_or(list_transform({SLICE.format(a='line - 4', b='line + 2')}, x -> contains(x, 'license') OR contains(x, 'tion the')))",
)
def where_sanitized(spark, sf_dir):
    words = F.array(F.lit("license"), F.lit("tion the"))
    out = with_context(spark, sf_dir, "email", "card").where(~match.sanitized(F.col("lines"), F.col("line"), words))
    return out.select("rule_id", "file", F.col("line").cast("long").alias("line"))


@query(
    "where_inside_function",
    f"WITH {context_sql('email', 'card')} SELECT rule_id, file, line::BIGINT AS line FROM near WHERE line > 1 AND list_bool_or(list_transform({SLICE.format(a='line - 19', b='line - 1')}, x -> regexp_matches(x, 'the [a-z]+tion')))",
)
def where_inside_function(spark, sf_dir):
    out = with_context(spark, sf_dir, "email", "card").where(match.inside_function(F.col("lines"), F.col("line"), F.lit("the [a-z]+tion")))
    return out.select("rule_id", "file", F.col("line").cast("long").alias("line"))


_SNIPPETS = (
    "CASE doc_id % 6 WHEN 0 THEN '\"' || source || '\"' WHEN 1 THEN '  ''' || source || '''' WHEN 2 THEN '`' || source || '`' WHEN 3 THEN '`${' || source || '}`' WHEN 4 THEN cast(doc_id AS string) ELSE source END"
)


@query(
    "where_constant",
    f"WITH s AS (SELECT doc_id, trim({_SNIPPETS}) AS s FROM documents) SELECT doc_id, (starts_with(s, '\"') AND ends_with(s, '\"')) OR (starts_with(s, '''') AND ends_with(s, ''''))"
    " OR (starts_with(s, '`') AND ends_with(s, '`') AND NOT contains(s, '${')) OR regexp_matches(s, '^[0-9]+$') AS constant FROM s",
)
def where_constant(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.is_constant(F.expr(_SNIPPETS)).alias("constant"))


@query(
    "where_file_context",
    f"WITH {LINES}, {found('email')} SELECT f.file, f.line::BIGINT AS line FROM findings f JOIN files ON path = f.file WHERE regexp_matches(content, '[a-z]+tion') AND NOT contains(content, 'license')",
)
def where_file_context(spark, sf_dir):
    rule = catalog.parse({"id": "email", "patterns": [{"type": "regex", "pattern": RULES[0][4], "where": [{"not-test-file": False}], "inside": {"type": "regex", "pattern": "[a-z]+tion"}, "not-inside": {"type": "literal", "pattern": "license"}}]})
    out = match.where(source.with_lines(match.findings(lines(spark, sf_dir), [rule]), files(spark, sf_dir)))
    return out.select("file", F.col("line").cast("long").alias("line"))


@query(
    "operator_either",
    f"WITH {LINES}, p AS (SELECT unnest(['the ', 'les ', 'der ']) AS w) SELECT path, line_no::BIGINT AS line, w AS text, (strlen(substring(lines.text, 1, instr(lines.text, w) - 1)) + 1)::BIGINT AS col FROM lines, p WHERE contains(lines.text, w)",
)
def operator_either(spark, sf_dir):
    out = match.operate(lines(spark, sf_dir), {"either": ["the ", "les ", "der "]})
    return out.select("path", F.col("line_no").cast("long").alias("line"), "text", F.col("column").cast("long").alias("col"))


_OPERATOR = "hits AS (SELECT path, line_no, text FROM lines WHERE regexp_matches(text, '[0-9]{4,}'))"


@query(
    "operator_inside",
    f"WITH {LINES}, {_OPERATOR} SELECT path, line_no::BIGINT AS line FROM hits h WHERE EXISTS (SELECT 1 FROM lines c WHERE c.path = h.path AND contains(c.text, 'tion of') AND h.line_no BETWEEN c.line_no AND c.line_no + 20)",
)
def operator_inside(spark, sf_dir):
    out = match.operate(lines(spark, sf_dir), {"regex": "[0-9]{4,}", "inside": "tion of"})
    return out.select("path", F.col("line_no").cast("long").alias("line"))


@query(
    "operator_not_inside",
    f"WITH {LINES}, {_OPERATOR} SELECT path, line_no::BIGINT AS line FROM hits h WHERE NOT contains(text, ' is ') AND NOT regexp_matches(text, '@[a-z]')"
    " AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.path = h.path AND contains(c.text, 'tion of') AND h.line_no BETWEEN c.line_no AND c.line_no + 20)",
)
def operator_not_inside(spark, sf_dir):
    out = match.operate(lines(spark, sf_dir), {"regex": "[0-9]{4,}", "not_inside": "tion of", "not": " is ", "not_regex": "@[a-z]"})
    return out.select("path", F.col("line_no").cast("long").alias("line"))


@query(
    "operator_metavariable",
    f"WITH {LINES}, m AS (SELECT path, line_no, text, regexp_extract(text, '([a-z0-9]+)@mail([0-9]+)', 0) AS whole, regexp_extract(text, '([a-z0-9]+)@mail([0-9]+)', 2) AS v FROM lines WHERE regexp_matches(text, '([a-z0-9]+)@mail([0-9]+)'))"
    " SELECT path, line_no::BIGINT AS line, v AS text, (strlen(substring(text, 1, instr(text, whole) - 1)) + instr(whole, v))::BIGINT AS col FROM m WHERE regexp_matches(v, '^[0-4]')",
)
def operator_metavariable(spark, sf_dir):
    out = match.operate(lines(spark, sf_dir), {"metavariable": ("(?P<user>[a-z0-9]+)@mail(?P<n>[0-9]+)", "n", "^[0-4]")})
    return out.select("path", F.col("line_no").cast("long").alias("line"), "text", F.col("column").cast("long").alias("col"))


# ---- suppression ----

_MARKS = (
    "CASE WHEN doc_id % 4 = 0 THEN text || ' // scan-ignore: email, Card' WHEN doc_id % 4 = 1 THEN '# scan-ignore-next-line' || chr(10) || text"
    " WHEN doc_id % 4 = 2 THEN '/* scan-ignore: common */' || chr(10) || text ELSE '// scan-ignore-next-line: license,common' || chr(10) || text END"
)
_MARKED = f"files AS (SELECT {PATH} AS path, {_MARKS} AS content FROM documents WHERE text IS NOT NULL)"
_MARKED_LINES = LINES.replace(FILES, _MARKED)
_ENTRIES = (
    "marked AS (SELECT path, line_no, trim(text) AS s FROM lines WHERE contains(text, 'scan-ignore')),"
    " comments AS (SELECT path, line_no, CASE WHEN contains(s, '//') THEN trim(substring(s, instr(s, '//') + 2)) WHEN contains(s, '#') THEN trim(substring(s, instr(s, '#') + 1))"
    " WHEN starts_with(s, '/*') AND ends_with(s, '*/') THEN trim(substring(s, 3, length(s) - 4)) ELSE '' END AS c FROM marked),"
    " entries AS (SELECT path, line_no, true AS next_line, regexp_extract(c, '(?i)\\bscan-ignore-next-line(?:\\s*:\\s*([\\w\\-,\\s]+))?', 1) AS l FROM comments WHERE regexp_matches(c, '(?i)\\bscan-ignore-next-line')"
    " UNION ALL SELECT path, line_no, false, regexp_extract(c, '(?i)\\bscan-ignore\\s*:\\s*([\\w\\-,\\s]+)', 1) FROM comments WHERE regexp_matches(c, '(?i)\\bscan-ignore\\s*:\\s*[\\w\\-,\\s]+')),"
    " directives AS (SELECT path, line_no, next_line, line_no + next_line::INT AS effective, list_filter(list_transform(string_split(lower(l), ','), x -> trim(x)), x -> x <> '') AS names FROM entries)"
)


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(_MARKS).alias("content"))


@query("suppress_parse", f"WITH {_MARKED_LINES}, {_ENTRIES} SELECT path, line_no::BIGINT AS line, next_line, effective::BIGINT AS effective, array_to_string(names, ',') AS names FROM directives")
def suppress_parse(spark, sf_dir):
    out = suppress.parse(source.lines(_marked(spark, sf_dir)))
    return out.select("path", F.col("line_no").cast("long").alias("line"), "next_line", F.col("effective_line").cast("long").alias("effective"), F.array_join("rules", ",").alias("names"))


_HIT = "d.path = f.file AND d.effective = f.line AND (len(d.names) = 0 OR list_contains(d.names, f.rule_id))"


@query("suppress_findings", f"WITH {_MARKED_LINES}, {found()}, {_ENTRIES} SELECT rule_id, file, line::BIGINT AS line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE {_HIT})")
def suppress_findings(spark, sf_dir):
    own = source.lines(_marked(spark, sf_dir))
    out = suppress.unsuppressed(match.findings(own, rules()), suppress.parse(own))
    return out.select("rule_id", "file", F.col("line").cast("long").alias("line"))


@query("suppress_counts", f"WITH {_MARKED_LINES}, {found()}, {_ENTRIES} SELECT rule_id, count(*) AS suppressed FROM findings f WHERE EXISTS (SELECT 1 FROM directives d WHERE {_HIT}) GROUP BY rule_id")
def suppress_counts(spark, sf_dir):
    own = source.lines(_marked(spark, sf_dir))
    return suppress.suppressed_counts(match.findings(own, rules()), suppress.parse(own))


_NOTES = (
    "CASE WHEN doc_id % 3 = 0 THEN '// #scan-ignore-begin email cwe-200 -- known' || chr(10) || text || chr(10) || '// #scan-ignore-end' WHEN doc_id % 3 = 1 THEN '// #scan-ignore card' || chr(10) || text"
    " ELSE '// #scan-ignore-begin' || chr(10) || text END"
)
_NOTED = LINES.replace(FILES, f"files AS (SELECT source || '/n' || cast(doc_id AS string) || '.js' AS path, {_NOTES} AS content, doc_id FROM documents WHERE text IS NOT NULL)")


def _noted(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr("source || '/n' || cast(doc_id AS string) || '.js'").alias("path"), F.expr(_NOTES).alias("content"))


@query(
    "annotate_parse",
    f"WITH {_NOTED}, marks AS (SELECT path, line_no, trim(text) AS s FROM lines WHERE contains(text, '// #scan-ignore')),"
    " spans AS (SELECT path, line_no AS a, (SELECT min(e.line_no) FROM marks e WHERE e.path = m.path AND e.line_no > m.line_no AND contains(e.s, '-end')) AS b, 'email,CWE-200,known' AS what FROM marks m WHERE contains(s, '-begin'))"
    " SELECT path, a::BIGINT AS line_start, b::BIGINT AS line_end, what FROM spans WHERE b IS NOT NULL UNION ALL SELECT path, line_no::BIGINT, line_no::BIGINT, 'card,,' FROM marks WHERE NOT contains(s, '-begin') AND NOT contains(s, '-end')",
)
def annotate_parse(spark, sf_dir):
    out = suppress.annotations(source.lines(_noted(spark, sf_dir)))
    what = F.concat_ws(",", F.array_join("rule_ids", "+"), F.array_join("cwes", "+"), "justification")
    return out.select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), what.alias("what"))


@query(
    "annotate_findings",
    f"WITH {_NOTED}, {found()} SELECT rule_id, file, line::BIGINT AS line FROM findings WHERE NOT (regexp_extract(file, 'n([0-9]+)[.]js$', 1)::BIGINT % 3 = 0)",
)
def annotate_findings(spark, sf_dir):
    # A block names CWE-200, which all rules have; the single line of the others has no finding.
    own = source.lines(_noted(spark, sf_dir))
    out = suppress.unannotated(match.findings(own, rules()), suppress.annotations(own))
    return out.select("rule_id", "file", F.col("line").cast("long").alias("line"))


# ---- secrets ----


def _secret_sql() -> str:
    parts = []
    for kind, _, severity, p in secrets.SECRETS:
        groups = p.count("(") - p.count("(?") - p.count("\\(")
        value = f"unnest(regexp_extract_all(text, {lit(p)}, {groups}))" if groups else "NULL::VARCHAR"
        parts.append(f"SELECT path, line_no, {lit(kind)} AS type, {lit(severity)} AS severity, unnest(regexp_extract_all(text, {lit(p)})) AS whole, {value} AS v, text FROM lines WHERE regexp_matches(text, {lit(p)})")
    return " UNION ALL ".join(parts)


_SECRET_TEXT = "text || CASE doc_id % 9 WHEN 0 THEN chr(10) || 'api_key = \"a1b2c3d4e5f6g7h8i9\"' WHEN 1 THEN chr(10) || 'password: changeme1234 passwd=hunter2hunter2' WHEN 2 THEN chr(10) || 'Bearer abcdefghijklmnopqrstuvwx' WHEN 3 THEN chr(10) || 'x = ''Zq3vT9sLmW8xRb2KpY7c''' ELSE '' END"
_SECRET_LINES = LINES.replace(FILES, f"files AS (SELECT {PATH} AS path, {_SECRET_TEXT} AS content FROM documents WHERE text IS NOT NULL)")


def _secret_lines(spark, sf_dir):
    return source.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(_SECRET_TEXT).alias("content")))


_DUMMY = " OR ".join(f"lower(m) = {lit(d)} OR starts_with(lower(m), {lit(d)}) OR ends_with(lower(m), {lit(d)})" for d in secrets.DUMMIES)


@query("secret_patterns", f"WITH {_SECRET_LINES}, s AS ({_secret_sql()}), v AS (SELECT *, CASE WHEN v IS NOT NULL AND v <> '' THEN v ELSE whole END AS m FROM s) SELECT path, line_no::BIGINT AS line, type, severity, m AS match, (strlen(substring(text, 1, instr(text, whole) - 1)) + 1)::BIGINT AS col FROM v WHERE NOT ({_DUMMY})")
def secret_patterns(spark, sf_dir):
    out = secrets.named(_secret_lines(spark, sf_dir))
    return out.select("path", F.col("line_no").cast("long").alias("line"), "type", "severity", "match", F.col("column").cast("long").alias("col"))


_ENTROPY = "round(list_sum(list_transform(list_distinct(string_split(m, '')), c -> -(len(list_filter(string_split(m, ''), x -> x = c)) / strlen(m)) * log2(len(list_filter(string_split(m, ''), x -> x = c)) / strlen(m)))), 6)"


@query("secret_entropy", f"WITH {_SECRET_LINES}, q AS (SELECT path, line_no, unnest(regexp_extract_all(text, {lit(secrets.QUOTED)}, 1)) AS m FROM lines) SELECT path, line_no::BIGINT AS line, m AS match, {_ENTROPY} AS entropy FROM q")
def secret_entropy(spark, sf_dir):
    return secrets.quoted(_secret_lines(spark, sf_dir)).select("path", F.col("line_no").cast("long").alias("line"), "match", F.round("entropy", 6).alias("entropy"))


@query(
    "secret_random_looking",
    f"WITH {_SECRET_LINES}, q AS (SELECT path, line_no, unnest(regexp_extract_all(text, {lit(secrets.QUOTED)}, 1)) AS m FROM lines), e AS (SELECT *, {_ENTROPY} AS entropy FROM q)"
    f" SELECT path, line_no::BIGINT AS line, m AS match FROM e WHERE length(m) BETWEEN 16 AND 128 AND entropy >= 3.9 AND NOT ({_DUMMY}) AND NOT ({' OR '.join('regexp_matches(m, ' + lit(p) + ')' for *_, p in secrets.SECRETS)})",
)
def secret_random_looking(spark, sf_dir):
    return secrets.random_looking(_secret_lines(spark, sf_dir), threshold=3.9).select("path", F.col("line_no").cast("long").alias("line"), "match")


# ---- refinement ----


@query(
    "dedup_findings",
    f"WITH {FOUND}, doubled AS (SELECT * FROM findings UNION ALL SELECT * REPLACE ('again ' || message AS message, rule_ord + 10 AS rule_ord) FROM findings) SELECT rule_id, file, line::BIGINT AS line, message FROM doubled QUALIFY row_number() OVER (PARTITION BY file, line, rule_id ORDER BY rule_ord, col) = 1",
)
def dedup_findings(spark, sf_dir):
    f = findings(spark, sf_dir)
    doubled = f.unionByName(f.withColumns({"message": F.concat(F.lit("again "), "message"), "rule_ord": F.col("rule_ord") + 10}))
    return refine.dedup(doubled).select("rule_id", "file", F.col("line").cast("long").alias("line"), "message")


@query(
    "circuit_breaker",
    f"WITH {FOUND}, per AS (SELECT rule_id, file, count(*) AS c FROM findings GROUP BY ALL), noise AS (SELECT rule_id, sum(c) AS total, max(c) AS most FROM per GROUP BY rule_id)"
    " SELECT f.rule_id, file, line::BIGINT AS line, CASE WHEN most > 2 THEN '[noisy rule] ' || message ELSE message END AS message, CASE WHEN most > 2 THEN 'low' ELSE 'high' END AS confidence FROM findings f JOIN noise n ON n.rule_id = f.rule_id WHERE total <= 300",
)
def circuit_breaker(spark, sf_dir):
    return refine.breaker(findings(spark, sf_dir), 2, 300).select("rule_id", "file", F.col("line").cast("long").alias("line"), "message", "confidence")


@query("severity_summary", f"WITH {FOUND} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (severity = {lit(s)}) AS {s}' for s in ('critical', 'high', 'medium', 'low', 'info'))} FROM findings")
def severity_summary(spark, sf_dir):
    return refine.summary(findings(spark, sf_dir))


@query("severity_groups", f"WITH {FOUND} SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def severity_groups(spark, sf_dir):
    return refine.severity_counts(findings(spark, sf_dir))


@query("ci_failing", f"WITH {FOUND} SELECT count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS failing, false AS has_fixes FROM findings")
def ci_failing(spark, sf_dir):
    f = findings(spark, sf_dir)
    return refine.failing(f, "medium").crossJoin(refine.has_fixes(f))


@query("file_rollup", f"WITH {FOUND} SELECT file, count(*) FILTER (severity IN ('critical', 'high')) AS errors, count(*) FILTER (severity = 'medium') AS warnings, count(*) FILTER (severity NOT IN ('critical', 'high', 'medium')) AS others FROM findings GROUP BY file")
def file_rollup(spark, sf_dir):
    return refine.per_document(findings(spark, sf_dir))


@query("first_on_line", f"WITH {FOUND} SELECT file, line::BIGINT AS line, rule_id FROM findings QUALIFY row_number() OVER (PARTITION BY file, line ORDER BY rule_ord, col) = 1")
def first_on_line(spark, sf_dir):
    return refine.first_on_line(findings(spark, sf_dir)).select("file", F.col("line").cast("long").alias("line"), "rule_id")


@query("rule_groups", f"WITH {FOUND} SELECT rule_id, count(*) AS n, md5(string_agg(file || ':' || line || ':' || col, ',' ORDER BY file, line, col)) AS places FROM findings GROUP BY rule_id")
def rule_groups(spark, sf_dir):
    out = refine.by_rule(findings(spark, sf_dir))
    places = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["file"], p["line"].cast("string"), p["column"].cast("string"))), ",")
    return out.select("rule_id", "n", F.md5(places.cast("binary")).alias("places"))


@query("rule_taxonomy", f"WITH {FOUND} SELECT rule_id, any_value(rule_name) AS rule_name, any_value(severity) AS severity, 'CWE-200' AS cwe, count(*) AS n FROM findings GROUP BY rule_id")
def rule_taxonomy(spark, sf_dir):
    return refine.taxonomy(findings(spark, sf_dir)).select("rule_id", "rule_name", "severity", "cwe", "n")


@query(
    "proximity_boost",
    f"WITH {LINES}, {found('email', 'card')}, one AS (SELECT * FROM findings) SELECT a.rule_id, a.file, a.line::BIGINT AS line, round(CASE WHEN any_value(g.n) > 1 THEN count(b.rule_id) / any_value(g.n) ELSE 0 END, 9) AS proximity"
    " FROM one a JOIN (SELECT file, category, count(*) AS n FROM one GROUP BY ALL) g ON g.file = a.file AND g.category = a.category LEFT JOIN one b ON b.file = a.file AND b.category = a.category AND b.rule_id <> a.rule_id AND abs(a.line - b.line) <= 20 GROUP BY a.rule_id, a.file, a.line, a.col",
)
def proximity_boost(spark, sf_dir):
    return refine.boosted(findings(spark, sf_dir, "email", "card")).select("rule_id", "file", F.col("line").cast("long").alias("line"), F.round("proximity", 9).alias("proximity"))


# ---- comparison ----

_OLD = "old AS (SELECT *, line + strlen(file) % 8 AS old_line FROM findings WHERE strlen(file || rule_id) % 3 <> 0)"
_KNOWN = "o.rule_id = f.rule_id AND o.file = f.file AND ((o.old_line = f.line AND o.col = f.col) OR (o.snippet = f.snippet AND abs(o.old_line - f.line) <= 5))"


def _before(f: DataFrame) -> DataFrame:
    size = F.octet_length("file")
    return f.where((size + F.octet_length("rule_id")) % 3 != 0).withColumn("line", (F.col("line") + size % 8).cast("int"))


@query("baseline_new", f"WITH {FOUND}, {_OLD} SELECT rule_id, file, line::BIGINT AS line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_KNOWN})")
def baseline_new(spark, sf_dir):
    f = findings(spark, sf_dir)
    return compare.new(f, compare.records(_before(f))).select("rule_id", "file", F.col("line").cast("long").alias("line"))


@query("baseline_known", f"WITH {FOUND}, {_OLD} SELECT rule_id, file, line::BIGINT AS line FROM findings f WHERE EXISTS (SELECT 1 FROM old o WHERE {_KNOWN})")
def baseline_known(spark, sf_dir):
    f = findings(spark, sf_dir)
    return compare.known(f, compare.records(_before(f))).select("rule_id", "file", F.col("line").cast("long").alias("line"))


@query(
    "baseline_records",
    f"WITH {FOUND} SELECT rule_id, file, line::BIGINT AS line, 'sha256:' || substring(sha256(snippet), 1, 16) AS snippet_hash, rule_id || ':' || file || ':' || line || ':' || category AS key, lower(hex(line * col + strlen(rule_id) + strlen(message))) AS hash FROM findings",
)
def baseline_records(spark, sf_dir):
    return findings(spark, sf_dir).select("rule_id", "file", F.col("line").cast("long").alias("line"), fn.snippet_hash("snippet").alias("snippet_hash"), compare.key().alias("key"), compare.finding_hash().alias("hash"))


@query(
    "scan_comparison",
    f"WITH {FOUND}, {_OLD}, a AS (SELECT DISTINCT rule_id || ':' || file || ':' || line || ':' || category AS key FROM findings), b AS (SELECT DISTINCT rule_id || ':' || file || ':' || old_line || ':' || category AS key FROM old)"
    " SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'fixed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.key = b.key",
)
def scan_comparison(spark, sf_dir):
    f = findings(spark, sf_dir)
    return compare.scans(f, _before(f))


@query("cache_stale", f"WITH {FILES} SELECT path, sha256(content) AS hash FROM files WHERE NOT (strlen(path) % 2 = 0)")
def cache_stale(spark, sf_dir):
    f = compare.hashed(files(spark, sf_dir))
    old = f.withColumn("hash", F.when(F.octet_length("path") % 2 == 0, F.col("hash")).otherwise("changed"))
    return compare.stale(f, compare.entries(old, findings(spark, sf_dir, "card"))).select("path", "hash")


@query("cache_expiry", "SELECT count(*) AS entries, count(*) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY) AS expired FROM events")
def cache_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return compare.cache_stats(e, "ts", 3, F.lit(e.agg(F.max("ts")).first()[0]))


# ---- policies and gates ----


@query(
    "policy_violations",
    f"WITH {FOUND} SELECT 'max_findings' AS kind, severity AS subject, count(*) AS found, (CASE severity WHEN 'high' THEN 3 ELSE 100000 END)::BIGINT AS allowed FROM findings WHERE severity IN ('high', 'low') GROUP BY severity HAVING count(*) > allowed"
    " UNION ALL SELECT 'blocked_rule', rule_id, 1, 0 FROM findings WHERE rule_id = 'email'",
)
def policy_violations(spark, sf_dir):
    return gates.policy_violations(findings(spark, sf_dir), gates.Policy({"high": 3, "low": 100000}, ("email",)))


@query(
    "quality_gate",
    f"WITH {FOUND}, kept AS (SELECT * FROM findings WHERE NOT (regexp_matches(file, '^src1/[^/]*$') AND rule_id = 'common')), c AS (SELECT count(*) AS total, {', '.join(f'count(*) FILTER (severity = {lit(s)}) AS {s}' for s in ('critical', 'high', 'medium', 'low'))}, count(*) FILTER (category IN ('secrets', 'hardcoded-secrets')) AS secrets FROM kept),"
    " v AS (SELECT unnest([{'check': 'max_critical', 'found': critical, 'allowed': 0::BIGINT}, {'check': 'max_high', 'found': high, 'allowed': 5}, {'check': 'max_medium', 'found': medium, 'allowed': 20}, {'check': 'max_low', 'found': low, 'allowed': 50}, {'check': 'max_total', 'found': total, 'allowed': 100}, {'check': 'max_secrets', 'found': secrets, 'allowed': 0}, {'check': 'no_secrets', 'found': secrets, 'allowed': 0}]) AS x FROM c)"
    " SELECT x.\"check\" AS \"check\", x.found AS found, x.allowed AS allowed FROM v WHERE x.found > x.allowed",
)
def quality_gate(spark, sf_dir):
    return gates.gate_violations(findings(spark, sf_dir), gates.Gate(ignore=(("src1/*", ("common",)),)))


# ---- scores ----


def _any(words, x="x") -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


_DEPTH = " + ".join([
    "(contains(x, 'if ') AND contains(x, '!= nil'))::INT", "(contains(x, 'if ') AND (contains(x, 'err ') OR contains(x, 'error')))::INT",
    "(contains(x, 'validate') OR contains(x, 'Validate'))::INT", "(contains(x, 'check') OR contains(x, 'Check'))::INT", "(contains(x, 'guard') OR contains(x, 'Guard'))::INT",
])
_CODE = "text || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'if err != nil { check error }' WHEN 1 THEN chr(10) || 'value = validated(safe_name)' WHEN 2 THEN chr(10) || '// test only: sanitize and escape' ELSE '' END"
_CODED = LINES.replace(FILES, f"files AS (SELECT {PATH} AS path, {_CODE} AS content FROM documents WHERE text IS NOT NULL)")
_NEAR = _CODED + ", " + found() + ", near AS (SELECT f.*, a.ls FROM findings f JOIN arrays a ON a.path = f.file)"


def _coded(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(_CODE).alias("content"))


def _near(spark, sf_dir, mark):
    return match.findings_near(_coded(spark, sf_dir), rules(), scores.REACH, mark)


@query(
    "score_confidence",
    f"WITH {_NEAR} SELECT rule_id, file, line::BIGINT AS line, round(least(greatest(0.5 + 0.1 + list_sum(list_transform({SLICE.format(a='line - 10', b='line + 9')}, x -> {_DEPTH})) / 20.0 * 0.1"
    " + CASE category WHEN 'sqli' THEN CASE WHEN contains(snippet, '+') OR contains(snippet, '${') THEN 1.0 ELSE 0.8 END WHEN 'xss' THEN CASE WHEN contains(snippet, 'innerHTML') THEN 1.0 ELSE 0.7 END WHEN 'crypto' THEN 0.6 ELSE 0.5 END * 0.15"
    f" - CASE WHEN list_bool_or(list_transform({SLICE.format(a='line - 5', b='line')}, x -> regexp_matches(lower(x), {lit('|'.join(scores.VALIDATED))}))) THEN 0.2 ELSE 0 END"
    " - CASE WHEN contains(file, '_test.') OR contains(file, '_spec.') THEN 0.15 ELSE 0 END, 0), 1), 6) AS score FROM near",
)
def score_confidence(spark, sf_dir):
    return scores.confidence(_near(spark, sf_dir, scores.confidence_mark)).select("rule_id", "file", F.col("line").cast("long").alias("line"), F.round("confidence_score", 6).alias("score"))


def _first_sql(a: str, b: str, words) -> str:
    return f"(greatest({a}, 1) + list_position(list_transform({SLICE.format(a=a, b=b)}, x -> {_any(words, 'lower(x)')}), true) - 1)"


def _common_sql() -> str:
    one = lambda name: "(" + " OR ".join(f"regexp_matches(lower(snippet), {lit(p)})" for p in scores.COMMON[name]) + ")"
    return f"CASE category WHEN 'sqli' THEN {one('sqli')} WHEN 'xss' THEN {one('xss')} WHEN 'crypto' THEN {one('crypto')} ELSE {one('secrets')} END"


_FP = {
    "test": f"CASE WHEN {_any(scores.TEST_PATHS, 'lower(file)')} THEN 1.0 WHEN contains(lower(snippet), 'test') AND contains(lower(snippet), 'only') THEN 0.5 ELSE 0.0 END",
    "names": f"CASE WHEN {_any(scores.SAFE_NAMES, 'lower(snippet)')} THEN 1.0 ELSE 0.0 END",
    "validation": f"coalesce((6 - (line - {_first_sql('line - 5', 'line', scores.CHECKS)})) / 6.0, 0.0)",
    "common": f"CASE WHEN {_common_sql()} THEN 1.0 ELSE 0.0 END",
    "documentation": "CASE WHEN " + " OR ".join(f"starts_with(trim(ls[line]), {lit(p)})" for p in ("//", "/*", "*", "#", '"""', "'")) + " THEN 1.0 ELSE 0.0 END",
    "value": f"CASE WHEN {_any(scores.SAFE_VALUES, 'lower(snippet)')} THEN 1.0 ELSE 0.0 END",
    "sanitizer": f"coalesce((6 - (line - {_first_sql('line - 5', 'line + 5', scores.SANITIZERS)})) / 6.0, 0.0)",
}


@query("score_false_positive", f"WITH {_NEAR} SELECT rule_id, file, line::BIGINT AS line, round({' + '.join(f'({v}) * {scores.WEIGHTS[k]}' for k, v in _FP.items())}, 6) AS score FROM near")
def score_false_positive(spark, sf_dir):
    return scores.false_positive(_near(spark, sf_dir, scores.false_positive_mark)).select("rule_id", "file", F.col("line").cast("long").alias("line"), F.round("fp_score", 6).alias("score"))


@query(
    "score_exploitability",
    f"WITH {FOUND} SELECT rule_id, category, count(*) AS n, any_value(CASE category WHEN 'sqli' THEN 0.95 WHEN 'xss' THEN 0.85 WHEN 'secrets' THEN 0.7 WHEN 'crypto' THEN 0.6 ELSE 0.5 END)::DOUBLE AS exploit_score,"
    " round(any_value(0.85::DOUBLE * CASE category WHEN 'sqli' THEN 0.77::DOUBLE WHEN 'xss' THEN 0.77::DOUBLE ELSE 0.44::DOUBLE END * 0.85::DOUBLE * CASE category WHEN 'xss' THEN 0.62::DOUBLE ELSE 0.85::DOUBLE END * 10.0::DOUBLE), 4) AS cvss,"
    " any_value(CASE category WHEN 'sqli' THEN 'Critical' WHEN 'xss' THEN 'High' WHEN 'secrets' THEN 'High' ELSE 'Medium' END) AS level FROM findings GROUP BY rule_id, category",
)
def score_exploitability(spark, sf_dir):
    out = scores.exploitability(findings(spark, sf_dir)).groupBy("rule_id", "category")
    return out.agg(F.count("*").alias("n"), F.max("exploit_score").alias("exploit_score"), F.round(F.max("cvss"), 4).alias("cvss"), F.max("exploit_severity").alias("level"))


_VALID = "regexp_matches(text, " + lit("|".join(f"(?:{p})" for p in scores.VALIDATORS["python"])) + ")"
_VALID_TEXT = LINES.replace(FILES, f"files AS (SELECT source || '/v' || cast(doc_id AS string) || '.py' AS path, {_CODE} || CASE doc_id % 2 WHEN 0 THEN chr(10) || 'isinstance(x, str)' ELSE '' END AS content FROM documents WHERE text IS NOT NULL)")


def _validated_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return source.lines(rows.select(F.expr("source || '/v' || cast(doc_id AS string) || '.py'").alias("path"), F.expr(_CODE + " || CASE doc_id % 2 WHEN 0 THEN chr(10) || 'isinstance(x, str)' ELSE '' END").alias("content")))


@query("validated_lines", f"WITH {_VALID_TEXT}, v AS (SELECT path, line_no, bool_or({_VALID}) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS ok FROM lines) SELECT path, count(*) FILTER (ok) AS validated FROM v GROUP BY path")
def validated_lines(spark, sf_dir):
    return scores.validated(_validated_lines(spark, sf_dir)).groupBy("path").agg(F.count_if("is_validated").alias("validated"))


@query("validation_strength", f"WITH {_VALID_TEXT}, r AS (SELECT path, count(*) FILTER ({_VALID}) / count(*) AS r FROM lines GROUP BY path) SELECT path, round(CASE WHEN r > 0.3 THEN 1.0 ELSE r / 0.3 END, 6) AS strength FROM r")
def validation_strength(spark, sf_dir):
    return scores.validation_strength(_validated_lines(spark, sf_dir)).select("path", F.round("strength", 6).alias("strength"))


_DEAD_TEXT = "replace(text, '. ', '.' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '// old = 1' || chr(10) || '# call(2)' || chr(10) WHEN 1 THEN '// one(1)' || chr(10) ELSE '' END)"


@query(
    "commented_code",
    f"WITH {LINES.replace(FILES, f'files AS (SELECT {PATH} AS path, {_DEAD_TEXT} AS content FROM documents WHERE text IS NOT NULL)')},"
    " c AS (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS g FROM lines WHERE regexp_matches(text, '^\\s*(//|#)\\s*[a-zA-Z_][a-zA-Z0-9_]*\\s*[=(.]'))"
    " SELECT path, min(line_no)::BIGINT AS first, max(line_no)::BIGINT AS last FROM c GROUP BY path, g HAVING count(*) >= 2",
)
def commented_code(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(_DEAD_TEXT).alias("content"))
    return blocks.commented_code(source.lines(own)).select("path", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


_BRANCHY = "text || chr(10) || 'if (a) {' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'x = clean(y)' ELSE 'x = y' END || chr(10) || '} else {' || chr(10) || 'z()' || chr(10) || '}' || chr(10) || 'end'"


@query(
    "branches",
    f"WITH {LINES.replace(FILES, f'files AS (SELECT {PATH} AS path, {_BRANCHY} AS content, doc_id FROM documents WHERE text IS NOT NULL)')},"
    " d AS (SELECT path, line_no, text, sum(length(replace(text, '}', '')) - length(replace(text, '{', ''))) OVER (PARTITION BY path ORDER BY line_no) AS depth FROM lines),"
    " s AS (SELECT path, line_no AS first, depth - (length(replace(text, '}', '')) - length(replace(text, '{', ''))) AS before FROM d WHERE regexp_matches(text, '^\\s*if\\s*\\(')),"
    " e AS (SELECT s.path, first, (SELECT min(d.line_no) FROM d WHERE d.path = s.path AND d.line_no > first AND d.depth <= before) AS last FROM s)"
    f" SELECT e.path, first::BIGINT AS first, last::BIGINT AS last, bool_or(starts_with(trim(text), 'else') OR starts_with(trim(text), '}} else')) AS has_else, bool_or({_any(blocks.CLEANING + blocks.LEAVING, 'lower(text)')}) AS sanitizes"
    " FROM e JOIN lines ON lines.path = e.path AND line_no BETWEEN first AND last GROUP BY ALL",
)
def branches(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(_BRANCHY).alias("content"))
    return blocks.branches(source.lines(own)).select("path", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"), "has_else", "sanitizes")


_NESTED = (
    "replace(replace(text, '{', ''), '}', '') || chr(10) || repeat('if (a) {' || chr(10) || 'x()' || chr(10), cast(doc_id % 5 + 1 AS int)) || repeat('}' || chr(10), cast(doc_id % 5 + 1 AS int))"
    " || 'if (b)' || chr(10) || 'y()' || chr(10) || 'if (c) {' || chr(10) || repeat('if (d) { if (e) }' || chr(10), cast(doc_id % 3 AS int))"
)


@query(
    "block_tree",
    f"WITH {LINES.replace(FILES, f'files AS (SELECT {PATH} AS path, {_NESTED} AS content FROM documents WHERE text IS NOT NULL)')},"
    " deep AS (SELECT path, line_no, text, sum(length(replace(text, '}', '')) - length(replace(text, '{', ''))) OVER (PARTITION BY path ORDER BY line_no) AS depth FROM lines),"
    " d AS (SELECT *, depth - (length(replace(text, '}', '')) - length(replace(text, '{', ''))) AS before, max(line_no) OVER (PARTITION BY path) AS final FROM deep),"
    " s AS (SELECT path, line_no AS first, before, final FROM d WHERE regexp_matches(text, '^\\s*if\\s*\\(')),"
    " e AS (SELECT s.path, s.first, s.final, min(d.line_no) AS stop FROM s LEFT JOIN d ON d.path = s.path AND d.line_no > s.first AND d.depth <= s.before GROUP BY ALL)"
    " SELECT a.path, a.first::BIGINT AS first, coalesce(a.stop, a.final)::BIGINT AS last, max(o.first)::BIGINT AS parent, count(o.first) AS nesting FROM e a"
    " LEFT JOIN e o ON o.path = a.path AND o.first < a.first AND (o.stop IS NULL OR o.stop > a.first) GROUP BY a.path, a.first, a.stop, a.final",
)
def block_tree(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(_NESTED).alias("content"))
    return blocks.tree(source.lines(own)).select("path", *[F.col(a).cast("long").alias(b) for a, b in (("start", "first"), ("end", "last"), ("parent", "parent"), ("nesting", "nesting"))])


@query(
    "unreachable_code",
    f"WITH n AS (SELECT {PATH} AS path, len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL) SELECT path, (k + 3)::BIGINT AS first, (k + 4)::BIGINT AS last FROM n",
)
def unreachable_code(spark, sf_dir):
    tail = "replace(replace(text, '{', ''), '}', '') || chr(10) || 'f() {' || chr(10) || 'return 1' || chr(10) || 'g()' || chr(10) || 'h()' || chr(10) || '}'"
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.expr(PATH).alias("path"), F.expr(tail).alias("content"))
    return blocks.unreachable(own).select("path", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"))


# ---- reports and fixes ----


@query("report_sarif_rows", f"WITH {FOUND} SELECT rule_id, file, line::BIGINT AS line, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM findings")
def report_sarif_rows(spark, sf_dir):
    rows = reports.sarif_results(findings(spark, sf_dir))
    return rows.select(F.get_json_object("result", "$.ruleId").alias("rule_id"), "file", F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine").cast("long").alias("line"), F.get_json_object("result", "$.level").alias("level"))


@query("report_gitlab_rows", f"WITH {FOUND} SELECT rule_id, file, line::BIGINT AS line, upper(severity[1]) || severity[2:] AS severity, 'https://cwe.mitre.org/data/definitions/200.html' AS url FROM findings")
def report_gitlab_rows(spark, sf_dir):
    rows = reports.gitlab_rows(findings(spark, sf_dir))
    return rows.select("rule_id", "file", F.col("line").cast("long").alias("line"), F.get_json_object("vulnerability", "$.severity").alias("severity"), F.get_json_object("vulnerability", "$.identifiers[1].url").alias("url"))


@query("report_ignore_lines", f"WITH {FOUND} SELECT file || ':' || line || ':' || rule_id || ' -- Ignore ' || rule_name || ': ' || message AS value FROM findings")
def report_ignore_lines(spark, sf_dir):
    return reports.ignore_lines(findings(spark, sf_dir))


@query("report_diagnostics", f"WITH {context_sql('email', 'card', 'shout')} SELECT file, (line - 1)::BIGINT AS line, (CASE WHEN instr(ls[line], snippet) > 0 THEN instr(ls[line], snippet) - 1 WHEN instr(ls[line], trim(snippet)) > 0 THEN instr(ls[line], trim(snippet)) - 1 ELSE col - 1 END)::BIGINT AS first, rule_id AS code, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END::BIGINT AS severity FROM near")
def report_diagnostics(spark, sf_dir):
    out = reports.diagnostics(with_context(spark, sf_dir, "email", "card", "shout"))
    return out.select("file", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("first"), "code", F.col("severity").cast("long").alias("severity"))


@query("report_markdown", f"WITH {FOUND} SELECT severity AS key, md5(string_agg('- ' || file || ':' || line || ' ' || rule_id || ': ' || message, chr(10) ORDER BY '- ' || file || ':' || line || ' ' || rule_id || ': ' || message)) AS digest FROM findings GROUP BY severity")
def report_markdown(spark, sf_dir):
    return reports.grouped_markdown(findings(spark, sf_dir)).select("key", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "fix_files",
    "WITH t AS (SELECT 'pages/p' || page_id || '.html' AS path, html, string_split(html, chr(10)) AS ls FROM pages WHERE regexp_matches(html, 'track\\([0-9]+\\)'))"
    " SELECT path, md5(array_to_string(list_transform(ls, x -> regexp_replace(x, 'track\\([0-9]+\\);?', '', 'g')), chr(10))) AS digest, len(list_filter(ls, x -> regexp_matches(x, 'track\\([0-9]+\\)'))) AS changed FROM t",
)
def fix_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.expr("'pages/p' || cast(page_id AS string) || '.html'").alias("path"), F.col("html").alias("content"))
    rule = [r for r in catalog.load() if r["id"] == "page-tracker"]
    out = fixes.apply(pages, match.findings(source.lines(pages), rule))
    return out.select("path", F.md5(F.col("content").cast("binary")).alias("digest"), "changed")


@query(
    "fix_patches",
    f"WITH {LINES} SELECT path, array_to_string(list_concat(list_concat(ls[:0], ['new', 'lines']), ls[2:]), chr(10)) AS new_content, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,1 +1,2 @@' || chr(10) || '-' || ls[1] || chr(10) || '+new' || chr(10) || '+lines' AS diff FROM arrays",
)
def fix_patches(spark, sf_dir):
    edits = files(spark, sf_dir).withColumns({"start": F.lit(1), "end": F.lit(1), "replacement": F.lit("new\nlines")})
    return fixes.patches(edits).select("path", "new_content", "diff")


@query("fix_cache_key", "SELECT doc_id, substring(sha256(source || '|' || lang || '|' || doc_id), 1, 32) AS key FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def fix_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", fixes.cache_key("source", "lang", F.col("doc_id").cast("string")).alias("key"))


# ---- rules ----


#: A document as a rule: (column, expression of both forms).
_RULE_COLUMNS = {
    "id": "'r' || cast(doc_id AS string)", "name": "CASE doc_id % 9 WHEN 0 THEN 'Card number' WHEN 4 THEN 'A Shell' ELSE coalesce(source, '-') END", "category": "'c' || cast(cast(floor(doc_id / 10) AS int) AS string)",
    "severity": "CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END", "confidence": "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
}
#: (languages, frameworks, types of patterns), the one whose place is the remainder of the number of the document.
_SPOKEN = ((), ("*",), ("python",), ("go", "java"))
_FRAMED = ((), ("flask",), ("Django", "Flask"), (), ("gin",))
_TYPED = (("regex",), ("literal", "regex"), ("ast-query",), ("taint",), (), ("ast", "other"))


def _lists_sql(options: tuple) -> str:
    return f"CASE {' '.join(f'WHEN doc_id % {len(options)} = {n} THEN [' + ', '.join(map(lit, o)) + ']::VARCHAR[]' for n, o in enumerate(options))} END"


_RULE_ROWS = "rules AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RULE_COLUMNS.items()) + f", {_lists_sql(_SPOKEN)} AS languages, {_lists_sql(_FRAMED)} AS frameworks, {_lists_sql(_TYPED)} AS types FROM documents)"


def _catalog(spark, sf_dir) -> DataFrame:
    """A rule for each document."""
    pick = lambda options: F.element_at(F.array(*[F.array(*map(F.lit, o)).cast("array<string>") for o in options]), (F.col("doc_id") % len(options)).cast("int") + 1)
    out = table(spark, sf_dir, "documents").select(*[F.expr(e).alias(c) for c, e in _RULE_COLUMNS.items()], pick(_SPOKEN).alias("languages"), pick(_FRAMED).alias("frameworks"), pick(_TYPED).alias("_types"))
    return out.withColumn("patterns", F.transform("_types", lambda t: F.struct(t.alias("type")))).withColumn("description", F.lit("")).drop("_types")


@query(
    "rule_quality",
    f"WITH {_RULE_ROWS} SELECT id, (50 + coalesce(list_sum(list_transform(types, t -> CASE WHEN t IN ('ast', 'ast-query') THEN 20 WHEN t = 'taint' THEN 15 WHEN t = 'regex' THEN 5 WHEN t = 'literal' THEN 8 ELSE 0 END)), 0)"
    " + CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN -10 ELSE 0 END + CASE WHEN len(frameworks) > 0 THEN 10 ELSE 0 END + CASE WHEN len(languages) > 0 AND NOT list_contains(languages, '*') THEN 5 ELSE 0 END)::BIGINT AS quality FROM rules",
)
def rule_quality(spark, sf_dir):
    return catalog.quality(_catalog(spark, sf_dir)).select("id", F.col("quality_score").cast("long").alias("quality"))


@query("rule_search", f"WITH {_RULE_ROWS} SELECT id FROM rules WHERE contains(lower(name), 'card') OR contains(lower(name), 'shell') OR list_contains(languages, 'java')")
def rule_search(spark, sf_dir):
    every = _catalog(spark, sf_dir)
    return catalog.search(every, "card").union(catalog.search(every, "SHELL")).union(catalog.search(every, "java")).select("id").distinct()


@query("rule_categories", f"WITH {_RULE_ROWS} SELECT category, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM rules GROUP BY category")
def rule_categories(spark, sf_dir):
    return catalog.by_category(_catalog(spark, sf_dir)).select("category", "n", F.array_join("ids", ",").alias("ids"))


@query("rule_pruning", f"WITH {_RULE_ROWS} SELECT id FROM rules WHERE confidence = 'high' AND severity IN ('critical', 'high', 'medium', 'low') AND (len(frameworks) = 0 OR len(list_filter(frameworks, f -> lower(f) = 'flask')) > 0)")
def rule_pruning(spark, sf_dir):
    return catalog.pruned(_catalog(spark, sf_dir), frameworks=("Flask",)).select("id")


@query("rule_listing", f"WITH {_RULE_ROWS} SELECT id, severity FROM rules WHERE list_contains(languages, 'python') AND severity IN ('critical', 'high', 'medium')")
def rule_listing(spark, sf_dir):
    return catalog.listed(_catalog(spark, sf_dir), "Python", "medium").select("id", "severity")


# ---- modules, frameworks, trees ----

_MODULES = {
    "src/app.js": "import { input§, other } from './lib/source'\nconst db = require('./db')\nimport x from 'react'\nrun(input§)\n",
    "src/lib/source.js": "export const input§ = req.body.name\nexport function other() {}\n",
    "src/db/index.js": "module.exports = {\n  query,\n  close: end\n}\n",
    "src/use.py": "from .helpers import clean§, load\nimport os, sys\n",
    "src/helpers.py": "def load():\n    return request.args\n\ndef _hidden():\n    pass\n",
    "src/main.go": 'package main\nimport (\n  "fmt"\n  "net/http"\n)\nfunc Serve§() {}\nfunc hidden() {}\n',
    "src/A.java": "import java.util.List;\npublic class A {\n  public static void run§(String a) {}\n}\n",
    "src/B.cs": "using System.Text;\npublic class B {\n  public Task Run() {}\n}\n",
}
#: A document as a project: of the files given, those for which its number and theirs don't add up to a multiple of four, below a folder of its own; § is its number.
_HAS = "(doc_id + {k}) % 4 <> 0"
_IN = "'d' || doc_id || '/' ||"


def _project(spark, sf_dir, texts: dict[str, str]) -> DataFrame:
    each = F.posexplode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in texts.items()])).alias("k", "f")
    number = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", each).where(F.expr(_HAS.format(k="k")))
    return rows.select(F.concat(F.lit("d"), number, F.lit("/"), "f.path").alias("path"), F.replace("f.content", F.lit("§"), number).alias("content"))


def _project_sql(columns: str, rows: list[tuple], names: str) -> str:
    """`columns` of documents with `rows` (names), of which k is the file's number and t another's that must be there too."""
    values = ", ".join("(" + ", ".join("NULL" if v is None else lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    there = _HAS.format(k="k") + (" AND " + _HAS.format(k="t") if " t" in names else "")
    return f"SELECT {columns} FROM (SELECT doc_id FROM documents) AS d, (VALUES {values}) AS v({names}) WHERE {there}"


def _modules(spark, sf_dir):
    own = _project(spark, sf_dir, _MODULES)
    return own, source.lines(own)


@query("module_imports", _project_sql(f"{_IN} path AS path, line::BIGINT AS line, source, replace(names, '§', doc_id::VARCHAR) AS names", [
    (0, "src/app.js", 1, "./lib/source", "input§+other"), (0, "src/app.js", 2, "./db", "db"), (0, "src/app.js", 3, "react", "x"), (3, "src/use.py", 1, ".helpers", "clean§+load"), (3, "src/use.py", 2, "os", "os+sys"),
    (5, "src/main.go", None, "fmt", ""), (5, "src/main.go", None, "net/http", ""), (6, "src/A.java", 1, "java.util.List", ""), (7, "src/B.cs", 1, "System.Text", "")], "k, path, line, source, names"))
def module_imports(spark, sf_dir):
    own, ls = _modules(spark, sf_dir)
    return modules.imports(ls, own).select("path", F.col("line_no").cast("long").alias("line"), "source", F.array_join("names", "+").alias("names"))


@query("module_exports", _project_sql(f"{_IN} path AS path, line::BIGINT AS line, replace(name, '§', doc_id::VARCHAR) AS name", [
    (1, "src/lib/source.js", 1, "input§"), (1, "src/lib/source.js", 2, "other"), (2, "src/db/index.js", 1, "query"), (2, "src/db/index.js", 1, "close"), (4, "src/helpers.py", 1, "load"),
    (5, "src/main.go", 6, "Serve§"), (6, "src/A.java", 3, "run§"), (7, "src/B.cs", 3, "Run")], "k, path, line, name"))
def module_exports(spark, sf_dir):
    own, ls = _modules(spark, sf_dir)
    return modules.exports(ls, own).select("path", F.col("line_no").cast("long").alias("line"), "name")


@query("module_resolution", _project_sql(f"{_IN} 'src/app.js' AS path, source, {_IN} target AS target", [(0, 1, "./lib/source", "src/lib/source.js"), (0, 2, "./db", "src/db/index.js")], "k, t, source, target"))
def module_resolution(spark, sf_dir):
    own, ls = _modules(spark, sf_dir)
    return modules.resolved(modules.imports(ls, own), own).select("path", "source", "target")


@query("module_tainted_names", _project_sql(f"{_IN} 'src/app.js' AS path, replace(name, '§', doc_id::VARCHAR) AS name, {_IN} 'src/lib/source.js' AS module", [(0, 1, "input§"), (0, 1, "source.input§"), (0, 1, "other"), (0, 1, "source.other")], "k, t, name"))
def module_tainted_names(spark, sf_dir):
    own, ls = _modules(spark, sf_dir)
    return modules.tainted_names(modules.imports(ls, own), own, modules.tainted_exports(modules.exports(ls, own), own))


_MANIFESTS = {
    "package.json": '{"dependencies": {"express": "^4.§", "react": "18"}, "devDependencies": {"react": "17"}}', "requirements.txt": "Flask==2.0\nrequests\n",
    "go.mod": "require github.com/gin-gonic/gin v1.9", "composer.json": '{"require": {"laravel/framework": "10"}}', "Cargo.toml": 'axum = "0.7"', "app.py": "from flask import Flask\nCSRFProtect(app)\n",
}


@query(
    "framework_detection",
    "WITH f AS ("
    + _project_sql(f"{_IN} path AS path, name, replace(version, '§', doc_id::VARCHAR) AS version", [(0, "package.json", "express", "^4.§"), (0, "package.json", "react", "17"), (1, "requirements.txt", "flask", ""), (2, "go.mod", "gin", ""), (3, "composer.json", "laravel", "10"), (4, "Cargo.toml", "axum", "")], "k, path, name, version")
    + "), s AS (" + _project_sql(f"{_IN} 'app.py' AS path, 'flask' AS name, '' AS version", [(5,)], "k") + " ORDER BY path LIMIT 20) SELECT * FROM f UNION ALL SELECT * FROM s",
)
def framework_detection(spark, sf_dir):
    return frameworks.detect(_project(spark, sf_dir, _MANIFESTS)).select("path", "name", "version")


@query(
    "framework_middleware",
    "SELECT framework, missing FROM (VALUES (0, 'express', 'cors,helmet,rate-limit'), (1, 'flask', 'Talisman'), (2, 'gin', 'secure')) AS v(k, framework, missing) WHERE EXISTS (SELECT 1 FROM documents WHERE (doc_id + k) % 4 <> 0)",
)
def framework_middleware(spark, sf_dir):
    own = _project(spark, sf_dir, _MANIFESTS)
    return frameworks.missing_middleware(frameworks.detect(own), own).select("framework", F.array_join("missing", ",").alias("missing"))


_CODE_FILES = {
    "a.py": "import os\nx§ = request.args['q']\ny = shlex.quote(x§)\nos.system(y)\nos.system('ls ' + x§)\neval(x§)\n",
    "b.py": "def run(cmd):\n    os.system(cmd)\n\nrun(input())\n",
    "c.js": "const q = req.query.name;\nconst safe = escape(q);\ndb.query(`select ${q}`);\nel.innerHTML = safe;\neval(q);\n",
    "d.go": 'func h(r *http.Request) {\n  name := r.FormValue("name")\n  exec.Command(name)\n}\n',
    "E.java": 'class E { void f(Request req) { String n = req.getParameter("n"); st.executeQuery("a" + n); } }\n',
}


def _flow_rules() -> list[dict]:
    return [catalog.parse({"id": f"flow-{lang}", "languages": [lang], "severity": "high", "message": "flow", "patterns": [{"type": "taint"}]}, n) for n, lang in enumerate(taint.DEFAULTS)]


@query("syntax_queries", _project_sql(f"{_IN} 'a.py' AS file, 6::BIGINT AS line, 'eval(x' || doc_id || ')' AS snippet", [(0,)], "k"))
def syntax_queries(spark, sf_dir):
    own = [r for r in catalog.load() if r["id"] == "py-eval-call"]
    return syntax.findings(_project(spark, sf_dir, _CODE_FILES), own).select("file", F.col("line").cast("long").alias("line"), "snippet")


@query("taint_flows", _project_sql(f"{_IN} file AS file, line::BIGINT AS line", [(0, "a.py", 5), (0, "a.py", 6), (1, "b.py", 4), (2, "c.js", 3), (2, "c.js", 5), (3, "d.go", 3), (4, "E.java", 1)], "k, file, line"))
def taint_flows(spark, sf_dir):
    return taint.findings(_project(spark, sf_dir, _CODE_FILES), _flow_rules()).select("file", F.col("line").cast("long").alias("line"))


# ---- the whole scan, and time ----


@query(
    "scan_rule_counts",
    f"WITH {LINES}, {found('email', 'card', 'license', 'shout')}, n AS (SELECT rule_id, severity, count(*) AS n, count(DISTINCT file) AS n_files FROM findings GROUP BY ALL) SELECT * FROM n",
)
def scan_rule_counts(spark, sf_dir):
    config = scanning.Config(confidence="", min_severity="", everything=True, per_file=1 << 30, per_rule=1 << 30)
    result = scanning.scan(files(spark, sf_dir), rules(("email", "card", "license", "shout")), config)
    return result.findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return watch.windowed(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query(
    "event_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)"
    " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
)
def event_sessions(spark, sf_dir):
    return watch.sessions(table(spark, sf_dir, "events"), "1 hour")


@query("event_latest_versions", "SELECT user_id AS uri, max(ts) AS ts FROM events GROUP BY user_id")
def event_latest_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), "ts", F.col("props").alias("text"))
    return watch.latest_versions(rows).select("uri", "ts")


#: Milliseconds for which a path must be quiet, and how late rows may be, in both forms.
QUIET_MS, LATE = 21_600_000, "1 second"


@query(
    "watch_changes",
    "WITH s AS (SELECT 'user/' || user_id AS path, ts, md5(props) AS hash, event_id, lag(md5(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events),"
    " c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM s WHERE old IS NOT NULL AND hash <> old),"
    " b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM c),"
    " g AS (SELECT path, k, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY path, k)"
    " SELECT path, first, last, n FROM g WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 SECOND OR k < (SELECT max(k) FROM g h WHERE h.path = g.path)",
)
def watch_changes(spark, sf_dir):
    """Users' events as states of files: four parts of three files, the stream stopped halfway and started again."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id").alias("path"), F.col("ts").alias("mtime"), F.md5("props").alias("hash"))
    out = replay.replay(rows, replay.slices(rows, "mtime", 4), 4, lambda stream: state.changes(stream, QUIET_MS, LATE))
    return out.select("path", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


_VERSION = (
    "event_type || chr(10) || props || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'total ' || cast(user_id AS string) ELSE 'the end' END"
    " || CASE WHEN event_id % 40 = 0 THEN repeat(chr(10), 1000) ELSE '' END"
)
_OP = "CASE WHEN event_id % 11 = 0 THEN 'close' WHEN event_id % 7 = 0 THEN 'open' ELSE 'change' END"
#: (id, pattern).
_FEED_RULES = (("seven", '"k": [0-9]*7'), ("total", "^total [0-9]+"), ("error", "^(error|click)$"), ("e", "e$"))


@query(
    "document_feed",
    f"WITH v AS (SELECT 'doc/' || user_id AS uri, ts, event_id, {_OP} AS op, string_split({_VERSION}, chr(10)) AS ls FROM events),"
    " k AS (SELECT uri, ts, event_id, CASE WHEN op = 'close' THEN [] ELSE list_concat("
    + ", ".join(f"list_filter(list_transform(ls, (x, i) -> CASE WHEN regexp_matches(x, {lit(p)}) THEN '{i}:' || i END), x -> x IS NOT NULL)".replace("(x, i) ->", "lambda x, i:").replace("x -> x IS", "lambda x: x IS") for i, p in _FEED_RULES)
    + ") END AS now FROM v WHERE NOT (op = 'change' AND len(ls) >= 1000)),"
    " d AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY uri ORDER BY ts, event_id), []) AS old FROM k)"
    " SELECT uri, ts AS at, 'added' AS what, unnest(list_filter(now, lambda x: NOT list_contains(old, x))) AS finding FROM d"
    " UNION ALL SELECT uri, ts, 'removed', unnest(list_filter(old, lambda x: NOT list_contains(now, x))) FROM d",
)
def document_feed(spark, sf_dir):
    """Users' events as versions of documents: what each version brings and takes away, as a stream that is started twice."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("doc/"), "user_id").alias("uri"), "ts", F.col("event_id").alias("seq"), F.expr(_OP).alias("op"), F.expr(_VERSION).alias("text"))
    patterns = match.plan([catalog.parse({"id": i, "patterns": [{"type": "regex", "pattern": p}]}, k) for k, (i, p) in enumerate(_FEED_RULES)])
    return replay.replay(rows, replay.slices(rows, "ts", 4), 4, lambda stream: state.feed(stream, patterns)).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Events come in five parts: by the day, every ninth a part later. Rows may be a day late, by what was there when the batch before began.
_PART = "least(4, least(3, cast(floor((day(ts) - 1) / 8) AS int)) + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END)"
_PARTS, _LATE = 5, "1 day"
_ARRIVED = f"e AS (SELECT *, {_PART.replace('cast(floor((day(ts) - 1) / 8) AS int)', '(day(ts) - 1) // 8')} AS part FROM events), parts AS (SELECT DISTINCT part FROM e)"


@query(
    "event_join_stream",
    f"WITH {_ARRIVED}, marks AS (SELECT part, date_trunc('milliseconds', least((SELECT max(ts) FROM e WHERE event_type = 'click' AND e.part < p.part - 1), (SELECT max(ts) FROM e WHERE event_type = 'error' AND e.part < p.part - 1))) - INTERVAL 1 DAY AS mark FROM parts p),"
    " told AS (SELECT e.*, coalesce(ts <= mark, false) AS late FROM e JOIN marks USING (part) WHERE event_type IN ('click', 'error'))"
    " SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id, (SELECT count(*) FROM told WHERE late) AS late FROM told a JOIN told b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error'"
    " AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR WHERE NOT a.late AND NOT b.late",
)
def event_join_stream(spark, sf_dir):
    """Two streams joined by user and time; what comes too late is counted apart."""
    late: list[int] = []
    out = replay.replay(table(spark, sf_dir, "events"), F.expr(_PART), _PARTS, lambda stream: watch.joined(stream, "click", "error", "12 hours", _LATE), runs=1, late=late)
    return out.withColumn("late", F.lit(sum(late)).cast("long"))


@query(
    "event_sliding_stream",
    f"WITH {_ARRIVED}, marks AS (SELECT part, date_trunc('milliseconds', (SELECT max(ts) FROM e WHERE e.part < p.part - 1)) - INTERVAL 1 DAY AS mark FROM parts p),"
    " w AS (SELECT e.*, mark, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL (2 * k) HOUR AS start FROM e JOIN marks USING (part), range(0, 3) t(k))"
    " SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE NOT coalesce(start + INTERVAL 6 HOUR <= mark, false)"
    " AND start + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY start, event_type",
)
def event_sliding_stream(spark, sf_dir):
    """Sliding windows of six hours over a stream with late rows: those that the watermark has closed, each once."""
    timed = lambda stream: stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = replay.replay(table(spark, sf_dir, "events"), F.expr(_PART), _PARTS, lambda stream: watch.windowed(timed(stream), "6 hours", "2 hours", _LATE), runs=1)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


#: The files of a second round: some changed, some gone, some new.
_SECOND = (
    f"SELECT {PATH} AS path, CASE WHEN doc_id % 17 = 0 THEN text || ' new@mail9.com ### ' ELSE text END AS content FROM documents WHERE text IS NOT NULL AND doc_id % 23 <> 0"
    f" UNION ALL SELECT {PATH} || '.md', text || ' 1234567890123456' FROM documents WHERE text IS NOT NULL AND doc_id % 29 = 0"
)
_ROUND_TWO = LINES.replace(FILES, f"files AS ({_SECOND})") + ", " + found("email", "card", "shout")


def _two_rounds(spark, sf_dir) -> store.Store:
    """The cache after both rounds; only files of the second that the first hadn't are scanned in it."""
    kept = store.Store(spark, replay.shared_folder(spark), buckets=64)
    picked = rules(("email", "card", "shout"))
    scan = lambda some: match.findings(source.lines(some), picked).select("file", "rule_id", "severity", "line")
    kept.update(files(spark, sf_dir), "r1", scan)
    text = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit(" new@mail9.com ### "))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    second = docs.where("doc_id % 23 <> 0").select(F.expr(PATH).alias("path"), text.alias("content"))
    second = second.unionByName(docs.where("doc_id % 29 = 0").select(F.concat(F.expr(PATH), F.lit(".md")).alias("path"), F.concat("text", F.lit(" 1234567890123456")).alias("content")))
    kept.update(second, "r1", scan)
    return kept


@query("cache_store", f"WITH {_ROUND_TWO} SELECT file, rule_id, severity, line::INTEGER AS line FROM findings")
def cache_store(spark, sf_dir):
    """Findings out of a store that two rounds of files have gone through."""
    return _two_rounds(spark, sf_dir).findings()


@query(
    "cache_counts",
    f"WITH {_ROUND_TWO}, c AS (SELECT rule_id, severity, file, count(*) AS n FROM findings GROUP BY ALL) SELECT rule_id, severity, sum(n)::BIGINT AS total, max(n) AS most FROM c GROUP BY ALL",
)
def cache_counts(spark, sf_dir):
    """What noise limits ask of all findings, from the view that both rounds have corrected."""
    return _two_rounds(spark, sf_dir).noise()


_SPANS = f"spans AS (SELECT {PATH} AS path, 1 + k * (doc_id % 7) AS a, 1 + k * (doc_id % 7) + (doc_id % 11) * (doc_id % 5) AS b, doc_id % 3 = 0 AS every FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k) t)"


@query(
    "range_findings",
    f"WITH {FOUND}, {_SPANS} SELECT rule_id, file, line::BIGINT AS line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = f.file AND f.line BETWEEN s.a AND s.b AND (every OR rule_id = 'email'))",
)
def range_findings(spark, sf_dir):
    """Findings outside of four overlapping ranges of lines for each file, of which some take in one rule alone."""
    spans = table(spark, sf_dir, "documents").select(F.expr(PATH).alias("_path"), "doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("_k"))
    start = F.expr("1 + _k * (doc_id % 7)")
    spans = spans.select("_path", start.alias("_a"), (start + F.expr("(doc_id % 11) * (doc_id % 5)")).alias("_b"), F.expr("doc_id % 3 = 0").alias("_every"))
    out = ranges.split(findings(spark, sf_dir), spans, ("file", "_path"), "line", "_a", "_b", ["rule_id"], F.col("_every") | (F.col("rule_id") == "email"), "left_anti")
    return out.select("rule_id", "file", F.col("line").cast("long").alias("line"))


#: A document as a pinned package: one of three ecosystems, a quarter of all rows one package, versions with every kind of stage. `{m}` is the major number.
_STAGE = "doc_id % 5"
_VERSION_OF = (
    "cast({m} AS string) || '.' || cast(coalesce(length(text), 0) % 12 AS string) || CASE WHEN doc_id % 2 = 0 THEN '.' || cast(doc_id % 11 AS string) ELSE '' END"
    f" || CASE WHEN doc_id % 3 = 0 THEN CASE {_STAGE} WHEN 1 THEN 'a' WHEN 2 THEN '.beta' WHEN 3 THEN '-rc' ELSE '' END || CASE WHEN {_STAGE} IN (1, 2, 3) THEN cast(doc_id % 13 AS string) ELSE '' END"
    f" ELSE CASE {_STAGE} WHEN 1 THEN '-alpha.' || cast(doc_id % 13 AS string) WHEN 2 THEN '-beta.' || cast(doc_id % 13 AS string) WHEN 3 THEN '-rc.' || cast(doc_id % 13 AS string) ELSE '' END END"
)
_MAJOR = "cast(floor(doc_id / 100) AS int)"
_NEXT = f"({_MAJOR} + 1)"
_PACKAGE = "CASE WHEN doc_id % 4 = 0 THEN 'a.io/hot' ELSE 'a.io/p' || cast(cast(floor(doc_id / 60) AS int) AS string) END"
_PINNED = {
    "path": "'d' || cast(doc_id AS string) || CASE doc_id % 3 WHEN 0 THEN '/requirements.txt' WHEN 1 THEN '/package.json' ELSE '/go.mod' END",
    "content": "CASE doc_id % 3 WHEN 0 THEN replace({p}, 'a.io/', '') || '==' || {v} WHEN 1 THEN '{{\"dependencies\": {{\"' || {p} || '\": \"^' || {v} || '\"}}}}' ELSE 'require ' || {p} || ' v' || {v} END",
}
_ADVISED = {
    "ecosystem": "CASE doc_id % 3 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' ELSE 'go' END", "package": f"CASE WHEN doc_id % 3 = 0 THEN replace({_PACKAGE}, 'a.io/', '') ELSE {_PACKAGE} END", "id": "'A' || cast(doc_id AS string)",
    "introduced": f"CASE WHEN doc_id % 21 <> 0 OR doc_id % 4 = 0 THEN {_VERSION_OF.format(m=_MAJOR)} END", "fixed_version": f"CASE WHEN doc_id % 35 <> 0 OR doc_id % 4 = 0 THEN {_VERSION_OF.format(m=_NEXT)} END",
}
# What the text of a version stands for, as a number that compares as versions do.
_ORDER_OF = f"((({{m}} * 12 + coalesce(length(text), 0) % 12) * 11 + CASE WHEN doc_id % 2 = 0 THEN doc_id % 11 ELSE 0 END) * 4 + CASE WHEN {_STAGE} IN (1, 2, 3) THEN {_STAGE} - 1 ELSE 3 END) * 13 + CASE WHEN {_STAGE} IN (1, 2, 3) THEN doc_id % 13 ELSE 0 END"


@query(
    "advisory_hits",
    f"WITH p AS (SELECT {_PINNED['path']} AS path, {_ADVISED['ecosystem']} AS ecosystem, {_ADVISED['package']} AS package, {_VERSION_OF.format(m=_MAJOR)} AS version, {_ORDER_OF.format(m=_MAJOR)} AS spot FROM documents),"
    f" a AS (SELECT {_ADVISED['ecosystem']} AS ecosystem, {_ADVISED['package']} AS package, {_ADVISED['id']} AS id, {_ADVISED['fixed_version']} AS fixed_version, CASE WHEN doc_id % 21 <> 0 OR doc_id % 4 = 0 THEN {_ORDER_OF.format(m=_MAJOR)} END AS low,"
    f" CASE WHEN doc_id % 35 <> 0 OR doc_id % 4 = 0 THEN {_ORDER_OF.format(m=_NEXT)} END AS high FROM documents WHERE doc_id % 7 = 0)"
    " SELECT id, package, version, fixed_version, path FROM p JOIN a USING (ecosystem, package) WHERE (low IS NULL OR spot >= low) AND (high IS NULL OR spot < high)",
)
def advisory_hits(spark, sf_dir):
    """Packages pinned in manifests with the advisories whose range of versions holds theirs."""
    docs = table(spark, sf_dir, "documents")
    content = _PINNED["content"].format(p=_PACKAGE, v=_VERSION_OF.format(m=_MAJOR))
    pinned = dependencies.packages(docs.select(F.expr(_PINNED["path"]).alias("path"), F.expr(content).alias("content")))
    advised = docs.where("doc_id % 7 = 0").select(*[F.expr(e).alias(c) for c, e in _ADVISED.items()], F.lit("s").alias("summary"), F.lit("high").alias("severity"), F.array(F.lit("r")).alias("references"))
    return dependencies.vulnerable(pinned, advised).select("id", "package", "version", "fixed_version", "path")


_LANGUAGE = "CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.js' THEN 'javascript' WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.java' THEN 'java' ELSE '' END"
_CUBE = (
    f"WITH {FOUND}, d AS (SELECT *, {_LANGUAGE} AS language, string_split(file, '/')[1] AS source FROM findings),"
    " c AS (SELECT severity, category, language, source, GROUPING(severity, category, language, source)::INTEGER AS level, count(*) AS n, count(DISTINCT file) AS files, min(line)::BIGINT AS first_line, max(line)::BIGINT AS last_line"
    " FROM d GROUP BY CUBE (severity, category, language, source)) SELECT {columns} FROM c"
)


@query("findings_cube", _CUBE.replace("{columns}", "severity, category, language, source, level, n, files"))
def findings_cube(spark, sf_dir):
    return cubes.exact(cubes.dimensioned(findings(spark, sf_dir)))


@query("findings_sketches", _CUBE.replace("{columns}", "severity, category, language, source, level, n, first_line, last_line, true AS files_near, true AS lines_near"))
def findings_sketches(spark, sf_dir):
    """The cube out of the stored cells of two scans, each of a part of the files; estimates are held against exact values."""
    found = cubes.dimensioned(findings(spark, sf_dir))
    at, part = replay.shared_folder(spark), F.pmod(F.xxhash64("file"), F.lit(2)) == 0
    for n, some in enumerate((found.where(part), found.where(~part))):
        cubes.cells(some).write.parquet(f"{at}/cells{n}")
    rolled = cubes.rank_errors(cubes.rolled(*[spark.read.parquet(f"{at}/cells{n}") for n in range(2)]), found)
    true = cubes.exact(found).select(F.col("level").alias("_level"), F.col("files").alias("_files"), *[F.col(d).alias(f"_{d}") for d in cubes.DIMENSIONS])
    both = rolled.join(true, [F.col("level") == F.col("_level"), *[F.col(d).eqNullSafe(F.col(f"_{d}")) for d in cubes.DIMENSIONS]])
    near = F.abs(F.col("files") - F.col("_files")) <= F.greatest(F.lit(1.0), 4 * cubes.standard_error() * F.col("_files"))
    ranked = F.greatest("rank_error_50", "rank_error_90") <= 2 * cubes.RANK_ERROR
    return both.select(*cubes.DIMENSIONS, "level", "n", "first_line", "last_line", near.alias("files_near"), ranked.alias("lines_near"))


@query("report_sink", f"WITH {FOUND}, k AS (SELECT unnest(['sarif', 'gitlab', 'json']) AS kind) SELECT kind, rule_id, file, line::BIGINT AS line, message, count(*) AS n FROM findings, k GROUP BY ALL")
def report_sink(spark, sf_dir):
    """Three reports of all findings written as documents, and their items read back from them."""
    at = replay.shared_folder(spark).removeprefix("file:")
    os.makedirs(at)
    # Lines are searched once: the reports, their heads and the sort's sample read the findings from the shared folder.
    found = findings(spark, sf_dir)
    found.write.parquet(f"{at}/findings")
    found = spark.read.schema(found.schema).parquet(f"{at}/findings")
    item = F.from_json(F.regexp_replace("value", ",$", ""), "ruleId string, message string, locations string, name string, location struct<file string, start_line long>, identifiers array<struct<name string>>, rule_id string, file string, line long")
    place = F.from_json("i.locations", "array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine long>>>>")[0]["physicalLocation"]
    kinds = {
        "sarif": (F.col("i.ruleId"), place["artifactLocation"]["uri"], place["region"]["startLine"], F.get_json_object("i.message", "$.text")),
        "gitlab": (F.col("i.identifiers")[0]["name"], F.col("i.location.file"), F.col("i.location.start_line"), F.col("i.message")),
        "json": (F.col("i.rule_id"), F.col("i.file"), F.col("i.line"), F.col("i.message")),
    }
    out = None
    for kind, columns in kinds.items():
        reports.write_report(found, kind, f"{at}/report.{kind}")
        # An item is a line; the first and the last are head and tail.
        rows = spark.read.text(f"{at}/report.{kind}").where(~F.col("value").rlike(r'^(\]|\{"(\$schema|version|summary)")')).select(item.alias("i"))
        rows = rows.select(F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(columns, ("rule_id", "file", "line", "message"))])
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind", "rule_id", "file", "line", "message").agg(F.count("*").alias("n"))


_PAGE_PATH = "CASE page_id % 6 WHEN 0 THEN 'site/node_modules/' WHEN 1 THEN 'site/a/b/' WHEN 2 THEN 'own/' ELSE 'site/' || cast(page_id % 40 AS string) || '/' END || 'p' || cast(page_id AS string) || CASE page_id % 4 WHEN 0 THEN '.min.js' WHEN 1 THEN '.JS' ELSE '.html' END"


def _written(batches):
    """Files of (path, content), written where the path says."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(content)
        yield pdf[["path"]]


@query("source_tree", f"WITH f AS (SELECT {_PAGE_PATH} AS path, encode(html) AS content FROM pages WHERE html IS NOT NULL) SELECT path, octet_length(content) AS size, md5(content) AS digest FROM f WHERE path LIKE 'site/%' AND path NOT LIKE '%/node_modules/%' AND path LIKE '%.html' AND octet_length(content) > 2000")
def source_tree(spark, sf_dir):
    """Pages written as files and read by the walk; folder, ending and size are asked of the source, which opens nothing else."""
    at = replay.shared_folder(spark).removeprefix("file:")
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.concat(F.lit(at + "/"), F.expr(_PAGE_PATH)).alias("path"), F.col("html").cast("binary").alias("content"))
    pages.mapInPandas(_written, "path string").count()
    found = walk.tree(spark, at).where((F.col("extension") == ".html") & F.col("path").startswith(at + "/site/") & (F.col("size") > 2000))
    return found.select(F.substring("path", len(at) + 2, 1 << 20).alias("path"), "size", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    "secret_findings",
    f"WITH {_SECRET_LINES}, s AS ({_secret_sql()}), v AS (SELECT *, CASE WHEN v IS NOT NULL AND v <> '' THEN v ELSE whole END AS m FROM s),"
    f" q AS (SELECT path, line_no, text, unnest(regexp_extract_all(text, {lit(secrets.QUOTED)}, 1)) AS m FROM lines), e AS (SELECT *, {_ENTROPY} AS entropy FROM q),"
    f" u AS (SELECT path, line_no, text, type, severity, whole AS hit FROM v WHERE NOT ({_DUMMY}) UNION ALL SELECT path, line_no, text, 'entropy', 'medium', m FROM e"
    f" WHERE length(m) BETWEEN 16 AND 128 AND entropy >= 4.2 AND NOT ({_DUMMY}) AND NOT ({' OR '.join('regexp_matches(m, ' + lit(p) + ')' for *_, p in secrets.SECRETS)}))"
    " SELECT 'secret-' || type AS rule_id, severity, path AS file, line_no::BIGINT AS line, (strlen(substring(text, 1, instr(text, hit) - 1)) + 1)::BIGINT AS col FROM u WHERE regexp_matches(path, '\\.(py|js|java|go)$')",
)
def secret_findings(spark, sf_dir):
    """Both kinds of secrets as findings, of the files that are searched for them."""
    rows = _secret_lines(spark, sf_dir)
    out = secrets.as_findings(secrets.detect(rows.where(secrets.takes(F.col("path")))))
    return out.select("rule_id", "severity", "file", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"))


_LAST = "regexp_extract(acc, '[^\n]*$')"


@query(
    "text_wrapping",
    f"WITH {FOUND}, w AS (SELECT rule_id, file, line, trim(snippet) AS t, list_filter(regexp_split_to_array(snippet, '\\s+'), x -> x <> '') AS words FROM findings)"
    f" SELECT rule_id, file, line::BIGINT AS line, md5(CASE WHEN strlen(t) <= 70 THEN t ELSE list_reduce(words, lambda acc, x: acc || CASE WHEN strlen({_LAST}) - CASE WHEN contains(acc, chr(10)) THEN 2 ELSE 0 END + strlen(x) + 1 > 70 THEN chr(10) || '  ' ELSE ' ' END || x) END) AS digest FROM w",
)
def text_wrapping(spark, sf_dir):
    """Snippets of findings in lines of 70 bytes."""
    return findings(spark, sf_dir).select("rule_id", "file", F.col("line").cast("long").alias("line"), F.md5(fn.wrapped(F.trim("snippet")).cast("binary")).alias("digest"))
