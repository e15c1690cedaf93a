"""Scores of findings from their snippet and the lines around: confidence, false positives, exploitability, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import any_of, has_any
from .match import span

#: Lines before and after a finding that scores look at, at most.
REACH = 10
# Points of pattern types, sinks' sensitivity by category, words of validated scopes.
TYPE_POINTS = {"taint": 0.45, "ast-query": 0.3, "ast": 0.3, "regex": 0.1, "literal": 0.0}
SENSITIVITY = {"cmdi": 0.9, "ssrf": 0.8, "pathtraversal": 0.7, "crypto": 0.6}
VALIDATED = ("validated", "sanitized", "escaped", "encoded", "purified", "DOMPurify", "htmlspecialchars", "encodeURIComponent", "validator", "joi\\.", "yup\\.", "zod\\.")
# What the false-positive score looks for.
COMMON = {
    "secrets": ("test_key", "example_key", "dummy_key", "fake_key", "YOUR_KEY_HERE", "INSERT_KEY_HERE", "xxx", "\\*\\*\\*", "password123", "admin123", "test123", "changeme"),
    "sqli": ("// test query", "SELECT 1", "SELECT count\\(\\*\\)", "DESCRIBE ", "EXPLAIN ", "SHOW TABLES", "DROP TABLE IF EXISTS", "CREATE TABLE IF NOT EXISTS"),
    "xss": ("// intentionally", "// demonstration", "// example", "document.createTextNode", "textContent", "innerText", "// This is safe because"),
    "crypto": ("// legacy support", "// backward compatibility", "// For testing only", "// TODO.*crypto"),
}
SAFE_NAMES = ("sanitized_", "safe_", "escaped_", "encoded_", "clean_", "validated_", "filtered_", "trusted_", "whitelist_")
SAFE_VALUES = (
    "example.com", "localhost", "127.0.0.1", "0.0.0.0", "test@example.com", "admin@example.com", "/dev/null", "/tmp/test", "/tmp/",
    "password123", "admin", "test", "123456", "changeme", "public", "readonly", "static",
)
CHECKS = ("validate", "sanitize", "escape", "encode", "check", "verify", "guard", "assert")
SANITIZERS = ("sanitize", "escape", "encode", "purify", "clean", "strip", "validate", "verify")
TEST_PATHS = ("_test.", "_spec.", "/test/", "/tests/", "/spec/", "test_")
WEIGHTS = {"test": 0.30, "names": 0.15, "validation": 0.15, "common": 0.20, "documentation": 0.10, "value": 0.10, "sanitizer": 0.10}
# categories' exploitability: score, attack vector, complexity, privileges, user interaction, scope.
EXPLOITABILITY = {
    "sqli": (0.95, "Network", "Low", "None", "None", "Changed"),
    "sql-injection": (0.95, "Network", "Low", "None", "None", "Changed"),
    "xss": (0.85, "Network", "Low", "None", "Required", "Unchanged"),
    "cmdi": (0.98, "Network", "Low", "None", "None", "Changed"),
    "command-injection": (0.98, "Network", "Low", "None", "None", "Changed"),
    "ssrf": (0.80, "Network", "Medium", "None", "None", "Changed"),
    "pathtraversal": (0.75, "Network", "Low", "None", "None", "Unchanged"),
    "path-traversal": (0.75, "Network", "Low", "None", "None", "Unchanged"),
    "secrets": (0.70, "Network", "Medium", "None", "None", "Unchanged"),
    "hardcoded-secrets": (0.70, "Network", "Medium", "None", "None", "Unchanged"),
    "crypto": (0.60, "Network", "High", "None", "None", "Unchanged"),
    "weak-crypto": (0.60, "Network", "High", "None", "None", "Unchanged"),
    "deserialization": (0.92, "Network", "Medium", "None", "None", "Changed"),
    "idor": (0.70, "Network", "Low", "Low", "None", "Unchanged"),
    "jwt": (0.75, "Network", "Medium", "None", "None", "Changed"),
    "jwt-weak": (0.75, "Network", "Medium", "None", "None", "Changed"),
}
OTHER = (0.50, "Network", "Medium", "None", "None", "Unchanged")
CVSS = {
    "vector": {"Network": 0.85, "Adjacent": 0.62, "Local": 0.55, "Physical": 0.2},
    "complexity": {"Low": 0.77, "Medium": 0.44, "High": 0.44},
    "privileges": {"None": 0.85, "Low": 0.62, "High": 0.27},
    "interaction": {"None": 0.85, "Required": 0.62},
}
# Input validation by language.
VALIDATORS = {
    "javascript": (
        r"typeof\s+\w+\s*===?\s*['\"]string['\"]", r"typeof\s+\w+\s*===?\s*['\"]number['\"]", r"typeof\s+\w+\s*===?\s*['\"]boolean['\"]", r"Array\.isArray\s*\(",
        r"Number\.isFinite\s*\(", r"Number\.isInteger\s*\(", r"joi\.", r"yup\.", r"zod\.", r"validator\.", r"express-validator", r"celebrate\s*\(", r"Joi\.",
        r"\.match\s*\([^)]+\)", r"\.test\s*\(", r"RegExp\s*\(", r"\.length\s*[<>=!]", r"\.includes\s*\(",
    ),
    "python": (
        r"isinstance\s*\(", r"type\s*\(\s*\w+\s*\)\s*is", r"pydantic", r"marshmallow", r"cerberus", r"voluptuous", r"wtforms", r"django\.forms",
        r"rest_framework\.serializers", r"re\.match\s*\(", r"re\.search\s*\(", r"re\.fullmatch\s*\(", r"str\.isalnum", r"str\.isalpha", r"str\.isdigit",
        r"\.startswith\s*\(", r"\.endswith\s*\(", r"len\s*\([^)]+\)\s*[<>=!]",
    ),
    "go": (
        r"\.\([*\w]+\)", r"reflect\.TypeOf", r"go-playground/validator", r"ozzo-validation", r"govalidator", r"regexp\.Match", r"strings\.HasPrefix",
        r"strings\.Contains", r"strconv\.", r"len\s*\([^)]+\)\s*[<>=!]",
    ),
    "java": (
        r"@NotNull", r"@NotEmpty", r"@NotBlank", r"@Valid", r"@Pattern", r"@Size", r"@Min", r"@Max", r"@Email", r"@Positive", r"Validator\.", r"ValidationUtils",
        r"Pattern\.compile\s*\(", r"String\.matches\s*\(", r"instanceof\s+\w+",
    ),
    "php": (
        r"is_string\s*\(", r"is_int\s*\(", r"is_array\s*\(", r"is_numeric\s*\(", r"filter_var\s*\(", r"FILTER_VALIDATE_", r"Validator::", r"Form::",
        r"Request::validate", r"preg_match\s*\(", r"preg_match_all\s*\(", r"validate\s*\(\s*\[", r"Validator::make",
    ),
    "ruby": (r"\.is_a\?", r"\.kind_of\?", r"\.instance_of\?", r"validates_", r"ActiveModel::Validations", r"\.match\?\s*\(", r"=~", r"Regexp\.new"),
    "csharp": (
        r"\[Required\]", r"\[StringLength\]", r"\[Range\]", r"\[RegularExpression\]", r"\[EmailAddress\]", r"\[MinLength\]", r"\[MaxLength\]", r"RuleFor\s*\(",
        r"FluentValidation", r"Regex\.", r"Regex\.IsMatch",
    ),
    "rust": (r"\.parse\s*::<", r"TryFrom", r"FromStr", r"match\s+\w+\s*\{", r"validator::", r"garde::", r"validate\s*\(", r"Regex::new\s*\(", r"regex::"),
    "kotlin": (r"@NotNull", r"@Nullable", r"require\s*\(", r"check\s*\(", r"requireNotNull", r"checkNotNull", r"@Valid"),
    "swift": (r"guard\s+let", r"if\s+let", r"as\?\s+", r"is\s+\w+", r"guard\s+\w+\s*!=\s*nil", r"try\?"),
}


def _guards(x: Column) -> Column:
    """How many kinds of guards a line holds."""
    has = x.contains
    tests = (has("if ") & has("!= nil"), has("if ") & (has("err ") | has("error")), has("validate") | has("Validate"), has("check") | has("Check"), has("guard") | has("Guard"))
    total = F.lit(0)
    for t in tests:
        total = total + t.cast("int")
    return total


def confidence_mark(x: Column) -> Column:
    """What `confidence` asks of a line; made once for each line, its windows add marks up."""
    return F.struct(_guards(x).alias("guards"), has_any(F.lower(x), tuple(p.replace("\\", "") for p in VALIDATED)).alias("valid"))


def false_positive_mark(x: Column) -> Column:
    """What `false_positive` asks of a line."""
    low, own = F.lower(x), F.trim(x)
    comment = any_of([own.startswith(p) for p in ("//", "/*", "*", "#", '"""', "'")])
    return F.struct(has_any(low, CHECKS).alias("check"), has_any(low, SANITIZERS).alias("sanitizer"), comment.alias("comment"))


def _marks(findings: DataFrame, mark: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Marks from one place of `lines` to another, of lines that are marked already or not."""
    lines = F.col("lines")
    if isinstance(findings.schema["lines"].dataType.elementType, StringType):
        return lambda a, b: F.transform(span(lines, a, b), mark)

    def marked(first: Column, last: Column) -> Column:
        a, b = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
        return F.slice(lines, a, F.greatest(b - a + 1, F.lit(0)))

    return marked


def sensitivity(category: Column, snippet: Column) -> Column:
    out = F.when(category == "sqli", F.when(has_any(snippet, ("+", "${")), 1.0).otherwise(0.8))
    out = out.when(category == "xss", F.when(has_any(snippet, ("innerHTML", "dangerouslySetInnerHTML")), 1.0).otherwise(0.7))
    for name, value in SENSITIVITY.items():
        out = out.when(category == name, value)
    return out.otherwise(0.5)


def within(line: Column, lines: Column) -> Column:
    return (line >= 1) & (line <= F.size(lines))


def place(findings: DataFrame) -> Column:
    """The place of a finding's line in its `lines`: `at` where they are a part of the file (REACH around), else its number."""
    return F.col("at" if "at" in findings.columns else "line")


def confidence(findings: DataFrame) -> DataFrame:
    """Findings (with `lines` and pattern_type) with confidence_score."""
    line, lines = place(findings), F.col("lines")
    points = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_POINTS.items() for x in kv]), F.col("pattern_type")), F.lit(0.0))
    marks = _marks(findings, confidence_mark)
    # Guards over the ten lines before, the line and the nine after, over 20; validated scopes over the five before and the line.
    depth = F.when(within(line, lines), F.aggregate(marks(line - 10, line + 9), F.lit(0), lambda a, x: a + x["guards"]) / 20.0).otherwise(0.0)
    valid = F.when(within(line, lines) & F.exists(marks(line - 5, line), lambda x: x["valid"]), 0.2).otherwise(0.0)
    tested = F.when(has_any(F.col("file"), ("_test.", "_spec.")), 0.15).otherwise(0.0)
    score = F.lit(0.5) + points + depth * 0.1 + sensitivity(F.col("category"), F.col("snippet")) * 0.15 - valid - tested
    return findings.withColumn("confidence_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def _first(marks: Column, a: Column, name: str) -> Column:
    """Number of the first line of `marks`, which begin at `a`, that has the mark `name`, or null."""
    at = F.array_position(F.transform(marks, lambda x: x[name]), True)
    return F.when(at > 0, F.greatest(a, F.lit(1)) + at - 1)


def false_positive(findings: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Findings (with `lines`) with fp_score, its seven parts, and suppress.

    A sanitizer after the finding counts for more than 1, unknown categories use the list of secrets, and parts of the
    lists in upper case never meet the lower-cased snippet: scores are comparable to those known from elsewhere.
    """
    line, lines = place(findings), F.col("lines")
    path, low = F.lower("file"), F.lower("snippet")
    listed = F.lit(False)
    for name in reversed(COMMON):
        hit = any_of([low.contains(p) | low.rlike(p) for p in COMMON[name]])
        listed = F.when(F.col("category") == name, hit).otherwise(listed) if name != "secrets" else listed
    secrets = any_of([low.contains(p) | low.rlike(p) for p in COMMON["secrets"]])
    listed = F.when(F.col("category").isin("sqli", "xss", "crypto"), listed).otherwise(secrets)
    marks = _marks(findings, false_positive_mark)
    first = lambda a, b, name: _first(marks(a, b), a, name)
    ok = within(line, lines)
    parts = {
        "test": F.when(has_any(path, TEST_PATHS), 1.0).when(low.contains("test") & low.contains("only"), 0.5).otherwise(0.0),
        "names": F.when(has_any(low, SAFE_NAMES), 1.0).otherwise(0.0),
        "validation": F.when(ok, F.coalesce((6 - (line - first(line - 5, line, "check"))) / 6.0, F.lit(0.0))).otherwise(0.0),
        "common": F.when(listed, 1.0).otherwise(0.0),
        "documentation": F.when(ok & F.get(marks(line, line), F.lit(0))["comment"], 1.0).otherwise(0.0),
        "value": F.when(has_any(low, SAFE_VALUES), 1.0).otherwise(0.0),
        "sanitizer": F.when(ok, F.coalesce((6 - (line - first(line - 5, line + 5, "sanitizer"))) / 6.0, F.lit(0.0))).otherwise(0.0),
    }
    out = findings.withColumns({f"fp_{k}": v for k, v in parts.items()})
    score = F.lit(0.0)
    for k, w in WEIGHTS.items():
        score = score + F.col(f"fp_{k}") * w
    return out.withColumn("fp_score", score).withColumn("suppress", F.col("fp_score") > threshold)


def exploitability(findings: DataFrame) -> DataFrame:
    """Findings with exploit_score, cvss and exploit_severity, by a lookup of their category."""
    rows = [(k, *v) for k, v in EXPLOITABILITY.items()]
    known = findings.sparkSession.createDataFrame(rows, "_c string, s double, v string, x string, p string, u string, scope string")
    out = findings.join(F.broadcast(known), F.lower("category") == F.col("_c"), "left")
    for name, value in zip(("s", "v", "x", "p", "u", "scope"), OTHER):
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    factor = lambda table, c: F.element_at(F.create_map(*[F.lit(y) for kv in CVSS[table].items() for y in kv]), F.col(c))
    cvss = F.least(factor("vector", "v") * factor("complexity", "x") * factor("privileges", "p") * factor("interaction", "u") * 10.0, F.lit(10.0))
    level = F.when(F.col("s") >= 0.9, "Critical").when(F.col("s") >= 0.7, "High").when(F.col("s") >= 0.4, "Medium").otherwise("Low")
    return out.withColumns({"exploit_score": F.col("s"), "cvss": cvss, "exploit_severity": level}).drop("_c", "s", "v", "x", "p", "u", "scope")


def validation(text: Column, language: Column) -> Column:
    """Whether a line validates input in the manner of its language; false for others."""
    out = F.lit(False)
    for name, patterns in VALIDATORS.items():
        out = F.when(language == name, text.rlike("|".join(f"(?:{p})" for p in patterns))).otherwise(out)
    return out


def validated(lines: DataFrame, reach: int = 10) -> DataFrame:
    """Lines with is_validated: a validating line is this one or up to ten before."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-reach, 0)
    return lines.withColumn("is_validated", F.max(validation(F.col("text"), F.col("language"))).over(w))


def validation_strength(lines: DataFrame) -> DataFrame:
    """path, strength: share of validating lines over 0.3, 1 at most; partial sums before the shuffle."""
    ratio = F.sum(validation(F.col("text"), F.col("language")).cast("int")) / F.count("*")
    return lines.groupBy("path").agg(ratio.alias("r")).select("path", F.when(F.col("r") > 0.3, 1.0).otherwise(F.col("r") / 0.3).alias("strength"))
