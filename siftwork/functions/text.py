"""Scalar expressions over text: ranks, entropy, hashes, snippets, languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of severities and of confidence levels; anything else ranks 0.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether `text` contains one of `words`."""
    return any_of([text.contains(w) for w in words])


def rank(c: Column | str, ranks: dict[str, int]) -> Column:
    c = column(c)
    out = F.lit(0)
    for name, value in ranks.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def severity_rank(c: Column | str) -> Column:
    return rank(c, SEVERITY_RANK)


def confidence_rank(c: Column | str) -> Column:
    return rank(c, CONFIDENCE_RANK)


def entropy(c: Column | str) -> Column:
    """Shannon entropy in bits: counts of characters over the length in bytes."""
    c = column(c)
    chars = F.split(c, "")
    size = F.octet_length(c).cast("double")

    def add(total: Column, ch: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == ch)) / size
        return total - p * F.log2(p)

    distinct = F.array_sort(F.array_distinct(chars))
    return F.when(F.length(c) > 0, F.round(F.aggregate(distinct, F.lit(0.0), add), 12)).otherwise(F.lit(0.0))


def snippet_hash(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(column(c), 256), 1, 16))


def byte_column(text: Column, position: Column) -> Column:
    """1-based byte column of a 1-based character position."""
    return F.octet_length(F.substring(text, F.lit(1), position - 1)) + 1


def window(text: Column, start: Column, end: Column, most: int = 120, margin: int = 40) -> Column:
    """`text`, or for long lines what stands around the 0-based characters [start, end), cuts marked by dots."""
    a, b = F.greatest(start - margin, F.lit(0)), F.least(end + margin, F.length(text))
    cut = F.concat(F.when(a > 0, "...").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "...").otherwise(""))
    return F.when(F.octet_length(text) > most, cut).otherwise(text)


def truncate(c: Column | str, most: int) -> Column:
    c = column(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def wrapped(c: Column | str, width: int = 70, indent: str = "  ") -> Column:
    """Words filled into lines of at most `width` bytes, all but the first behind `indent`; a text that fits stays as it is, a longer word has a line."""
    c = column(c)
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    filled = F.aggregate(words, F.array().cast("array<string>"), lambda lines, w: F.when(
        (F.size(lines) == 0) | (F.octet_length(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))) + F.octet_length(w) + 1 > width), F.concat(lines, F.array(w)),
    ).otherwise(F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", F.try_element_at(lines, F.lit(-1)), w)))))
    return F.when(F.octet_length(c) > width, F.array_join(filled, "\n" + indent)).otherwise(c)


def first_lines(c: Column | str, n: int = 3) -> Column:
    """The first `n` lines, and dots if there are more."""
    lines = F.split(column(c), "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n..."))).otherwise(column(c))


# Languages by extension. The first eleven are those that a plain scan reaches, the rest extends them.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyw": "python",
    ".go": "go",
    ".php": "php", ".phtml": "php",
    ".rs": "rust",
    ".java": "java",
    ".kt": "kotlin",
    ".rb": "ruby",
    ".swift": "swift",
    ".cs": "csharp",
}
MORE_LANGUAGES = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".lua": "lua",
    ".sol": "solidity", ".sh": "bash", ".bash": "bash", ".yaml": "yaml", ".yml": "yaml", ".tf": "terraform", ".scala": "scala", ".html": "html", ".txt": "text",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case, with its point; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column, full: bool = True) -> Column:
    known = LANGUAGES | (MORE_LANGUAGES if full else {})
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    out = F.coalesce(F.try_element_at(pairs, extension(path)), F.lit(""))
    return F.when((F.lower(basename(path)) == "dockerfile") & F.lit(full), "dockerfile").otherwise(out)


def language_of_code(code: Column) -> Column:
    """Language of a snippet by the first keyword test that holds; empty if none does."""
    has = code.contains
    return (
        F.when(has("func ") & has("package "), "go")
        .when(has("def ") & (has(":") | has("import ")), "python")
        .when(has("function ") | has("const ") | has("let "), "javascript")
        .when(has("public class ") | has("import java."), "java")
        .when(has("<?php"), "php")
        .when(has("fn ") & has("->"), "rust")
        .when(has("class ") & has("end"), "ruby")
        .when(has("class ") & has("{") & has("public "), "csharp")
        .when(has("func ") & has("->") & ~has("package "), "swift")
        .when(has("fun ") | has("val ") | has("var "), "kotlin")
        .otherwise("")
    )


def is_constant(snippet: Column) -> Column:
    """Whether a snippet is a quoted string, a template without interpolation, or digits."""
    s = F.trim(snippet)
    quoted = any_of([s.startswith(q) & s.endswith(q) for q in ('"', "'")])
    template = s.startswith("`") & s.endswith("`")
    return F.when(quoted, True).when(template, ~s.contains("${")).otherwise(s.rlike(r"^[0-9]+$"))


def fill(template: Column, variables: Column) -> Column:
    """Put the values of the map `variables` for `${name}` and `$name`; longer names first."""
    names = F.array_sort(F.map_keys(variables), lambda a, b: F.length(b) - F.length(a))

    def one(text: Column, name: Column) -> Column:
        value = F.element_at(variables, name)
        return F.replace(F.replace(text, F.concat(F.lit("${"), name, F.lit("}")), value), F.concat(F.lit("$"), name), value)

    return F.when(F.size(names) > 0, F.aggregate(names, template, one)).otherwise(template)
