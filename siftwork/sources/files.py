"""Files and lines as relations, and the predicates that select files."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regexes import glob
from ..functions.text import any_of, basename, extension, has_any, language_of

# Names and path segments that a scan leaves out, extensions and bare names that it takes.
EXCLUDED_NAMES = (
    "*_test.go", "*_test.py", "*_test.js", "*_test.ts", "*_test.jsx", "*_test.tsx",
    "test_*.py", "tests.py", "conftest.py", "test_main*", "*_spec.*",
    "*.min.js", "*.min.css", "*.bundle.js", "*.map",
)
EXCLUDED_SEGMENTS = (
    "__tests__", "tests", "test", "spec", "specs",
    "mocks", "fixtures", "e2e", "cypress", "playwright",
    "storybook", "benchmarks",
    "examples", "demos", "samples",
    "docs", "documentation",
    "node_modules", "vendor", "vendors", "dist", "build", ".git",
    "output", "coverage",
    ".vscode", ".idea", ".vs",
    "libs", "lib", "third_party", "3rdparty", "external", "assets",
)
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".pyw", ".go", ".php", ".phtml", ".rs", ".java", ".kt", ".rb", ".swift", ".cs")
BARE_NAMES = ("dockerfile", "makefile", "nginx.conf", ".env")
SECRET_EXTENSIONS = (".js", ".ts", ".go", ".py", ".php", ".rb", ".java", ".env", ".yaml", ".yml", ".json")
# What makes a path look like a test's, for the matching phase and for the not-test-file predicate.
TEST_LIKE = (
    "_test.", "_spec.", "_mock.", "_stub.", "_fixture.",
    ".test.", ".spec.", ".mock.", ".stub.",
    "test_", "tests_", "spec_", "mock_", "stub_",
    "conftest.py", "tests.py", "test_main",
    "/test/", "/tests/", "/spec/", "/specs/",
    "/__tests__/", "/mocks/", "/fixtures/",
    "/e2e/", "/cypress/", "/playwright/",
    "/benchmark/", "/benchmarks/",
    "/example/", "/examples/", "/demo/", "/demos/",
)
TEST_FILE = ("_test.", "_spec.", "/test/", "/tests/")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under `path`, recursively: path, content, mtime. Spark lists and reads; links are the store's to follow."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))


def from_strings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Files given in memory: name to content."""
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def directories(root: str) -> list[str]:
    """Directories below `root`, links followed once each."""
    seen, out = set(), []
    for at, names, _ in os.walk(root, followlinks=True):
        real = os.path.realpath(at)
        if real in seen:
            names[:] = []
            continue
        seen.add(real)
        out.append(at)
    return out


def staged(files: DataFrame, root: str = ".") -> DataFrame:
    """Only files that git has staged as added, copied or modified."""
    done = subprocess.run(["git", "diff", "--cached", "--name-only", "--diff-filter=ACM"], cwd=root, capture_output=True, text=True, check=True)
    names = files.sparkSession.createDataFrame([(x,) for x in done.stdout.splitlines() if x], "staged string")
    return files.join(names, F.expr("path = staged OR endswith(path, concat('/', staged))"), "left_semi")


def is_excluded(path: Column, patterns: list[str] | tuple[str, ...] = ()) -> Column:
    """By the base name's pattern, an exact lower-case segment, or the user's patterns (name, or part of the path)."""
    base, lower = basename(path), F.lower(path)
    named = base.rlike("|".join(f"(?:{glob(p)})" for p in (*EXCLUDED_NAMES, *patterns)))
    segment = F.arrays_overlap(F.split(lower, "/"), F.array(*map(F.lit, EXCLUDED_SEGMENTS)))
    return named | segment | any_of([lower.contains(p.lower()) for p in patterns])


def is_supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS) | F.lower(basename(path)).isin(*BARE_NAMES)


def is_test_like(path: Column) -> Column:
    return has_any(F.lower(path), TEST_LIKE)


def is_test_file(path: Column) -> Column:
    return has_any(path, TEST_FILE)


def scannable(files: DataFrame, patterns: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Files of a scan: not excluded, and with an extension that it takes."""
    return files.where(~is_excluded(F.col("path"), patterns) & is_supported(F.col("path")))


def described(files: DataFrame) -> DataFrame:
    """Files with language and is_test_file."""
    return files.withColumns({"language": language_of(F.col("path")), "is_test_file": is_test_like(F.col("path"))})


def lines(files: DataFrame) -> DataFrame:
    """path, language, is_test_file, line_no (from 1), text of every line, a last empty one included."""
    return described(files).select("path", "language", "is_test_file", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select(
        "path", "language", "is_test_file", (F.col("pos") + 1).alias("line_no"), "text"
    )


def lines_near(files: DataFrame, reach: int, mark: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """`lines` with `lines`, the `mark` of each from `reach` before to `reach` after, and `at`, the own one's place in it, from 1.

    Both are made where a file is taken apart: nothing is joined, a line is marked once, and what it brings along grows with `reach`,
    not with its file.
    """
    first = lambda i: F.greatest(i + 1 - reach, F.lit(1))
    near = F.transform("_all", lambda x, i: F.struct(x.alias("text"), F.slice("_marks", first(i), i + reach + 2 - first(i)).alias("lines")))
    rows = described(files).select("path", "language", "is_test_file", F.split("content", "\n").alias("_all"))
    rows = rows.select("*", F.transform("_all", mark).alias("_marks"))
    rows = rows.select("path", "language", "is_test_file", F.posexplode(near).alias("pos", "x"))
    return rows.select("path", "language", "is_test_file", (F.col("pos") + 1).alias("line_no"), "x.text", "x.lines", (F.least(F.col("pos"), F.lit(reach)) + 1).alias("at"))


def with_lines(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with `lines`, the array of their file's lines: context is looked up for findings alone."""
    return findings.join(files.select(F.col("path").alias("file"), F.split("content", "\n").alias("lines")), "file", "left")
