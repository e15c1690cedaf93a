"""Findings counted over every grouping of severity, category, language and source, exactly and by stored sketches.

`exact` is a cube (GROUPING SETS) with distinct counts. `cells` is the table that scans keep: one row for each combination that
occurs, with counts and two sketches that merge, of the distinct files (HyperLogLog) and of the lines' numbers (KLL quantiles).
`rolled` makes the cube out of any number of such tables, of one scan or of many, without a finding being read again: what moves is cells,
whose number is that of the combinations, and a sketch's size is bounded. Both first aggregate in every task, so
that a value that a third of all findings have is never gathered.

Error: the estimate of distinct files has a relative standard error of 1.04 / sqrt(2 ** LG_K); a quantile's rank is off by RANK_ERROR
of the number of findings at most, at 99 % confidence.

Defined results: a dimension that is null is a value of its own, told from a total by `level`, whose bits (severity 8, category 4,
language 2, source 1) say which dimensions are summed over; null files are no file; an empty relation has no cells (so has its cube no rows).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_of

DIMENSIONS = ("severity", "category", "language", "source")
LG_K, KLL_K = 14, 800
RANK_ERROR = 0.0055
QUANTILES = (0.5, 0.9)


def standard_error() -> float:
    return 1.04 / math.sqrt(2**LG_K)


def dimensioned(findings: DataFrame) -> DataFrame:
    """Findings with language (by the file's ending) and source (the first folder of the path)."""
    return findings.withColumns({"language": language_of(F.col("file")), "source": F.substring_index("file", "/", 1)})


def _level() -> Column:
    return F.grouping_id().cast("int").alias("level")


def exact(findings: DataFrame) -> DataFrame:
    """The dimensions, level, n, files: a cube of findings and their distinct files.

    Files are counted by what is left after one pass over distinct (dimensions, file), so the cube expands these and not the findings.
    """
    once = findings.groupBy(*DIMENSIONS, "file").agg(F.count("*").alias("n"))
    return once.cube(*DIMENSIONS).agg(_level(), F.sum("n").alias("n"), F.count_distinct("file").alias("files")).where("n IS NOT NULL")


def cells(findings: DataFrame) -> DataFrame:
    """The dimensions, n, first_line, last_line, files_sketch, lines_sketch: one row for each combination, to be stored."""
    line = F.col("line").cast("long")
    return findings.groupBy(*DIMENSIONS).agg(
        F.count("*").alias("n"), F.min(line).alias("first_line"), F.max(line).alias("last_line"),
        F.hll_sketch_agg("file", LG_K).alias("files_sketch"), F.kll_sketch_agg_bigint(line, KLL_K).alias("lines_sketch"),
    )


def rolled(*stored: DataFrame) -> DataFrame:
    """The dimensions, level, n, first_line, last_line, files (estimated), and line_<q> for QUANTILES (estimated) of all of `stored`."""
    every = reduce(DataFrame.unionByName, stored)
    cube = every.cube(*DIMENSIONS).agg(
        _level(), F.sum("n").alias("n"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"),
        F.hll_union_agg("files_sketch").alias("_files"), F.kll_merge_agg_bigint("lines_sketch").alias("_lines"),
    ).where("n IS NOT NULL")
    quantiles = [F.kll_sketch_get_quantile_bigint("_lines", F.lit(q)).alias(f"line_{round(100 * q)}") for q in QUANTILES]
    return cube.select(*DIMENSIONS, "level", "n", "first_line", "last_line", F.hll_sketch_estimate("_files").alias("files"), *quantiles)


def rank_errors(rolled_up: DataFrame, findings: DataFrame) -> DataFrame:
    """`rolled_up` with rank_error_<q>: how far the quantile's rank is from q, as a share of n; what the sketches are checked by.

    Findings are counted by line first; the counts are expanded to the cube.
    """
    by_line = findings.groupBy(*DIMENSIONS, F.col("line").cast("long").alias("_line")).agg(F.count("*").alias("_c"))
    fine = by_line.cube(*DIMENSIONS, "_line").agg(F.grouping_id().alias("_g"), F.sum("_c").alias("_c"))
    fine = fine.where((F.col("_g") % 2 == 0) & F.col("_line").isNotNull()).withColumn("_level", F.shiftright(F.col("_g").cast("int"), 1))
    fine = fine.select("_level", "_line", "_c", *[F.col(d).alias(f"_{d}") for d in DIMENSIONS])
    same = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS], F.col("level") == F.col("_level"))
    names = [f"line_{round(100 * q)}" for q in QUANTILES]
    below = [F.sum(F.when(F.col("_line") < F.col(x), F.col("_c")).otherwise(0)).alias(f"_below_{x}") for x in names]
    upto = [F.sum(F.when(F.col("_line") <= F.col(x), F.col("_c")).otherwise(0)).alias(f"_upto_{x}") for x in names]
    counted = rolled_up.join(fine, same).groupBy(*rolled_up.columns).agg(*below, *upto)
    # A value stands for all ranks that rows with it have.
    off = [F.greatest(F.col(f"_below_{x}") - q * F.col("n"), q * F.col("n") - F.col(f"_upto_{x}"), F.lit(0.0)) / F.col("n") for q, x in zip(QUANTILES, names)]
    return counted.select(*rolled_up.columns, *[e.alias(f"rank_error_{round(100 * q)}") for q, e in zip(QUANTILES, off)])
