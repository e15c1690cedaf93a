"""Versions as keys that compare, byte by byte, as the versions do; versions joined with ranges of versions.

A key is a text of marks and numbers. A number is its count of digits (two digits, so up to 99) and its digits without leading
zeros, so numbers of any length compare right. A part of the core is '2' and its number, parts of zero at the end are left out
(1.0 is 1.0.0); then comes '1' for a release or '0' and what follows for a pre-release. So 1.2-a < 1.2 < 1.2.1-a < 1.2.1.

* `semantic`: identifiers between points, numbers below names, fewer below more; what follows a '+' is ignored.
* `python`: epochs, then dev, a, b and rc below the release and post above it; a dev part of a pre-release or a post-release is
  below that. A local part ('+') is ignored.

Defined results: null, empty and unreadable versions have no key, and meet no range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import met

CORE = r"^[vV=\s]*([0-9]+(?:\.[0-9]+)*)(.*)$"
#: What a Python pre-release may be called, by order. DEV comes before them.
STAGES = (("a", "alpha"), ("b", "beta"), ("c", "rc", "pre", "preview"))
DEV, FIRST_STAGE = "1", 2
PRE, RELEASE, PART = "0", "1", "2"


def number(digits: Column) -> Column:
    bare = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 2, "0"), bare)


def _core(text: Column) -> Column:
    """The numbers of a version up to the last that isn't zero."""
    bare = F.regexp_replace(F.regexp_extract(text, CORE, 1), r"(\.0+)+$", "")
    return F.array_join(F.transform(F.split(bare, r"\."), lambda x: F.concat(F.lit(PART), number(x))), "")


def semantic(version: Column) -> Column:
    rest = F.regexp_replace(F.substring_index(F.regexp_extract(version, CORE, 2), "+", 1), r"^[-.]|\s+$", "")
    identifier = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("1"), number(x))).otherwise(F.concat(F.lit("2"), x, F.lit("!")))
    after = F.when(rest == "", RELEASE).otherwise(F.concat(F.lit(PRE), F.array_join(F.transform(F.split(rest, r"\."), identifier), ""), F.lit("0")))
    return F.when(version.rlike(CORE), F.concat(_core(version), after))


def python(version: Column) -> Column:
    low = F.lower(F.trim(version))
    epoch = F.regexp_extract(low, r"^([0-9]+)!", 1)
    bare = F.regexp_replace(low, r"^[0-9]+!", "")
    rest = F.substring_index(F.regexp_extract(bare, CORE, 2), "+", 1)
    dev = r"[-_.]?dev[-_.]?([0-9]*)$"
    stage, nth = F.regexp_extract(rest, r"^[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*)", 1), F.regexp_extract(rest, r"^[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]*)", 2)
    post = r"(?:[-_.]?(?:post|rev|r)[-_.]?([0-9]*)|-([0-9]+))(?:[-_.]?dev[-_.]?[0-9]*)?$"
    order = F.coalesce(*[F.when(stage.isin(*names), F.lit(str(FIRST_STAGE + k))) for k, names in enumerate(STAGES)])
    below = F.when(rest.rlike(dev), F.concat(F.lit(PRE), number(F.regexp_extract(rest, dev, 1)))).otherwise(F.lit(RELEASE))
    after = (
        F.when(order.isNotNull(), F.concat(F.lit(PRE), order, number(nth), below))
        .when(rest.rlike("^" + post), F.concat(F.lit(RELEASE + "1"), number(F.concat(F.regexp_extract(rest, "^" + post, 1), F.regexp_extract(rest, "^" + post, 2))), below))
        .when(rest.rlike("^" + dev), F.concat(F.lit(PRE + DEV), number(F.regexp_extract(rest, "^" + dev, 1)), F.lit(RELEASE)))
        .otherwise(F.lit(RELEASE))
    )
    return F.when(bare.rlike(CORE), F.concat(number(epoch), _core(bare), after))


def key(ecosystem: Column, version: Column) -> Column:
    """By the rules of the ecosystem: `python` for pypi, `semantic` for the others."""
    return F.when(ecosystem == "pypi", python(version)).otherwise(semantic(version))


def inside(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """ecosystem, package, version, nth: each distinct version with the `nth` of the ranges that hold it.

    `packages` has ecosystem, package, version; `ranges` ecosystem, package, nth, introduced (null: from the first) and
    fixed_version (null: for ever), which is outside. The distinct versions of a package and the ends of its ranges are
    numbered in one order, and numbers are joined with ranges of numbers by blocks of a tree: what is made is what meets,
    however many versions and ranges a package has. Nothing but distinct versions and ends is sorted.
    """
    same = ["ecosystem", "package"]
    # Keys come out of a generator, so that their long expressions are evaluated once and never copied into filters.
    have = packages.select(*same, "version").distinct().select("*", F.explode(F.array_compact(F.array(key(F.col("ecosystem"), F.col("version"))))).alias("key"))
    both = F.array(F.struct(*[key(F.col("ecosystem"), F.col(c)).alias(c) for c in ("introduced", "fixed_version")]))
    ends = ranges.select("*", F.explode(both).alias("_key")).select(*same, "nth", *[F.when(F.col(c).isNull(), open_).otherwise(F.col(f"_key.{c}")).alias(f"_{c}") for c, open_ in (("introduced", ""), ("fixed_version", "~"))])
    # An end that can't be read makes a range that holds nothing.
    ends = ends.where("_introduced IS NOT NULL AND _fixed_version IS NOT NULL")
    # Packages without a range are out before anything is sorted.
    have = have.join(ends.select(*same).distinct(), same, "left_semi")
    points = have.select(*same, "key", "version", F.lit(None).cast("long").alias("nth"), F.lit(False).alias("stop"))
    begins = ends.select(*same, F.col("_introduced").alias("key"), F.lit(None).cast("string").alias("version"), F.col("nth").cast("long").alias("nth"), F.lit(False).alias("stop"))
    stops = ends.select(*same, F.col("_fixed_version").alias("key"), F.lit(None).cast("string").alias("version"), F.col("nth").cast("long").alias("nth"), F.lit(True).alias("stop"))
    order = F.dense_rank().over(Window.partitionBy(*same).orderBy("key")).cast("long")
    placed = points.unionByName(begins).unionByName(stops).withColumn("at", order)
    name = F.to_json(F.array(*same))
    bounds = placed.where("nth IS NOT NULL").groupBy(name.alias("_name"), F.col("nth").alias("_nth")).agg(F.max(F.when(~F.col("stop"), F.col("at"))).alias("_from"), (F.max(F.when(F.col("stop"), F.col("at"))) - 1).alias("_to"))
    found = met(placed.where("nth IS NULL").select(*same, "version", "at", name.alias("name")), bounds, ("name", "_name"), "at", "_from", "_to")
    return found.select(*same, "version", F.col("_nth").alias("nth"))
