"""Packages named in manifests joined with advisories by version range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from . import versions

VERSION = r"([0-9][0-9A-Za-z.+_!-]*)"


def packages(files: DataFrame) -> DataFrame:
    """ecosystem, package, version, path of pinned dependencies in package.json, requirements.txt and go.mod."""
    base = F.lower(basename(F.col("path")))
    entries = F.map_entries(F.coalesce(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    npm = files.where(base == "package.json").select(F.lit("npm").alias("ecosystem"), "path", F.explode(entries).alias("e"))
    npm = npm.select("ecosystem", F.col("e.key").alias("package"), F.regexp_extract("e.value", VERSION, 1).alias("version"), "path")
    line = files.select("path", base.alias("base"), F.explode(F.split("content", "\n")).alias("line"))
    pinned, module = r"^\s*([A-Za-z0-9._-]+)\s*==\s*" + VERSION, r"^\s*(?:require\s+)?([a-z0-9.\-]+/[^\s]+)\s+v" + VERSION
    pip = line.where((F.col("base") == "requirements.txt") & F.col("line").rlike(pinned)).select(F.lit("pypi").alias("ecosystem"), F.lower(F.regexp_extract("line", pinned, 1)).alias("package"), F.regexp_extract("line", pinned, 2).alias("version"), "path")
    go = line.where((F.col("base") == "go.mod") & F.col("line").rlike(module)).select(F.lit("go").alias("ecosystem"), F.regexp_extract("line", module, 1).alias("package"), F.regexp_extract("line", module, 2).alias("version"), "path")
    return npm.unionByName(pip).unionByName(go)


def vulnerable(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages with an advisory (ecosystem, package, id, summary, severity, introduced, fixed_version, references) for their version.

    Advisories are numbered by their content, so that repeated ones and several ranges of one id are each looked up as a range; the
    packages themselves move for the last join only, by name and version.
    """
    nth = F.xxhash64("id", F.coalesce("introduced", F.lit("")), F.coalesce("fixed_version", F.lit("")), F.col("introduced").isNull(), F.col("fixed_version").isNull())
    ranges = advisories.withColumn("nth", nth)
    met = versions.inside(found, ranges.select("ecosystem", "package", "nth", "introduced", "fixed_version").distinct())
    hits = met.join(ranges, ["ecosystem", "package", "nth"]).drop("nth", "introduced")
    return found.join(hits, ["ecosystem", "package", "version"]).select("id", "summary", "severity", "package", "version", "fixed_version", "references", "path")
