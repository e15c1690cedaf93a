"""Findings against earlier ones: baselines, comparisons of scans, and the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import snippet_hash

DRIFT = 5


def records(findings: DataFrame) -> DataFrame:
    """What a baseline keeps of findings."""
    return findings.select("rule_id", "file", "line", "column", snippet_hash("snippet").alias("snippet_hash"), "rule_name", "severity", "snippet")


def _match(baseline: DataFrame) -> tuple[DataFrame, Column]:
    """Equality on rule and file, either exact place or an equal snippet within DRIFT lines as the residual."""
    b = baseline.select(*[F.col(c).alias("_" + c) for c in ("rule_id", "file", "line", "column", "snippet_hash")])
    exact = (F.col("line") == F.col("_line")) & (F.col("column") == F.col("_column"))
    fuzzy = (snippet_hash("snippet") == F.col("_snippet_hash")) & (F.abs(F.col("line") - F.col("_line")) <= DRIFT)
    return b, (F.col("rule_id") == F.col("_rule_id")) & (F.col("file") == F.col("_file")) & (exact | fuzzy)


def new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    b, match = _match(baseline)
    return findings.join(b, match, "left_anti")


def known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    b, match = _match(baseline)
    return findings.join(b, match, "left_semi")


def key() -> Column:
    return F.concat_ws(":", "rule_id", "file", F.col("line").cast("string"), "category")


def finding_hash() -> Column:
    return F.lower(F.hex((F.col("line") * F.col("column") + F.octet_length("rule_id") + F.octet_length("message")).cast("long")))


def scans(now: DataFrame, before: DataFrame) -> DataFrame:
    """Keys of both scans with their state: new, fixed or unchanged."""
    a = now.select(key().alias("key")).distinct().withColumn("a", F.lit(1))
    b = before.select(key().alias("key")).distinct().withColumn("b", F.lit(1))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "fixed").otherwise("unchanged")
    return a.join(b, "key", "full").select("key", state.alias("state"))


def hashed(files: DataFrame, ruleset: str = "") -> DataFrame:
    """Files with the hash that a cache entry must have; `ruleset` is a hash of the rules, as results depend on both."""
    return files.withColumns({"hash": F.sha2("content", 256), "ruleset": F.lit(ruleset)})


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Hashed files without a fresh entry: these are scanned."""
    return files.join(cache.select("path", "hash", "ruleset"), ["path", "hash", "ruleset"], "left_anti")


def fresh(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries that are still good: their findings are reused."""
    return cache.join(files.select("path", "hash", "ruleset"), ["path", "hash", "ruleset"], "left_semi")


def entries(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Cache entries of scanned files, findings as JSON; a file without findings has an empty list."""
    found = findings.groupBy(F.col("file").alias("path")).agg(F.to_json(F.collect_list(F.struct(*findings.columns))).alias("findings"))
    return files.select("path", "hash", "ruleset").join(found, "path", "left").withColumn("findings", F.coalesce("findings", F.lit("[]")))


def unexpired(entries: DataFrame, stamp: str = "ts", days: int = 30, now: Column | None = None) -> DataFrame:
    """Entries no older than so many days."""
    return entries.where(F.col(stamp) >= (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))


def cache_stats(entries: DataFrame, stamp: str = "ts", days: int = 30, now: Column | None = None) -> DataFrame:
    old = F.col(stamp) < (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days))
    return entries.agg(F.count("*").alias("entries"), F.count_if(old).alias("expired"))


def save(records: DataFrame, path: str) -> None:
    """Write a baseline, comparison or cache as JSON lines, replacing what is there."""
    records.write.mode("overwrite").json(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.delete(at, True)


def load(spark: SparkSession, path: str, schema: str = schemas.BASELINE) -> DataFrame:
    """What `save` wrote; empty without it."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """A baseline kept as one JSON document with its records under `findings`."""
    whole = spark.read.option("multiLine", True).schema(f"created string, findings array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schemas.BASELINE.split(','))}>>").json(path)
    return whole.select(F.explode("findings").alias("f")).select("f.*")
