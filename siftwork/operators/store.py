"""The result cache as a maintained table: findings of files in buckets, of which only those that changed are read and written.

A file is dealt to a bucket by its path. The manifest holds, for each bucket, the version in which it was last written, how
many files it has and a sum of hashes of their (path, content hash, ruleset), which doesn't depend on order. Files that come in
are summed in the same way; where the sums agree, a bucket is not opened. In the others, entries that are still good are
kept, files without one are scanned, and the bucket is written anew under the next version. Counts for the noise limits
and the summary are a view that is corrected by the difference of the buckets before and after, never counted again.

A version is there once its manifest is: whoever reads takes the last complete one, and an update that fails leaves the one
before. Files written by it are not overwritten. Defined results: files without a path or content are not cached and have no findings; a path that comes
more than once counts as a changed file with one of its contents (the least hash); an empty table of files empties the store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .compare import hashed

FOUND = "array<struct<rule_id: string, severity: string, line: int>>"
ENTRY = f"path string, hash string, ruleset string, findings {FOUND}, bucket int"
MANIFEST = "bucket int, version int, files long, digest decimal(38,0)"
#: Files of a rule with so many findings each: what noise limits and totals are made of, and what can be subtracted.
COUNTS = "rule_id string, severity string, per_file long, files long"


@dataclass(frozen=True)
class Round:
    """What an update did: the version it wrote, buckets that it opened, and files that it scanned."""

    version: int
    buckets: int
    scanned: int


class Store:
    """A cache in the folder `at`, which driver and executors share, of `buckets` buckets."""

    def __init__(self, spark: SparkSession, at: str, buckets: int = 256):
        self.spark, self.at, self.buckets = spark, at.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last complete version; 0 before the first."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/manifest")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return 0
        names = [x.getPath().getName() for x in store.listStatus(path)]
        return max((int(n[2:]) for n in names if store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.at}/manifest/{n}/_SUCCESS"))), default=0)

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.at}/manifest/v={version}") if version else self.spark.createDataFrame([], MANIFEST)

    def _read(self, buckets: list) -> DataFrame:
        """Entries of these rows of a manifest: their folders alone are listed."""
        found = None
        for version in sorted({r.version for r in buckets}):
            paths = [f"{self.at}/v={version}/bucket={r.bucket}" for r in buckets if r.version == version and r.files]
            if paths:
                part = self.spark.read.schema(ENTRY).option("basePath", f"{self.at}/v={version}").parquet(*paths)
                found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], ENTRY) if found is None else found

    def entries(self) -> DataFrame:
        # As many rows as there are buckets, a parameter.
        return self._read(self._manifest(self.version()).collect())

    def findings(self) -> DataFrame:
        """file, rule_id, severity, line of everything in the store."""
        return self.entries().select(F.col("path").alias("file"), F.explode("findings").alias("f")).select("file", "f.*")

    def counts(self) -> DataFrame:
        """The maintained view: rule_id, severity, per_file, files."""
        version = self.version()
        return self.spark.read.schema(COUNTS).parquet(f"{self.at}/counts/v={version}") if version else self.spark.createDataFrame([], COUNTS)

    def noise(self) -> DataFrame:
        """rule_id, severity, total, most in one file: what noise limits ask for, from the view."""
        return self.counts().groupBy("rule_id", "severity").agg(F.sum(F.col("per_file") * F.col("files")).alias("total"), F.max("per_file").alias("most"))

    @staticmethod
    def _counted(entries: DataFrame, sign: int) -> DataFrame:
        each = entries.select("path", F.explode("findings").alias("f")).groupBy("path", "f.rule_id", "f.severity").agg(F.count("*").alias("per_file"))
        return each.groupBy("rule_id", "severity", "per_file").agg((F.count("*") * sign).cast("long").alias("files"))

    def update(self, files: DataFrame, ruleset: str, scan: Callable[[DataFrame], DataFrame]) -> Round:
        """Make the store that of `files` (path, content). `scan` gives file, rule_id, severity, line of the findings of such files."""
        version = self.version()
        have = {r.bucket: r for r in self._manifest(version).collect()}
        lone = files.where("path IS NOT NULL AND content IS NOT NULL")
        now = hashed(lone, ruleset).withColumn("bucket", self._bucket())
        # Paths and hashes; of a path that comes twice one content counts.
        keys = now.groupBy("bucket", "path", "ruleset").agg(F.min("hash").alias("hash"))
        sums = keys.groupBy("bucket").agg(F.count("*").alias("files"), F.sum(F.xxhash64("path", "hash", "ruleset").cast("decimal(38,0)")).alias("digest"))
        wanted = {r.bucket: r for r in sums.collect()}
        changed = sorted(b for b in have.keys() | wanted.keys() if b not in have or b not in wanted or (have[b].files, have[b].digest) != (wanted[b].files, wanted[b].digest))
        changed = [b for b in changed if b in wanted or have[b].files]
        if not changed and version:
            return Round(version, 0, 0)
        old = self._read([have[b] for b in changed if b in have])
        opened = now.where(F.col("bucket").isin(changed)).join(keys.select("path", "hash"), ["path", "hash"], "left_semi").dropDuplicates(["path", "hash"])
        same = ["path", "hash", "ruleset"]
        kept = old.join(opened.select(*same), same, "left_semi")
        stale = opened.join(old.select(*same), same, "left_anti")
        found = scan(stale.select("path", "content")).groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("rule_id", "severity", F.col("line").cast("int").alias("line")))).alias("findings"))
        fresh = stale.select(*same, "bucket").join(found, "path", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FOUND)))
        to = version + 1
        rows = kept.select(*same, "findings", "bucket").unionByName(fresh.select(*same, "findings", "bucket"))
        rows.repartition(F.col("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.at}/v={to}")
        marks = [(b, to if b in changed else have[b].version, wanted[b].files if b in wanted else 0, wanted[b].digest if b in wanted else None) for b in sorted(have.keys() | wanted.keys())]
        new = self._read([r for r in self.spark.createDataFrame(marks, MANIFEST).collect() if r.bucket in changed])
        view = self.counts().unionByName(self._counted(old, -1)).unionByName(self._counted(new, 1))
        view = view.groupBy("rule_id", "severity", "per_file").agg(F.sum("files").cast("long").alias("files")).where("files <> 0")
        view.coalesce(1).write.mode("overwrite").parquet(f"{self.at}/counts/v={to}")
        scanned = new.join(old.select(*same), same, "left_anti").count()
        self.spark.createDataFrame(marks, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/manifest/v={to}")
        return Round(to, len(changed), scanned)
