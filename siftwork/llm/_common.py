"""What the operators of this subpackage share: tables, shared storage, batches and components."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, through Spark's own reader."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, unless the session names a number of its own: whole texts travel in them.
BATCH = "2000"


def ship_code(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it comes with --py-files. Batches are kept small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local runs."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # executors of local-cluster have folders of their own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siftwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def sweep() -> None:
    """Delete what `stash` wrote and nothing has deleted yet, as the application ends: results read it until then."""
    for spark, at in _written:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc() is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, at)
    _written.clear()


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and return a reader of it: lineage ends here and any executor can be lost."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/siftwork-{uuid.uuid4().hex}"
    _written.append((spark, at))
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._siftwork_path = at
    return out


def unstash(df: DataFrame) -> None:
    """Delete what `stash` wrote; only where nothing reads it any more."""
    _written.remove((df.sparkSession, df._siftwork_path))
    _delete(df.sparkSession, df._siftwork_path)


#: Rows of two numbers are broadcast up to this many (4 MB), which is counted.
MOST_SMALL = 250_000


def small(df: DataFrame) -> DataFrame:
    """`df`, which `stash` wrote, of two numbers a row: broadcast where it has few rows, so that what it is joined with stays in place."""
    return F.broadcast(df) if df.count() <= MOST_SMALL else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on between tasks, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < len(sizes):
            yield batch.slice(start)
    give_back()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b): (id, root), root being the smallest id reachable.

    Alternating large-star and small-star steps, each a join of edges with the least neighbour of a node;
    rounds are written to the shared folder. No node's neighbours are ever gathered. While the edges are few, least
    neighbours are broadcast and edges stay in place. Self links and repeated links are allowed; null ends are dropped.
    """
    e = stash(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(most_rounds):
        # Done once every node that points somewhere points to one node, which points nowhere.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("from").alias("from"), F.max("to").alias("to")).where("from > 1 OR from = 1 AND to = 1").isEmpty():
            break
        few = e.count() <= MOST_SMALL
        known = F.broadcast if few else lambda df: df
        both = e.select("u", "v").union(e.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(known(least), "x").where("y > x AND y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        if not few:  # there are no more of these than edges
            large = large.groupBy("u", "v").agg(F.count("*").alias("n")).drop("n")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(known(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(down.union(least.select("u", "m")).distinct())
        unstash(e)
        e = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        roots.select(F.col("v"), F.col("v")).distinct()
    )
