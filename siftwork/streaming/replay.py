"""Tables as streams: rows written in parts, and a stream over them that is stopped and started again from its checkpoint."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import PROVIDER


#: Rows of a file of the stream, about: a part of more rows comes as more files, so that its tasks grow with it.
FILE_ROWS = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in local runs without it one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siftwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replay(rows: DataFrame, arrival: Column, parts: int, through: Callable[[DataFrame], DataFrame], files: int = 3, runs: int = 2, late: list[int] | None = None) -> DataFrame:
    """What `through` makes of `rows` as a stream in which the rows of part `arrival` (from 0) come as `files` files, after the part before;
    as more, alike for all parts, where they would be larger than FILE_ROWS rows on average.

    The stream is started `runs` times, each time with more parts there, and goes on from its checkpoint; each batch is a part. All
    data is in the shared folder, and the result is the table that the stream has written. `late` gets the number of rows that each batch's
    operators dropped behind the watermark.
    """
    spark = rows.sparkSession
    at = shared_folder(spark)
    files = max(files, -(-rows.count() // (parts * FILE_ROWS)))
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        done = 0
        for run in range(1, runs + 1):
            until = parts * run // runs
            for part in range(done, until):
                # Written one after the other, as the stream takes files by their time.
                rows.where(arrival == part).repartition(files).write.mode("append").parquet(f"{at}/in")
            done = until
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
            made = through(stream)
            started = made.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start()
            started.awaitTermination()
            if late is not None:
                late += [o["numRowsDroppedByWatermark"] for p in started.recentProgress for o in p["stateOperators"]]
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(made.schema).parquet(f"{at}/out")


def slices(rows: DataFrame, stamp: str, parts: int) -> Column:
    """The part of a row if `rows` are cut by time into parts of about the same size: parts - 1 numbers come to the driver."""
    at = F.unix_micros(F.col(stamp).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)])).first()[0] or []
    return sum(((at > c).cast("int") for c in cuts), F.lit(0))
