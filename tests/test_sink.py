import os

import pytest
from pyspark.sql import functions as F
from siftwork.operators import sink


def test_document_of_many_parts(spark, tmp_path):
    """Order, joints between parts that hold items and those that don't, nulls, an old document replaced, nothing left beside it."""
    at = str(tmp_path / "a.txt")
    open(at, "w").write("old")
    rows = spark.range(0, 1000, 1, 7).where("id % 143 > 20 OR id < 300").select(F.when(F.col("id") % 5 != 0, F.concat(F.lit("é"), F.col("id"))).alias("value"))
    sink.write(rows, at, "<", ", ", ">")
    want = [f"é{n}" for n in range(1000) if (n % 143 > 20 or n < 300) and n % 5]
    assert open(at, encoding="utf-8").read() == "<" + ", ".join(want) + ">" and os.listdir(tmp_path) == ["a.txt"]
    sink.write(rows.limit(0), at, "<", ", ", ">")
    assert open(at).read() == "<>"


def test_failed_write_leaves_the_old_document(spark, tmp_path):
    at = str(tmp_path / "a.txt")
    open(at, "w").write("old")
    with pytest.raises(Exception):  # noqa: B017
        sink.write(spark.range(0, 10, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value")), at)
    assert open(at).read() == "old" and os.listdir(tmp_path) == ["a.txt"]
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(F.lit("x").alias("value")).write.format("document").mode("append").save(at)


def test_reports_read_stored_findings(spark, monkeypatch):
    """What report_sink reports was searched before: its plan splits no lines."""
    from siftwork.operators import reports
    from siftwork.plans import queries

    class Seen(Exception):
        pass

    def seen(found, *_):
        assert found.count() > 0 and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        raise Seen

    monkeypatch.setattr(reports, "write_report", seen)
    with pytest.raises(Seen):
        queries.QUERIES["report_sink"](spark, "/root/testdata/sf0.001")
