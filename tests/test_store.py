import pytest
from pyspark.sql import functions as F
from siftwork.operators.store import Round, Store


def scan(files):
    hit = lambda rule, severity, word: F.when(F.contains("content", F.lit(word)), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(1).alias("line")))
    found = F.array_compact(F.array(hit("a", "high", "apple"), hit("b", "low", "bean")))
    return files.select(F.col("path").alias("file"), F.explode(found).alias("f")).select("file", "f.*")


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(f"p{k}", f"apple {k}" if k % 2 else f"bean apple {k}" if k % 4 == 0 else "none") for k in range(200)], "path string, content string")


def state(kept):
    return sorted(map(tuple, kept.findings().collect())), sorted(map(tuple, kept.counts().collect()))


def test_only_changed_buckets_are_read(spark, files, tmp_path):
    kept, whole = Store(spark, f"{tmp_path}/a", 32), Store(spark, f"{tmp_path}/b", 32)
    first = kept.update(files, "r", scan)
    assert (first.version, first.scanned) == (1, 200) and 0 < first.buckets <= 32
    assert kept.update(files, "r", scan) == kept.update(files, "r", scan) and kept.version() == 1
    second = files.withColumn("content", F.when(F.col("path") == "p7", "bean").otherwise(F.col("content")))
    assert kept.update(second, "r", scan) == Round(2, 1, 1)
    whole.update(second, "r", scan)
    assert state(kept) == state(whole)
    # Only the bucket that changed has a folder in the second version.
    assert len([x for x in (tmp_path / "a" / "v=2").iterdir() if x.name.startswith("bucket=")]) == 1


def test_rounds_equal_a_full_scan(spark, files, tmp_path):
    kept = Store(spark, f"{tmp_path}/a", 8)
    rounds = [
        files, files.where("path <> 'p3' AND path NOT LIKE 'p1_'"), files.unionByName(spark.createDataFrame([("new", "bean"), (None, "apple"), ("void", None)], "path string, content string")),
        files.where("false"), files.withColumn("content", F.upper("content")), files,
    ]
    for k, some in enumerate(rounds):
        whole = Store(spark, f"{tmp_path}/w{k}", 8)
        whole.update(some, "r", scan)
        kept.update(some, "r", scan)
        assert state(kept) == state(whole), k
    before = kept.version()
    # Another ruleset makes every entry stale.
    again = kept.update(files, "other", scan)
    assert again.version == before + 1 and again.scanned == 200


def test_an_update_that_fails_changes_nothing(spark, files, tmp_path):
    kept = Store(spark, f"{tmp_path}/a", 8)
    kept.update(files, "r", scan)
    was = state(kept)

    def broken(some):
        return scan(some).withColumn("line", F.raise_error(F.lit("no")).cast("int"))

    with pytest.raises(Exception, match="no"):
        kept.update(files.withColumn("content", F.concat("content", F.lit(" more"))), "r", broken)
    assert state(kept) == was and kept.version() == 1
    kept.update(files.limit(10), "r", scan)
    assert kept.entries().count() == 10
