import pytest
from pyspark.sql import functions as F
from siftwork.operators import match, scores
from siftwork.plans import queries
from siftwork.sources import files as source

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_confidence", "score_false_positive"])
def test_no_whole_file_is_joined_to_a_finding(spark, name):
    plan = queries.QUERIES[name](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_near_lines_score_as_whole_files(spark):
    text = "\n".join(f"line {k} the word " + ("if err != nil check error" if k % 7 == 0 else "validated sanitize" if k % 13 == 5 else "# plain") for k in range(40))
    rows = [("a.py", text), ("b.py", "the one"), ("c_test.go", "the one\n// check\nthe two"), ("a.py", text[:400]), (None, "the path\nis null, sanitize"), ("d.py", ""), ("e.py", None)]
    own = spark.createDataFrame(rows, "path string, content string")
    for score, mark, column in ((scores.confidence, scores.confidence_mark, "confidence_score"), (scores.false_positive, scores.false_positive_mark, "fp_score")):
        for some in (own, own.where("path <> 'a.py'"), own.limit(2)):
            whole = score(source.with_lines(match.findings(source.lines(some), queries.rules()), some))
            near = score(match.findings_near(some, queries.rules(), scores.REACH, mark))
            got, want = (sorted(map(str, df.select("rule_id", "file", "line", F.round(column, 9)).collect())) for df in (near, whole))
            assert got == want and got
