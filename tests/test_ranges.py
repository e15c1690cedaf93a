import random

from pyspark.sql import functions as F
from siftwork.operators import blocks, ranges, suppress


def test_blocks_are_the_range(spark):
    rng = random.Random(1)
    rows = [(0, 0), (0, 63), (1, 63), (0, 511), (7, 8), (5, 3_000_000)]
    rows += [(a, a + rng.randint(0, 10 ** rng.randint(0, 3))) for a in (rng.randint(0, 5000) for _ in range(200))]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", ranges.blocks_of(F.col("a"), F.col("b")).alias("blocks"))
    for r in df.collect():
        held = sorted((x.b * ranges.FAN**x.k, (x.b + 1) * ranges.FAN**x.k) for x in r.blocks)
        assert held[0][0] == r.a and held[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(held, held[1:]))
        assert len(held) <= 2 * (ranges.FAN - 1) * ranges.LEVELS


def test_split_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(rng.choice(["x", "y", None]), rng.choice([None, *range(60)]), rng.choice("ab")) for _ in range(300)]
    spans = [(rng.choice(["x", "y", None]), a, a + rng.randint(-3, 30), rng.choice("ab")) for a in (rng.randint(0, 60) for _ in range(15))] + [("x", None, 5, "a"), ("x", 3, None, "a")]
    p = spark.createDataFrame(points, "file string, line int, kind string")
    s = spark.createDataFrame(spans, "_file string, _a int, _b int, _kind string")
    key = lambda r: tuple(map(str, r))
    hit = lambda p: any(None not in (p[0], p[1], a, b) and f == p[0] and a <= p[1] <= b and k == p[2] for f, a, b, k in spans)
    for how in ("left_semi", "left_anti"):
        got = ranges.split(p, s, ("file", "_file"), "line", "_a", "_b", ["kind"], F.col("kind") == F.col("_kind"), how).collect()
        assert sorted(map(tuple, got), key=key) == sorted((x for x in points if hit(x) == (how == "left_semi")), key=key)


def test_many_ranges_in_one_file_make_rows_in_proportion(spark):
    """10,000 findings and 10,000 annotations of one file: what the join makes is what meets, not their product."""
    found = spark.range(10_000).selectExpr("'f' AS file", "cast(id * 3 AS int) AS line", "'r' AS rule_id", "'c' AS cwe", "'k' AS category")
    notes = spark.range(10_000).selectExpr("'f' AS path", "cast(id * 3 + 1 AS int) AS line_start", "cast(id * 3 + if(id % 10 = 0, 2 + id % 100, 1) AS int) AS line_end", "false AS all_rules", "array('r') AS rule_ids", "array('x') AS cwes", "array('x') AS categories")
    a = notes.select(*[F.col(c).alias("_" + c) for c in notes.columns])
    met = ranges.met(found, a, ("file", "_path"), "line", "_line_start", "_line_end")
    want = sum(1 for k in range(10_000) for x in range((k * 3 + 1 + 2) // 3 * 3, k * 3 + (2 + k % 100 if k % 10 == 0 else 1) + 1, 3) if x < 30_000)
    assert met.count() == want < 20_000
    covered = {x for k in range(10_000) for x in range((k * 3 + 1 + 2) // 3 * 3, k * 3 + (2 + k % 100 if k % 10 == 0 else 1) + 1, 3)}
    assert suppress.unannotated(found, notes).count() == 10_000 - len(covered & {3 * k for k in range(10_000)})
    regions = spark.createDataFrame([("f", 10, 20), ("g", 0, 9), ("f", 0, 29_000)], "path string, start int, end int")
    assert blocks.in_dead_code(found, regions).count() == 29_000 // 3 + 1
