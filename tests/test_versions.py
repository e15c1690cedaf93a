import itertools

from pyspark.sql import functions as F
from siftwork.operators import dependencies, versions

SEMANTIC = "0.0.0-0 0.0.1 0.9.10 1-0 1.0.0-alpha 1.0.0-alpha.1 1.0.0-alpha.beta 1.0.0-alphabet 1.0.0-beta 1.0.0-beta.2 1.0.0-beta.11 1.0.0-rc.1 1.0.0 1.0.1-x 1.0.1 1.2 1.10 2 10.0.0 123456789012345678901.1".split()
PYTHON = "0.9 1.0.dev3 1.0a1.dev2 1.0a1 1.0b2 1.0b10 1.0rc1 1.0 1.0.post1.dev1 1.0.post1 1.0.post2 1.0.1.dev1 1.0.1 1.9 1.10 1!0.1 2!0.0.1".split()


def test_keys_compare_as_versions_do(spark):
    for eco, every in (("npm", SEMANTIC), ("pypi", PYTHON)):
        rows = spark.createDataFrame(list(enumerate(every)), "n int, v string").select("n", versions.key(F.lit(eco), F.col("v")).alias("k")).orderBy("n").collect()
        keys = [r.k for r in rows]
        assert all(a.encode() < b.encode() for a, b in itertools.pairwise(keys)), [(x, y) for x, y in itertools.pairwise(zip(every, keys)) if x[1] >= y[1]]


def test_equal_and_unreadable(spark):
    rows = [("npm", "1.0"), ("npm", "v1.0.0"), ("npm", "1.0.0+build.5"), ("npm", "01.00"), ("npm", ""), ("npm", None), ("npm", "latest"), ("pypi", "1.0RC1"), ("pypi", "1.0-c.1"), ("pypi", "1.0-2"), ("pypi", "1.0.post2")]
    k = [r.k for r in spark.createDataFrame(rows, "e string, v string").select(versions.key(F.col("e"), F.col("v")).alias("k")).collect()]
    assert len(set(k[:4])) == 1 and k[4:7] == [None] * 3 and k[7] == k[8] and k[9] == k[10]


def test_ranges_against_every_pair(spark):
    """All pairs of ends for one package that has every version, and a second one, ends open or unreadable included."""
    ends = [None, *SEMANTIC, "none"]
    place = {v: n for n, v in enumerate(SEMANTIC)}
    ranges = [("npm", "hot", n, a, b) for n, (a, b) in enumerate(itertools.product(ends, ends))] + [("npm", "cold", 0, None, "1.0.0"), ("pypi", "hot", 1, "0", None)]
    have = [("npm", "hot", v) for v in SEMANTIC] * 2 + [("npm", "cold", "0.0.1"), ("npm", "cold", "1.0.0"), ("npm", "alone", "1"), ("npm", "hot", None), ("npm", None, "1")]
    got = versions.inside(spark.createDataFrame(have, "ecosystem string, package string, version string"), spark.createDataFrame(ranges, "ecosystem string, package string, nth long, introduced string, fixed_version string")).collect()
    want = {("hot", v, n) for _, p, n, a, b in ranges[: len(ends) ** 2] if "none" not in (a, b) for v in SEMANTIC if (a is None or place[v] >= place[a]) and (b is None or place[v] < place[b])} | {("cold", "0.0.1", 0)}
    assert {(r.package, r.version, r.nth) for r in got} == want and len(got) == len(want)


def test_advisories_and_empty_tables(spark):
    files = spark.createDataFrame([("a/requirements.txt", "Flask==2.0rc1\nrequests==2.1\n"), ("b/package.json", '{"dependencies": {"x": "^1.2.0-beta.2"}}'), ("c/go.mod", "require a.b/c v1.4.0")], "path string, content string")
    schema = "ecosystem string, package string, id string, summary string, severity string, introduced string, fixed_version string, references array<string>"
    rows = [("pypi", "flask", "P1", "", "high", None, "2.0", []), ("pypi", "flask", "P1", "", "high", "3", "4", []), ("pypi", "flask", "P2", "", "high", "2.0", None, []), ("npm", "x", "N1", "", "low", "1.2.0-beta.1", "1.2.0", []), ("go", "a.b/c", "G1", "", "low", "1.4.1", None, [])]
    found = dependencies.packages(files)
    assert sorted((r.id, r.version) for r in dependencies.vulnerable(found, spark.createDataFrame(rows, schema)).collect()) == [("N1", "1.2.0-beta.2"), ("P1", "2.0rc1")]
    assert dependencies.vulnerable(found, spark.createDataFrame([], schema)).isEmpty() and dependencies.vulnerable(found.limit(0), spark.createDataFrame(rows, schema)).isEmpty()
