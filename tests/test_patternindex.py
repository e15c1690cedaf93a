import random
import re

import pytest
from siftwork.operators import match, patternindex
from siftwork.plans import queries
from siftwork.sources import rules as catalog

PATTERNS = [
    r"password\s*=", r"(?i)SeCret", r"foo|bar", r"(alpha|beta)+x", r"a{3}bcd", r"ab?cdef", r"[xyz]abc", r"(?:one|two)three?", r"^import\s+os$", r"x*", r"\d+", r"(?P<n>user)_(?P<m>\w+)",
    r"éclair", r"tail(?!s)end", r"(?=look)ahead", r"a(bc|de)f", r"[ab][cd][ef]g", r"(abc)?def", r"(a|bb|ccc)xyz",
]


def test_every_match_holds_a_factor():
    rng = random.Random(3)
    words = ["password", " = ", "SECRET", "foo", "BAR", "alphaalphax", "betax", "aaabcd", "acdef", "abcdef", "xabc", "onethre", "twothree", "import os", "123", "user_x", "éclair", "tailend", "lookahead", "abcf", "adef", "acegx", "bdfg", "def", "bbxyz", "cccxyz"]
    hits = 0
    for _ in range(3000):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        text = text.upper() if rng.random() < 0.3 else text
        for source in PATTERNS:
            own = patternindex.factors(source)
            if re.search(source, text):
                hits += own is not None
                assert own is None or any(f in text.lower() for f in own), (source, text, own)
    assert hits > 1000


@pytest.mark.parametrize("source, want", [("foo|bar", {"foo", "bar"}), (r"a(bc|de)f", {"abcf", "adef"}), ("x*", None), (r"\d+", None), ("(abc)?def", {"def"}), ("ab", None)])
def test_factors(source, want):
    assert patternindex.factors(source) == (None if want is None else frozenset(want))


def test_equals_the_other_forms(spark):
    rules = [catalog.parse({"id": f"r{k}", "languages": ["python"] if k % 4 == 0 else [], "patterns": [{"type": "regex", "pattern": p, "where": [{"not-test-file": k % 3 == 0}]}]}, k) for k, p in enumerate(PATTERNS) if "(?=" not in p]
    patterns = match.plan(rules)
    rng = random.Random(5)
    texts = ["", None, "user_éclair PASSWORD = 12 xabc", *[" ".join(rng.choice(["password =", "foo", "aaabcd", "Secret", "x", "9", "def", "user_b", "éclair"]) for _ in range(6)) for _ in range(60)]]
    rows = [("a.py" if k % 2 else "b_test.js", "python" if k % 2 else "javascript", k % 5 == 0, k, t) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "path string, language string, is_test_file boolean, line_no int, text string")
    key = lambda r: (r.line_no, r.k)
    got = sorted(patternindex.indexed(lines, patterns).collect(), key=key)
    want = sorted(match.fused(lines, patterns).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) > 100
    assert patternindex.indexed(lines, []).collect() == [] and patternindex.indexed(lines.where("false"), patterns).collect() == []


def test_large_packs_go_through_the_index(spark):
    found = match.findings(queries.lines(spark, "/root/testdata/sf0.001"), queries.pack(match.MOST_FUSED + 40))
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and {r.rule_id for r in found.select("rule_id").collect()} <= {i for i, _ in queries._pack()}
