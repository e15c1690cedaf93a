import random

from siftwork.operators import blocks


def by_hand(texts):
    """Each `if (` with every later line of its file."""
    net = lambda x: x.count("{") - x.count("}")
    depth = [sum(map(net, texts[: k + 1])) for k in range(len(texts))]
    out = []
    for k, x in enumerate(texts):
        if x.strip().startswith("if ("):
            out.append((k + 1, next((j + 1 for j in range(k + 1, len(texts)) if depth[j] <= depth[k] - net(x)), None)))
    rows = []
    for start, end in out:
        outer = [a for a, b in out if a < start and (b is None or b > start)]
        rows.append((start, end or len(texts), max(outer, default=None), len(outer)))
    return rows


def test_tree_and_branches_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["if (a) {", "if (b)", "}", "} else {", "x()", "  return y", "{", "}}", "if (c) { }", "if (d) }", "clean(z)", "else", ""]
    files = {f"f{k}": [rng.choice(parts) for _ in range(rng.randint(0, 60))] for k in range(60)}
    rows = [(p, k + 1, x) for p, texts in files.items() for k, x in enumerate(texts)]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string")
    got = {}
    for r in blocks.tree(lines).collect():
        got.setdefault(r.path, []).append((r.start, r.end, r.parent, r.nesting))
    assert {p: sorted(v) for p, v in got.items()} == {p: w for p, texts in files.items() if (w := by_hand(texts))}
    seen = {(r.path, r.start): (r.end, r.condition, r.has_else, r.sanitizes) for r in blocks.branches(lines).collect()}
    for p, texts in files.items():
        for start, end, _, _ in by_hand(texts):
            inside = texts[start - 1 : end]
            has_else = any(x.strip().startswith(("else", "} else")) for x in inside)
            cleans = any(w in x.lower() for x in inside for w in blocks.CLEANING + blocks.LEAVING)
            assert seen.pop((p, start)) == (end, texts[start - 1].strip(), has_else, cleans)
    assert not seen
    assert blocks.tree(lines.where("false")).collect() == []


def test_a_long_file_of_nested_branches(spark):
    """30,000 lines, 7,500 blocks one in the other: as many rows as blocks."""
    n = 7_500
    texts = ["if (x) {", "y()"] * n + ["}", "z()"] * n
    lines = spark.createDataFrame([("f", k + 1, x) for k, x in enumerate(texts)], "path string, line_no int, text string")
    rows = sorted(map(tuple, blocks.tree(lines).collect()))
    assert len(rows) == n and rows[0] == ("f", 1, 4 * n - 1, None, 0) and rows[-1] == ("f", 2 * n - 1, 2 * n + 1, 2 * n - 3, n - 1)
