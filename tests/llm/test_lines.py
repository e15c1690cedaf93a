import random

import pytest
from siftwork.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, s, n, letters):
    s = list(s)
    for _ in range(n):
        k, kind = rng.randint(0, len(s)), rng.random()
        if kind < 0.4:
            s.insert(k, rng.choice(letters))
        elif s:
            s[max(k - 1, 0) : max(k, 1)] = [] if kind < 0.7 else [rng.choice(letters)]
    return "".join(s)


def test_bit_parallel_distance(spark):
    rng = random.Random(1)
    rows = []
    for n in range(500):
        a = "".join(rng.choices("abcé😀" if n % 3 else "ab", k=rng.randint(0, 14)))
        rows.append((n, a, mutate(rng, a, rng.randint(0, 4), "abz😀")))
    got = {r.n for r in lines.within(spark.createDataFrame(rows, "n int, x string, y string")).collect()}
    assert got == {n for n, a, b in rows if distance(a, b) <= lines.TAU}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(14, 60))).strip() for _ in range(60)]
    pool = base + [mutate(rng, rng.choice(base), rng.randint(1, 4), "abcé") for _ in range(120)] + ["short", "short", "", "  "]
    return [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for k in range(120)]


def limit(size):
    return max((tau for least, tau in lines.TAUS if size >= least), default=0)


def brute(texts):
    """Root (doc, line) of every line that is not blank, and number of links."""
    first = {}
    for doc, text in texts:
        for nr, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (doc, nr))
    every = sorted(first, key=first.get)
    root = {x: x for x in every}
    links = dict.fromkeys(every, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(every):
        for b in every[:i]:
            if distance(a, b) <= limit(min(len(a), len(b))):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=first.get)
                root[y] = x
    return {x: (first[find(x)], links[x]) for x in every}


def test_classes_equal_brute_force(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts)
    assert sum(n for _, n in want.values()) > 20
    for r in lines.line_classes(df).collect():
        line = dict(texts)[r.doc_id].split("\n")[r.nr]
        expected = want[line] if line.strip(" ") else ((r.doc_id, r.nr), 0)
        assert ((r.root.doc_id, r.root.nr), r.links) == expected, line


def test_dedup_keeps_first_lines(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute(texts)
    out = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for doc, text in texts:
        kept = [x for nr, x in enumerate(text.split("\n")) if not x.strip(" ") or want[x][0] == (doc, nr)]
        assert out.get(doc) == ("\n".join(kept) if kept else None)


def test_odd_rows(spark, odd):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    # The second document repeats the first; repeated rows stay both.
    assert ids == [-1, -1, 1, 1, 3, 4, 5, 6, 7, 8]
    assert {r.doc_id: r.text for r in rows}[3] is None and {r.doc_id: r.text for r in rows}[4] == ""


def test_summary_has_a_row_for_each_row(spark, texts):
    want = brute(texts)
    rows = [*texts, (0, texts[5][1]), (0, texts[5][1]), (200, None), (None, "a line without an id, first"), (None, "another line without an id")]
    out = lines.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for doc, text in texts[1:]:
        own = text.split("\n")
        assert (by_id[doc].n_lines, by_id[doc].n_links) == (len(own), sum(want[x][1] for x in own if x.strip(" ")))
    assert (by_id[200].n_lines, by_id[200].n_kept, by_id[200].classes) == (0, 0, [])
    assert [(r.n_lines, r.n_kept, r.n_links) for r in out if r.doc_id is None] == [(1, 1, 0), (1, 1, 0)]
    again = [r for r in out if r.doc_id == 0]
    assert len(again) == 3 and len({str(r) for r in again}) == 2


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(0, "shared line here"), (1, "a line of its own"), (1, "shared line here"), (None, "x one"), (None, "y two\nshared line here"), (None, None)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [
        (False, 1, "a line of its own"), (True, 0, ""), (True, 0, "x one"), (True, 0, "y two\nshared line here")
    ]


def test_empty(spark, none):
    assert lines.dedup_lines(none).collect() == [] and lines.line_classes(none).collect() == [] and lines.summary(none).collect() == []
