import random
import re

import pyarrow as pa
import pytest
from siftwork.llm import neardup
from siftwork.llm._common import components


def brute(rows, words, threshold):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def edited(rng, text, rate):
    return " ".join(f"edit{rng.random()}" if rng.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies (one of over a hundred), common lines, short texts, and texts alone."""
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", *[f"w{rng.randint(0, 3000)}" for _ in range(3)]])
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    line = text(30)
    for size, rate in ((130, 0.01), (60, 0.03), (8, 0.02), (4, 0.005)):
        origin = text(150)
        rows += [edited(rng, origin, rate) for _ in range(size)]
    origin = text(100)
    rows += [" ".join(origin.split(" ")[: 100 - k]) for k in range(60)]
    rows += [line + " " + text(rng.randint(2, 25)) for _ in range(120)]
    rows += [text(rng.randint(0, 60)) for _ in range(60)]
    rows += [rng.choice(rows) for _ in range(40)] + ["", "two words", "Two  WORDS", "two words more"]
    order = list(enumerate(rows))
    rng.shuffle(order)
    return order


@pytest.mark.parametrize(("words", "threshold"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, corpus, words, threshold):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words, threshold).collect()}
    want = brute(corpus, words, threshold)
    assert len(set(c for _, c in want.values())) < len(want)
    assert found == want


def test_bridge_of_two_cores(spark):
    """Two cores of a very large group hang together by one pair, each of which is linked to a leader of its own core."""
    words = [f"w{k}" for k in range(360)]
    least = dict(zip(words, (int(s[0]) for s in neardup.shingle_sets(pa.array(words), 1))))
    words.sort(key=least.get)
    # The least hashes are those that the bridge shares with one core alone, the next those of all.
    x3, y1, every = words[:6], words[6:12], words[12:100]
    rest = iter(words[100:])
    take = lambda n: [next(rest) for _ in range(n)]
    x3, y1, x1, x2, y2, y3, every = x3 + take(14), y1 + take(14), take(20), take(20), take(20), take(20), every + take(140)
    extra = sorted((f"extra{k}" for k in range(400)), key=lambda w: int(next(neardup.shingle_sets(pa.array([w]), 1))[0]))[-120:]
    rows = [[*every, *x1, *x2, *x3, e] for e in extra[:60]] + [[*every, *y1, *y2, *y3, e] for e in extra[60:]]
    rows += [[*every, *y1, *x2, *x3], [*every, *y1, *y2, *x3]]
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    want = brute(rows, 1, 80)
    assert {c for _, c in want.values()} == {0} and {c for _, c in brute(rows[:-1], 1, 80).values()} == {0, 60}
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and by[2][0].component_id == 1 and not by[2][0].kept
    assert by[3][0].n_shingles == by[4][0].n_shingles == by[5][0].n_shingles == 0
    assert by[3][0].component_id == 3 and by[4][0].kept
    assert all(r.component_id is None and r.kept for r in by[None])


def test_two_texts_of_one_id_join(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_empty(spark, none):
    assert neardup.near_duplicates(none).collect() == []


def test_shingle_sets_read_slices():
    column = pa.array(["zz", None, "A b C d", "", "a  b\tc d"]).slice(1)
    sets = [s.tolist() for s in neardup.shingle_sets(column, 3)]
    assert sets[0] == sets[2] == [] and len(sets[1]) == 2 and sets[1] == sets[3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3), (100, 103)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_few_edges_stay_in_place(spark, monkeypatch):
    """A round over few edges deals out least neighbours and the result, not edges; the same components with and without."""
    from siftwork.llm import _common

    edges = [(k, k + 1) for k in range(0, 40, 1) if k % 10 != 9] + [(100, k) for k in range(50, 90)] + [(7, 7), (3, 4)]
    deals, write = [], _common.stash

    def seen(df):
        deals.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df)

    monkeypatch.setattr(_common, "stash", seen)
    rows = lambda: sorted(map(tuple, _common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    few, in_place = rows(), max(deals)
    monkeypatch.setattr(_common, "MOST_SMALL", 0)
    assert rows() == few and dict(few)[37] == 30 and dict(few)[100] == 50
    assert in_place < max(deals)
