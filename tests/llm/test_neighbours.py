import numpy as np
from siftwork.llm import neighbours


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype("float32") * rng.uniform(0.5, 2.0, size=(3000, 1)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, score int")
    found = neighbours.nearest(df, every=100, k=10).collect()
    y = x.astype("float64")
    hits = 0
    for q in range(0, 3000, 100):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(np.isclose(r.score, y[q] @ y[r.vec_id], rtol=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        s = y @ y[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in own} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 300


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, 20, 20).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 8, 1.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(df.where("false"), 20, 20).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0"), 20, 20).collect() == []


def test_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    monkeypatch.setattr(neighbours, "FEWEST", 700)
    monkeypatch.setattr(neighbours, "PROBES", 100)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.rank): r.vec_id for r in neighbours.nearest(df, 10, 5).collect()}
    for q in range(0, 700, 10):
        s = x @ x[q]
        s[q] = -np.inf
        assert [found[q, r] for r in range(1, 6)] == np.argsort(-s)[:5].tolist()


def brute(ids, x, every, k):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            s = [(-float(np.dot(w, v)), int(j)) for j, w in zip(ids, x) if j != i]
            out[int(i)] = [j for _, j in sorted(s)[:k]]
    return out


def test_hot_vector_and_ties(spark):
    """One vector in a third of the rows; ties go to the smaller vec_id, at the cut too."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(900, 6)).astype(float)
    x[x.any(axis=1) == 0] = 1.0
    x[rng.permutation(900)[:300]] = [1.0, 2.0, -1.0, 0.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(range(900), x, 20, 7)
    found = {}
    for r in neighbours.nearest(df, 20, 7).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = sum(len(set(want[q]) & set(found[q].values())) for q in want)
    assert all(sorted(r) == list(range(1, 8)) for r in found.values()) and set(found) == set(want)
    assert hits >= 0.9 * 7 * len(want)


def test_lonely_queries_find_k(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PROBES", 1)
    monkeypatch.setattr(neighbours, "POSTS", 1)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, 10, 40).collect()
    assert len(found) == 30 * 40


def test_recall_on_the_table(spark):
    """The query itself, on its whole table, against brute force."""
    from siftwork.llm import queries

    at = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hits = total = 0
    got = {}
    for r in queries.op9_nearest_neighbours(spark, at).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        total += 20
    assert hits >= 0.9 * total
