import random
import re

import pytest
from pyspark.sql import functions as F
from siftwork.llm import mixing


def water_fill(sizes, weights, total):
    """Targets by hand: raise all by weight, stop at caps, reshare."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weights[s]}
        if not full:
            for s in open_:
                target[s] = level * weights[s]
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    rows = []
    for k in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "é", "zz", None])
        rows.append((k, source, " ".join("w" for _ in range(rng.randint(0, 400)))))
    return rows + [(1000, "tiny", "only three words"), (1001, "void", ""), (1002, "void", None)] + [(1, "a", "x y z")] * 3


def test_targets_and_taken(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()))
    source_of = {(d, size(t)): s for d, s, t in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK, s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 4000)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    out = mixing.mix(df, ["source"]).groupBy("_keep_source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= 4 * mixing.BLOCK, r


def test_sainte_lague_gives_highest_quotients(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 50, 333):
        votes = [rng.choice([0.0, rng.random() * 10, rng.random() * 1000]) for _ in range(12)]
        most = [rng.randint(0, 100) for _ in votes]
        df = spark.createDataFrame([(0, k, v, seats, m) for k, (v, m) in enumerate(zip(votes, most))], "g int, tie int, votes double, seats long, most long")
        got = {r.tie: r.quota for r in mixing.sainte_lague(df, ["g"], "votes", "seats", "most").collect()}
        ranked = sorted(((-v / (2 * q + 1), k, q) for k, v in enumerate(votes) if v > 0 for q in range(most[k])))[:seats]
        assert got == {k: sum(1 for _, s, _ in ranked if s == k) for k in range(12)}


@pytest.mark.parametrize("few", [0, 1000])
def test_sainte_lague_is_exact_for_uneven_votes(spark, monkeypatch, few):
    """Votes that differ by powers of ten, equal votes, limits that most rows reach."""
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(11)
    cases = [([10.0**k for k in range(12)], [5] * 12, 50), ([10.0**k for k in range(8)], [5] * 8, 30), ([7.0] * 40, [3] * 40, 61), ([1.0, 1e15, 3.0, 0.0], [2, 9, 2, 9], 12), ([2.0, 4.0], [0, 0], 5)]
    cases += [([10.0 ** rng.uniform(-3, 9) for _ in range(15)], [rng.randint(0, 12) for _ in range(15)], rng.randint(0, 120)) for _ in range(8)]
    rows = [(str(g) if g else None, k, v, seats, m) for g, (votes, most, seats) in enumerate(cases) for k, (v, m) in enumerate(zip(votes, most))]
    got = {}
    for r in mixing.sainte_lague(spark.createDataFrame(rows, "g string, tie int, votes double, seats long, most long"), ["g"], "votes", "seats", "most").collect():
        got.setdefault(int(r.g or 0), {})[r.tie] = r.quota
    for g, (votes, most, seats) in enumerate(cases):
        ranked = sorted(((-v / (2 * q + 1), k, q) for k, v in enumerate(votes) if v > 0 for q in range(most[k])))[:seats]
        assert got[g] == {k: sum(1 for _, s, _ in ranked if s == k) for k in range(len(votes))}, g


def test_rows_that_fill_all_their_seats_lose_none(spark):
    """Limits at which dividing a quotient into its votes rounds down: every seat is given."""
    rng = random.Random(5)
    votes = [15044.0, *[float(rng.randint(1, 10**6)) for _ in range(150)]]
    most = [1880, *[rng.randint(1, 3000) for _ in votes[1:]]]
    rows = [(k, 0, v, 10**9, m) for k, (v, m) in enumerate(zip(votes, most))] + [(-1, k, v, sum(most[:40]) - 1, m) for k, (v, m) in enumerate(zip(votes[:40], most))]
    got = {(r.g, r.tie): r.quota for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, tie int, votes double, seats long, most long"), ["g"], "votes", "seats", "most").collect()}
    assert [got[k, 0] for k in range(len(votes))] == most
    assert sum(got[-1, k] for k in range(40)) == sum(most[:40]) - 1


def test_many_seats_take_one_turn(spark, monkeypatch):
    """Each turn is a plan and jobs of the driver's: votes alone tell nearly where the line is, however many seats there are."""
    stash, written = mixing._common.stash, []
    monkeypatch.setattr(mixing._common, "stash", lambda df: written.append(df) or stash(df))
    rng = random.Random(8)
    votes = [float(rng.randint(1, 10**6)) for _ in range(60)]
    seats = int(sum(votes)) // 16
    df = spark.createDataFrame([(k % 3, k, v, seats // 4, int(v) // 8) for k, v in enumerate(votes)], "g int, tie int, votes double, seats long, most long")
    got = {r.tie: r.quota for r in mixing.sainte_lague(df, ["g"], "votes", "seats", "most").collect()}
    for g in range(3):
        own = range(g, 60, 3)
        assert sum(got[k] for k in own) == min(seats // 4, sum(int(votes[k]) // 8 for k in own))
        # No seat would be better placed: the least quotient that won is no less than the largest that did not.
        assert min(votes[k] / (2 * got[k] - 1) for k in own if got[k]) >= max(votes[k] / (2 * got[k] + 1) for k in own if got[k] < int(votes[k]) // 8)
    assert len(written) <= 3


def test_mixed_rows(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()}
    assert sum(r.doc_id == 3 for r in rows) == 1


def test_odd_and_empty(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
