import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from siftwork.llm import periods


def brute(words):
    """(start, length, smallest period) of all runs, by comparing every pair of words."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        t = 0
        while t < n - p:
            s = t
            while t < n - p and words[t] == words[t + p]:
                t += 1
            if t > s and t + p - s >= max(12, 2 * p):
                out.setdefault((s, t + p), p)
            t += 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    """A result row by the contract's words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {k for s, m, p in found for k in range(s + p, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def sample(rng):
    n, letters = rng.randint(0, 80), rng.choice([1, 2, 3, 6])
    ids = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        at, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        ids[at:] = [ids[at + (k - at) % p] if at + (k - at) % p < n else 0 for k in range(at, n)]
    return ids


@pytest.mark.parametrize("kept", [1 << 15, 0])
def test_runs_equal_brute_force(monkeypatch, kept):
    monkeypatch.setattr(periods, "KEPT", kept)
    monkeypatch.setattr(periods, "BLOCK", 60)
    rng = random.Random(kept)
    for _ in range(500):
        ids = sample(rng)
        assert [tuple(r) for r in periods.runs(np.array(ids, dtype=np.int64)).tolist()] == brute(ids), ids


def test_words_decide_where_hashes_deceive(monkeypatch):
    """With a tiny modulus nearly all spans collide: runs are still those of the words."""
    monkeypatch.setattr(periods, "PRIME", 3)
    periods._powers.cache_clear()
    rng = random.Random(8)
    for _ in range(150):
        ids = sample(rng)
        got = {tuple(r) for r in periods.runs(np.array(ids, dtype=np.int64)).tolist()}
        assert got <= set(brute(ids)) and all(p == q for s, m, p in got for t, k, q in brute(ids) if (s, m) == (t, k)), ids
    periods._powers.cache_clear()


def test_rows(spark, odd, none):
    more = spark.createDataFrame([(k, " ".join(f"w{x}" for x in sample(random.Random(k)))) for k in range(150)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    docs = docs.where("length(text) < 5000 OR text IS NULL")
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, periods.periodic_runs(docs).collect()), key=key)
    assert got == sorted((row(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert periods.periodic_runs(none).collect() == []
    text = odd.where("doc_id = 6").first().text
    long = periods.periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert (long.start, long.period) == (1, 7) and long.length > 20_000


def test_query_on_the_table(spark):
    from siftwork.llm import queries

    at = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, at).collect()}
    docs = spark.read.parquet(f"{at}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 4000:
            assert got[d.doc_id] == row(d.doc_id, d.text)
