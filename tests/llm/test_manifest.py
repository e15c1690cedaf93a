import hashlib
import re
import zlib

import duckdb
import pytest
from siftwork.llm import manifest, queries


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """Root and each leaf's siblings, level by level, as (left, right)."""
    level, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 16 * 16
            paths[k].append((level[first:i], level[i + 1 : first + 16]))
        at = [i // 16 for i in at]
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0] if level else None, paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        of = sorted(((r, leaf(r, r.text)) for r in by_source[s]), key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        trees[s] = (of, *tree([d for _, d in of]))
    root, tops = tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        of, subroot, paths = trees[s]
        for (r, own), path in zip(of, paths):
            digest = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                digest = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            seen = []
            for left, right in path + top:
                digest = h(*left, digest, *right)
                seen += left + right
            out.append((r.doc_id, own, subroot, root, h(*seen), digest, digest == root))
    return out


key = lambda r: tuple(map(str, r))


def test_odd_rows(spark, odd, none):
    assert sorted(map(tuple, manifest.manifest(odd).collect()), key=key) == sorted(brute(odd.collect()), key=key)
    assert manifest.manifest(none).collect() == []


@pytest.mark.parametrize("sizes", [(1,), (16, 17, 1), (300, 257, 33, 2)])
def test_sizes_of_groups(spark, monkeypatch, sizes):
    monkeypatch.setattr(manifest, "RANGE", 40)
    rows = [(k * 7 % 1009, f"Text {k}", "en", None if s == 2 else f"s{s}", k) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.manifest(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs.collect()), key=key)
    assert {r.verified for r in got} == {zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in got}


def test_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    got = queries.op13_merkle_manifest(spark, at)
    found = c.sql(queries.ORACLE_SQL["op13_merkle_manifest"])
    assert found.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_paths_are_not_dealt_again(spark, odd, monkeypatch):
    monkeypatch.setattr(manifest, "GROUP", 2)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = manifest.manifest(odd)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    # Leaves, nodes and paths from above are dealt by group; the leaves' own paths never by their place.
    assert "hashpartitioning(tree" in plan
    assert not re.search(r"hashpartitioning\(tree#\d+L?, i#", plan)
