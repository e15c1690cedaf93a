import hashlib
import random

import numpy as np
import pytest
from siftwork.llm import fingerprint as fp


def codes(text):
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choices("abé😀", k=rng.randint(1, 60)))
        a = fp.Prefixes(codes(text))
        for _ in range(20):
            i, j = rng.randrange(len(text)), rng.randrange(len(text))
            n = next((k for k in range(len(text)) if text[i : i + k + 1] != text[j : j + k + 1] or max(i, j) + k + 1 > len(text)), len(text))
            assert a.extension(i, j) == n
            size = rng.randint(0, len(text) - max(i, j))
            assert a.equal(i, j, size) == (text[i : i + size] == text[j : j + size])


def test_likeness():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(400))
    a = fp.fingerprint(text)
    assert str(fp.Print.parse(str(a))) == str(a)
    assert fp.likeness(a, fp.fingerprint(text)) == 1
    other = fp.fingerprint(" ".join(f"x{rng.randint(0, 999)}" for _ in range(400)))
    half = fp.fingerprint(text[: len(text) // 2] + " ".join(f"y{rng.randint(0, 999)}" for _ in range(200)))
    assert fp.likeness(a, other) < 0.1 < 0.3 < fp.likeness(a, half) < 0.8
    empty = fp.fingerprint("")
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, a) == 0


@pytest.mark.parametrize("bucket", [2, 4096])
def test_edited_texts(spark, odd, bucket):
    got = fp.fingerprints(odd, bucket).collect()
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    want = []
    for k, (null, i, t) in enumerate(rows):
        e = fp.edited(t, rows[(k + 1) % len(rows)][2])
        want.append((null, i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1


def test_many_rows_of_one_id_and_single_rows(spark, none):
    df = spark.createDataFrame([(5, f"text {k % 3}") for k in range(50)] + [(9, "last one")], "doc_id long, text string")
    assert len(fp.fingerprints(df, 4).collect()) == 51
    one = fp.fingerprints(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fp.fingerprints(none).collect() == []


def test_large_ids_beside_null_ids(spark):
    """Ids above 2**53 stay whole numbers where a batch holds a null id."""
    rows = [((1 << 60) + 3 * k, f"text {k} of this table") for k in range(40)] + [(None, "no id"), (None, "none either")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = [(i, hashlib.sha256(fp.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert sorted(((r.doc_id or 0, r.edited_sha256) for r in got)) == sorted((i or 0, h) for i, h in want)


def brute_likeness(a, b):
    """As the fingerprints tell it, from the texts: grid cover of common prefix and suffix, or least span hashes."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = fp.fingerprint(a), fp.fingerprint(b)
    step = max(x.step, y.step)
    prefix = suffix = 0
    while prefix + step <= min(len(a), len(b)) and a[: prefix + step] == b[: prefix + step]:
        prefix += step
    while suffix + step <= min(len(a), len(b)) and a[len(a) - suffix - step :] == b[len(b) - suffix - step :]:
        suffix += step
    union = sorted({*x.spans.tolist(), *y.spans.tolist()})[: max(len(x.spans), len(y.spans))]
    both = {*x.spans.tolist()} & {*y.spans.tolist()} & {*union}
    return min(max((prefix + suffix) / max(len(a), len(b)), len(both) / len(union)), 0.999)


def test_likeness_of_the_rows_against_texts(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 120))) for _ in range(30)]
    rows = []
    for k in range(120):
        t = rng.choice(base)
        rows.append((k, t if rng.random() < 0.3 else t[: rng.randint(0, len(t))] + rng.choice(base)[rng.randint(0, 20) :]))
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        assert got[i].near_next == pytest.approx(brute_likeness(t, following))
        assert got[i].near_edited == pytest.approx(brute_likeness(t, fp.edited(t, following)))
