"""Periodic runs of words: a harmonic grid of positions, prefix hashes, and longest common extensions by binary search.

A run of period p spans two periods at least, so one of its words that stand on a grid of step p recurs p words later.
All pairs (period, grid point) of a text, of which there are about n log n, are made at once; those whose two words
differ fall out, and from the rest the longest common extensions to both sides are found by binary search over prefix
hashes, for all pairs in step. Extensions that span enough are runs: each is kept once, with its smallest period (a
stretch of two periods or more whose smallest period is less is periodic in that too), and its words are compared to
the end; where hashes deceived, its extent is found by comparing words.

Periods below 6 have runs of 12 words, so their grids are wider: 12 - p.

Defined results: a null text has no words and no runs, and digests of nothing; repeated rows are looked at each; a null
doc_id changes no word; texts of any length are searched whole, in blocks of periods; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common

#: Words of a run at least, and periods it spans at least.
LEAST, SPANS = 12, 2
#: A prime below 2**31 and a base, so that products stay within 64 bits.
PRIME, BASE = 2147483647, 1000003
#: Words up to which pairs are kept from text to text, and pairs made at a time beyond.
KEPT, BLOCK = 1 << 15, 1 << 21

_U = np.uint64


def grid(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods for the periods first to last in n words: every pair of a point and the word a period later."""
    points, periods = [], []
    for p in range(first, last + 1):
        at = np.arange(0, n - p, max(p, LEAST - p), dtype=np.int32)
        points.append(at)
        periods.append(np.full(len(at), p, dtype=np.int32))
    none = np.zeros(0, dtype=np.int32)
    return np.concatenate([none, *points]), np.concatenate([none, *periods])


@cache
def _pairs(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs for texts of up to `size` words by where their second word stands, and how many lie before each word."""
    at, p = grid(1, size // SPANS, size)
    order = np.argsort(at + p, kind="stable")
    at, p = at[order], p[order]
    return at, p, np.searchsorted(at + p, np.arange(size + 1))


def pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid points, periods) of n words, in blocks."""
    if n <= KEPT:
        at, p, before = _pairs(max(64, 1 << (n - 1).bit_length()))
        at, p = at[: before[n]], p[: before[n]]
        yield at, p
        return
    first = 1
    while first <= n // SPANS:
        last = first
        made = n // max(first, LEAST - first) + 1
        while last < n // SPANS and made < BLOCK:
            last += 1
            made += n // max(last, LEAST - last) + 1
        yield grid(first, last, n)
        first = last + 1


@cache
def _powers(size: int) -> np.ndarray:
    out = np.ones(size, dtype=_U)
    filled = 1
    while filled < size:
        more = min(filled, size - filled)
        out[filled : filled + more] = out[:more] * _U(pow(BASE, filled, PRIME)) % _U(PRIME)
        filled += more
    return out


def extend(hashes: np.ndarray, powers: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """For each pair, words that are alike from i and j on (or before them, excluded), `most` at most: a binary search in step."""
    low, high = np.zeros(len(i), dtype=np.int64), most.astype(np.int64)
    shift = powers[j - i]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        a, b = i[open_], j[open_]
        if not forward:
            a, b = a - mid, b - mid
        x = (hashes[a + mid] + _U(PRIME) - hashes[a]) * shift[open_] % _U(PRIME)
        y = (hashes[b + mid] + _U(PRIME) - hashes[b]) % _U(PRIME)
        same = x == y
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def exact(ids: np.ndarray, start: int, end: int, p: int) -> list[tuple[int, int]]:
    """Maximal stretches of period p that lie in or about [start, end), by comparing words."""
    same = ids[:-p] == ids[p:]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return [(int(s), int(e) + p) for s, e in zip(edge[::2], edge[1::2]) if e + p > start and s < end]


def runs(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of the words `ids` (numbers, equal for equal words), by start, then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    if n < LEAST:
        return np.zeros((0, 3), dtype=np.int64)
    powers = _powers(max(64, 1 << n.bit_length()))
    hashes = np.zeros(n + 1, dtype=_U)
    np.cumsum((ids.astype(_U) + _U(1)) * powers[:n] % _U(PRIME), out=hashes[1:])
    hashes %= _U(PRIME)
    for at, p in pairs(n):
        # A text's own periods end at half its words.
        hit = np.flatnonzero((ids[at] == ids[at + p]) & (p <= n // SPANS))
        i, q = at[hit].astype(np.int64), p[hit].astype(np.int64)
        j = i + q
        after = extend(hashes, powers, i, j, n - j, True)
        before = extend(hashes, powers, i, j, i, False)
        start, end = i - before, j + after
        good = end - start >= np.maximum(LEAST, SPANS * q)
        for s, e, k in sorted(set(zip(start[good].tolist(), end[good].tolist(), q[good].tolist())), key=lambda r: r[2]):
            if (s, e) in found:
                continue
            if np.array_equal(ids[s : e - k], ids[s + k : e]):
                found[s, e] = k
            else:
                for s, e in exact(ids, s, e, k):  # noqa: PLW2901
                    if e - s >= max(LEAST, SPANS * k):
                        found[s, e] = min(k, found.get((s, e), k))
    rows = sorted((s, k, e - s) for (s, e), k in found.items())
    return np.array([(s, length, k) for s, k, length in rows], dtype=np.int64).reshape(-1, 3)


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """For each of n words, the original word that stands there: every tenth document, by its id's hash, is made periodic."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


FIELDS = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each of `docs` (doc_id, text): its runs' number, the longest one, and digests of all of them and of what is left
    without repetition. No shuffle; a text is worked on alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode().split()  # bytes split at the ASCII spaces alone
                number: dict[bytes, int] = {}
                at = planted(len(words), doc_id)
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))[at]
                found = runs(ids)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
                if len(found):
                    words = [words[k] for k in at.tolist()]
                    start, length, period = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]))
                    best = (start, length, period, 1000 * length // period)
                    left = collapse(words, found)
                else:
                    best = (None,) * 4
                    left = b" ".join([words[k] for k in at.tolist()])
                rows.append((doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), FIELDS.values())], names=list(FIELDS))

    kinds = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in FIELDS.items())
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, kinds)
