"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo a prime, the polynomial hash of each prefix; the hash of any span is a difference of
two entries, so equality of spans is a comparison of numbers and the longest common extension of two positions is found
by binary search. A fingerprint keeps the whole text's hash under two primes, hashes of prefixes and of suffixes that end
on a grid of positions, and the least span hashes of fixed-length spans at word starts.

The likeness of two fingerprints is 1 if they are equal, else the larger of the share of the longer text that a common
prefix and suffix cover (found by binary search over the grid) and the resemblance estimated from the least span hashes.

Defined results: a null text is empty; empty texts are alike (1) and unlike any other (0). Rows are ordered by doc_id,
then text; null ids come last. Repeated rows follow one another. A single row is its own next. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

#: The two largest primes below 2**31, and a base.
PRIMES = (2147483647, 2147483629)
BASE = 911382323
#: Positions on the grid at most; span hashes kept; code points in a span.
GRID, SKETCH, SPAN = 16, 24, 24
#: Rows of a bucket on average: one sorted run of documents.
BUCKET = 4096
#: Buckets at most, which is what the driver holds of the ids. A bucket is sorted on disk and streamed, so larger ones take
#: longer, not more memory.
MOST_BUCKETS = 100_000

_U = np.uint64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo p, at least n of each."""
    have = _tables.get(p)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (BASE % p, pow(BASE, -1, p)):
            a = np.ones(size, dtype=_U)
            filled = 1
            while filled < size:
                more = min(filled, size - filled)
                a[filled : filled + more] = a[:more] * _U(pow(b, filled, p)) % _U(p)
                filled += more
            out.append(a)
        have = _tables[p] = (out[0], out[1])
    return have


class Prefixes:
    """Prefix hashes of a text's code points modulo p."""

    def __init__(self, codes: np.ndarray, p: int = PRIMES[0]):
        self.p, self.n = p, len(codes)
        up, self.down = powers(p, self.n + 1)
        self.h = np.zeros(self.n + 1, dtype=_U)
        if self.n:
            # Terms are below 2**31, so the sum of 2**33 of them stays within 64 bits.
            np.cumsum((codes.astype(_U) + _U(1)) * up[: self.n] % _U(p), out=self.h[1:])
            self.h %= _U(p)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end), each as if it stood at the text's beginning."""
        return (self.h[end] + _U(self.p) - self.h[start]) % _U(self.p) * self.down[start] % _U(self.p)

    def equal(self, i: int, j: int, n: int, other: Prefixes | None = None) -> bool:
        """Whether n code points from i here and from j there (or here) are the same, but for collisions."""
        at = np.array([i]), np.array([i + n])
        to = np.array([j]), np.array([j + n])
        return bool(self.spans(*at)[0] == (other or self).spans(*to)[0])

    def extension(self, i: int, j: int, other: Prefixes | None = None) -> int:
        """Length of the longest common extension of position i here and j there, by binary search."""
        low, high = 0, min(self.n - i, (other or self).n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, j, mid, other) else (low, mid - 1)
        return low


@dataclass
class Print:
    """A fingerprint: length, whole hash, grid step, hashes of prefixes and suffixes on the grid, least span hashes."""

    n: int
    whole: int
    step: int
    head: np.ndarray
    tail: np.ndarray
    spans: np.ndarray

    def __str__(self) -> str:
        hexes = lambda a: a.astype(">u4").tobytes().hex()
        return f"{self.n:x}.{self.whole:016x}.{self.step:x}.{hexes(self.head)}.{hexes(self.tail)}.{hexes(self.spans)}"

    @classmethod
    def parse(cls, text: str) -> Print:
        n, whole, step, *rest = text.split(".")
        return cls(int(n, 16), int(whole, 16), int(step, 16), *(np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in rest))


def fingerprint(text: str) -> Print:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    a = Prefixes(codes)
    second = 0
    if n:
        up = powers(PRIMES[1], n + 1)[0]
        second = int(((codes.astype(_U) + _U(1)) * up[:n] % _U(PRIMES[1])).sum() % _U(PRIMES[1]))
    step = 1 << max(0, (-(-n // GRID) - 1).bit_length()) if n else 1
    at = np.arange(step, n + 1, step)
    head = a.h[at].astype(np.uint32)
    tail = a.spans(n - at, np.full(len(at), n)).astype(np.uint32)
    # Spans start where a word does; a text shorter than a span is one.
    space = (codes == 32) | (codes == 10)
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if n else np.zeros(0, dtype=np.int64)
    start = start[start <= n - SPAN]
    if n and not len(start):
        start = np.zeros(1, dtype=np.int64)
    found = a.spans(start, np.minimum(start + SPAN, n)) * _U(0x9E3779B97F4A7C15) >> _U(32)
    found = np.unique(found)[:SKETCH] if len(found) <= 4 * SKETCH else np.unique(np.partition(found, 4 * SKETCH)[: 4 * SKETCH])[:SKETCH]
    if len(found) < SKETCH and len(start) > len(found):
        found = np.unique(a.spans(start, np.minimum(start + SPAN, n)) * _U(0x9E3779B97F4A7C15) >> _U(32))[:SKETCH]
    return Print(n, int(a.h[n]) << 32 | second, step, head, tail, found.astype(np.uint32))


def _reach(a: Print, b: Print, x: np.ndarray, y: np.ndarray) -> int:
    """Largest position on the common grid up to which the texts agree, by binary search."""
    step = max(a.step, b.step)
    low, high = 0, min(a.n, b.n) // step
    while low < high:
        mid = (low + high + 1) // 2
        same = x[mid * step // a.step - 1] == y[mid * step // b.step - 1]
        low, high = (mid, high) if same else (low, mid - 1)
    return low * step


def likeness(a: Print, b: Print) -> float:
    """From 0 to 1; 1 only for equal fingerprints."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    cover = (_reach(a, b, a.head, b.head) + _reach(a, b, a.tail, b.tail)) / max(a.n, b.n)
    union = np.union1d(a.spans, b.spans)[: max(len(a.spans), len(b.spans))]
    both = np.intersect1d(np.intersect1d(a.spans, b.spans, assume_unique=True), union, assume_unique=True)
    return float(min(max(cover, len(both) / max(1, len(union))), 0.999))


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as much of the beginning of `following`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt by ranges of doc_id to buckets, each sorted and streamed through once. What follows a bucket's
    last row is the first of the next bucket: of the rows with a bucket's least id, each batch's least text goes to the
    bucket before as well.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    total, nulls = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = min(MOST_BUCKETS, max(1, total // bucket))
    cuts: list[int] = []
    if n > 1:
        at = [k / n for k in range(1, n)]
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * n))).first()[0] or []))
    cuts_of = np.array(cuts, dtype=np.int64)

    def place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: its bucket, its id (0 if it has none), and whether it has none. Ids stay whole numbers."""
        column = batch.column("doc_id")
        null = column.is_null().to_numpy(zero_copy_only=False)
        own = column.fill_null(0).to_numpy()
        return np.where(null, len(cuts_of) + 1, np.searchsorted(cuts_of, own, side="right")).astype(np.int32), own, null

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch)[0]), batch.column("doc_id")], names=["b", "m"])

    least = ids.mapInArrow(buckets, "b int, m long").groupBy("b").agg(F.min("m").alias("m")).orderBy("b").collect()
    # The least id of a bucket goes to the one before as well, the first bucket's to the last.
    ahead_of = {r["m"]: least[k - 1]["b"] for k, r in enumerate(least)}
    heads = np.array(sorted(m for m in ahead_of if m is not None), dtype=np.int64)

    def deals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, i, null = place(batch)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), dtype=bool)), *batch.columns], names=["b", "ahead", "doc_id", "text"])
            is_head = np.isin(i, heads) & ~null | (null if None in ahead_of else False)
            first: dict[int | None, int] = {}  # of each least id the least text of the batch is enough
            texts = batch.column("text")
            for k in np.flatnonzero(is_head):
                key = None if null[k] else int(i[k])
                if key not in first or texts[k].as_py() < texts[first[key]].as_py():
                    first[key] = int(k)
            if first:
                also = batch.take(pa.array(list(first.values()), pa.int64()))
                to = pa.array([ahead_of[key] for key in first], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(first), dtype=bool)), *also.columns], names=["b", "ahead", "doc_id", "text"])

    dealt = docs.mapInArrow(deals, "b int, ahead boolean, doc_id long, text string")
    ordered = dealt.repartition("b").sortWithinPartitions("b", "ahead", F.asc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint) that awaits its next
        for batch in _common.slices(batches, "text"):
            out: list[tuple] = []
            for b, ahead, i, t in zip(*(batch.column(c).to_pylist() for c in ("b", "ahead", "doc_id", "text"))):
                if ahead and (held is None or held[0] != b):
                    continue  # a bucket's last row already has its next
                own = fingerprint(t)
                if held is not None and held[0] == b:
                    e = edited(held[2], t)
                    f = fingerprint(e)
                    sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(held[2]), sha, str(held[3]), str(f), likeness(held[3], f), likeness(held[3], own)))
                held = None if ahead else (b, i, t, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=FIELDS)

    return ordered.mapInArrow(run, ", ".join(f"{a} {k}" for a, k in zip(FIELDS, ("long", "long", "string", "string", "string", "double", "double"))))


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
