"""Near-duplicate documents by bottom-k sketches of word shingles under one hash function.

A document's set holds the 64-bit hashes of its distinct shingles; equal sets are one node. A node's sketch is the
bottom `SKETCH` of its hashes. Inverted lists of retained values (the first `RETAINED` of the sketch that are not in
more than `HOT` sketches) yield overlapping pairs; an estimate from the bottom of the union of two sketches drops pairs
far below the threshold; exact Jaccard over full sets decides. Pairs are confirmed in two rounds: each node with its
most alike candidate and one at random first, then only candidates whose nodes are not connected yet, so that a group of copies costs
about as many confirmations as it has members.

Nodes whose sketch is mostly hot values (members of very large groups) meet through leaders: every hot value names one
for each range of sizes, and a node is described by its difference from the leader's full set. Nodes within the
threshold of their leader are linked to it. A node that is not can, under each such leader, reach another node only if
their differences overlap by a known number, so it meets those that share an element of a prefix of the differences, rare
elements first, with room for that overlap behind it: an exact filter without pairs of a large group's members. First
each is compared with one node for each element of its prefix only, so that the families of such a group hang together
before what is left meets. No list or leader is cut or dropped. A link at the threshold is missed only if all retained
values miss the intersection, which has a chance below 1e-5 for each pair at worst (1e-9 without hot values).

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer words than a shingle is
one shingle; repeated rows and equal texts are one node; a doc_id with several texts joins their components; rows with a
null doc_id link with nothing and are kept, with a null component; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common

SKETCH = 64
RETAINED = 12
#: A value in more sketches than this is hot.
HOT = 40
#: Pairs whose estimate is this far below the threshold go: over six standard deviations of the estimate.
MARGIN = 0.28
#: Rounds of confirmation between the first and the last.
ROUNDS = 1
#: Bytes of text that are hashed at a time, unless a word is longer.
BLOCK = 1 << 17
#: Turns of stars around the elements of prefixes.
TURNS = 1
#: Words of 64 bits of a bitmap of a difference.
WORDS = 16
#: Ids are broadcast up to this many (8 MB), which is checked.
MOST_BROADCAST = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) <= n:
        a = np.full(1 << max(16, int(n).bit_length()), base, dtype=_U)
        a[0] = 1
        with np.errstate(over="ignore"):
            have = _pow[base] = np.cumprod(a, dtype=_U)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of `data`, block by block, so that long texts take no more memory than short ones."""
    out = np.zeros(len(start), dtype=_U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, side="right")))
        own = data[base : end[j - 1]]
        total = np.zeros(len(own) + 1, dtype=_U)
        np.cumsum((own.astype(_U) + _U(1)) * _powers(_BASE, len(own))[: len(own)], out=total[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * _powers(_INV, len(own))[a] + (b - a).astype(_U))
        i = j
    return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text of an Arrow string column, its distinct shingle hashes, sorted. Null gives none."""
    column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    valid = np.asarray(column.is_valid())
    with np.errstate(over="ignore"):
        size = len(data)
        data = _LOWER[data]
        word = np.zeros(size + 1, dtype=bool)
        word[:size] = ~_SPACE[data]
        first = np.zeros(size + 1, dtype=bool)
        first[at] = True
        start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first))
        cut = first[1:] | ~word[1:]  # a word ends where the next byte is space or another text's
        end = np.flatnonzero(word[:size] & cut) + 1
        h = _word_hashes(data, start, end)
        owner = np.searchsorted(start, at)
        rolled = h.copy()
        for k in range(1, words):
            rolled = mix(rolled[: len(h) - k] + h[k:] * _U(2 * k + 1)) if len(h) > k else rolled[:0]
    for i in range(n):
        a, b = owner[i], owner[i + 1]
        if not valid[i] or a == b:
            yield np.zeros(0, dtype=_U)
        elif b - a < words:
            with np.errstate(over="ignore"):
                x = h[a : a + 1]
                for k in range(1, b - a):
                    x = mix(x + h[a + k : a + k + 1] * _U(2 * k + 1))
                yield mix(x + _U(b - a))
        else:
            yield np.unique(rolled[a : b - words + 1])


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k (the set's own hash), n (its size), sketch (its least hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text", 1 << 20):
            keys, sizes, least = [], [], []
            for s in shingle_sets(batch.column("text"), words):
                keys.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(s))
                least.append(s[:SKETCH].view(np.int64))
            ends = np.cumsum([0] + [len(x) for x in least]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(least) if least else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "k", "n", "sketch"])

    return docs.mapInArrow(run, "doc_id long, k long, n long, sketch array<long>")


def estimate(a: str, b: str) -> F.Column:
    """Resemblance of two sets from the bottom of the union of their sketches."""
    return F.expr(
        f"size(array_intersect(array_intersect({a}, {b}), slice(sort_array(array_union({a}, {b})), 1, {SKETCH})))"
        f" / least({SKETCH}, size(array_union({a}, {b})))"
    )


def _full_sets(need: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(k, s) of the nodes `need` (k, id): the full sets as bytes. Only the texts that are needed are read on and move."""
    need = _common.stash(need)
    known = F.broadcast(need) if need.count() <= MOST_BROADCAST else need
    texts = docs.join(known, docs["doc_id"] == known["id"]).select("k", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "text", 1 << 20):
            found = list(shingle_sets(batch.column("text"), words))
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in found]
            same = [a == b for a, b in zip(keys, batch.column("k").to_pylist())]  # a doc_id may have other texts
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, ok in zip(keys, same) if ok], pa.int64()), pa.array([s.tobytes() for s, ok in zip(found, same) if ok], pa.binary())], names=["k", "s"]
            )

    full = _common.stash(texts.mapInArrow(sets, "k long, s binary").dropDuplicates(["k"]))
    _common.unstash(need)
    return full


def _of_ends(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of `ids` (k, id) of the nodes in `pairs`, which `stash` wrote; broadcast where they are few."""
    ends = pairs.select(F.col("ka").alias("k")).union(pairs.select("kb"))
    if 2 * pairs.count() <= _common.MOST_SMALL:
        return ids.join(F.broadcast(ends), "k", "left_semi").select("k", "id")
    return ends.distinct().join(ids, "k").select("k", "id")


def _confirm(pairs: DataFrame, docs: DataFrame, ids: DataFrame, words: int, threshold: int) -> DataFrame:
    """Those of `pairs` (ka, kb) with 100 * intersection >= threshold * union over full sets; `ids` has (k, id) of nodes. `stash` wrote `pairs`."""
    full = _full_sets(_of_ends(ids, pairs), docs, words)
    both = pairs.join(full.toDF("ka", "sa"), "ka").join(full.toDF("kb", "sb"), "kb").select("ka", "kb", "sa", "sb")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["ka", "kb"]).filter(pa.array(ok, pa.bool_()))

    out = _common.stash(both.mapInArrow(decide, "ka long, kb long"))
    _common.unstash(full)
    return out


def _span(size: str, threshold: int) -> F.Column:
    """The range of a size: sizes within the threshold of each other are in one range or in neighbouring ones."""
    return (F.floor(F.log(size) / F.log(F.lit(100 / threshold))) if threshold < 100 else F.col(size)).cast("long")


def _differences(mostly: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """(o, range, k, size, osize, linked, d, bits): nodes by leader, with the elements in which they differ from it.

    `bits` is a bitmap of d: two bitmaps differ in no more bits than the differences do in elements.
    Sizes within the threshold of each other share a range or neighbouring ones, so a node is in its own and the next.
    """
    span = _span("n", threshold)
    rows = mostly.withColumn("range", F.explode(F.array(span, span + 1))).select("k", "id", "range", F.explode("hot").alias("v"))
    leaders = rows.groupBy("v", "range").agg(F.min_by("k", F.xxhash64("k")).alias("o"))
    own = _common.stash(rows.join(leaders, ["v", "range"]).select("k", "id", "o", "range").distinct())
    full = _full_sets(own.select("k", "id").distinct(), docs, words)
    both = own.select("k", "o", "range").join(full, "k").join(full.toDF("o", "so"), "o").select("o", "range", "k", "s", "so")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, leads, links, parts, maps = [], [], [], [], []
            for s, so in zip(batch.column("s"), batch.column("so")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (s, so))
                more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                shared = len(x) - len(more)
                sizes.append(len(x))
                leads.append(len(y))
                links.append(100 * shared >= threshold * (len(x) + len(y) - shared))
                own = np.concatenate([more, mix(less)])  # what is lacking counts as other elements
                parts.append(own.view(np.int64))
                marks = np.zeros(64 * WORDS, dtype=bool)
                marks[own % _U(64 * WORDS)] = True
                maps.append(np.packbits(marks).view(np.int64))
            ends = np.cumsum([0] + [len(d) for d in parts]).astype(np.int32)
            d = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            bits = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64)), WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), batch.column("range"), batch.column("k"), pa.array(sizes, pa.int64()), pa.array(leads, pa.int64()), pa.array(links, pa.bool_()), d, bits],
                names=["o", "range", "k", "size", "osize", "linked", "d", "bits"],
            )

    return both.mapInArrow(differ, "o long, range long, k long, size long, osize long, linked boolean, d array<long>, bits array<long>")


def _prefixes(found: DataFrame, threshold: int) -> DataFrame:
    """A row for each element of a node's prefix, under each leader that some node is not linked to.

    Within the threshold, symmetric differences are at most c times both sizes, and sizes at most 1 / theta apart; so
    differences overlap by at least (da + db - c * (size a + size b)) / 2, and prefixes that are longer by one than what
    may miss the overlap meet. Elements are ordered by how many nodes have them, so those of one node alone, which meet
    nothing, fill most prefixes.

    A node is stray under every leader that it is not linked to. Two nodes of one leader that are both linked to it are
    connected, so every other pair has a stray: nodes of two cores that meet only through each other are found as well.
    """
    theta = threshold / 100
    c = (1 - theta) / (1 + theta)
    found = found.withColumn("nd", F.size("d"))
    strays = _common.stash(found.where("NOT linked").select("o", "range").distinct())
    taken = found.join(strays, ["o", "range"], "left_semi").withColumn("stray", ~F.col("linked"))
    # Nodes of one leader lie together; dealt anew, tasks open about as many elements each. Bitmaps don't travel with elements.
    rows = taken.repartition("k", "o").select("o", "range", "k", "size", "osize", "stray", "nd", F.explode("d").alias("x"))
    ranked = rows.withColumn("df", F.count("*").over(Window.partitionBy("o", "range", "x")))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("o", "range", "k").orderBy("df", "x")))
    least = F.greatest(F.lit(1), F.ceil(F.col("nd") - F.col("size") * (1 - theta) / theta - 1e-9))
    to_stray = F.floor((F.col("nd") + c * (F.col("osize") - F.col("size"))) / 2 - 1e-9) + 1
    ranked = ranked.withColumns({"most": F.col("nd") - least + 1, "partner": F.col("place") <= F.col("nd") - F.greatest(least, to_stray) + 1})
    ranked = ranked.where("df > 1 AND place <= most AND (stray OR partner)").drop("df", "osize", "most")
    return _common.stash(ranked.join(found.select("o", "range", "k", "bits"), ["o", "range", "k"]))


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    own = _common.small(roots).select(F.col("id").alias("k"), F.col("root").alias("r"))
    return rows.join(own, "k", "left").withColumn("r", F.coalesce("r", "k"))


def _apart(a: str, b: str, sizes: str, threshold: int) -> tuple[F.Column, F.Column]:
    """Bits in which two bitmaps differ, and whether they are few enough for the sizes."""
    bits = F.expr(" + ".join(f"bit_count({a.format(w)} ^ {b.format(w)})" for w in range(WORDS)))
    return bits, bits <= (100 - threshold) / (100 + threshold) * F.expr(sizes) + 1e-9


def _stars(prefixes: DataFrame, roots: DataFrame, threshold: int, turn: int) -> DataFrame:
    """Pairs of a node and the nodes that stand for the elements of its prefix: the least alike by bitmap, and one at random.

    The first step to hang a family within a very large group together: as many comparisons as prefixes have elements.
    """
    rows = _with_roots(prefixes, roots)
    centre = rows.where("stray").groupBy("o", "range", "x").agg(F.min_by(F.struct("k", "r", "size", "bits"), F.xxhash64("k", F.lit(turn))).alias("c"))
    differ, close = _apart("bits[{}]", "c.bits[{}]", "size + c.size", threshold)
    near = F.expr(f"r <> c.r AND 100 * least(size, c.size) >= {threshold} * greatest(size, c.size)")
    met = rows.join(centre, ["o", "range", "x"]).where(near & close).select("k", F.least("k", "c.k").alias("ka"), F.greatest("k", "c.k").alias("kb"), differ.alias("differ"))
    best = met.groupBy("k").agg(F.min(F.struct("differ", "ka", "kb")).alias("p"), F.min(F.struct(F.xxhash64("ka", "kb").alias("differ"), "ka", "kb")).alias("q"))
    return best.select(F.explode(F.array(F.struct("p.ka", "p.kb"), F.struct("q.ka", "q.kb"))).alias("p")).select("p.ka", "p.kb").distinct()


def _strays(prefixes: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """Pairs in different components under one leader, one of them not linked to it, whose differences may overlap enough.

    What meets must also have bitmaps that differ in few enough bits, so that little more than the links themselves comes
    out of the join.
    """
    c = (100 - threshold) / (100 + threshold)
    rows = _with_roots(prefixes, roots)
    # Elements that only nodes of one component have join nothing.
    mixed = rows.groupBy("o", "range", "x").agg(F.min("r").alias("r"), F.max("r").alias("s")).where("r <> s").drop("r", "s")
    rows = rows.join(mixed, ["o", "range", "x"], "left_semi")
    # A node's prefixes, in order, travel with their elements: so a pair meets at its first common element alone.
    own = F.struct("place", "x")
    prefixes = _common.stash(rows.groupBy("o", "range", "k", "r", "size", "nd").agg(
        F.first("bits").alias("bits"), F.sort_array(F.collect_list(F.when(F.col("stray"), own))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("partner"), own))).alias("b")
    ))
    side = lambda e: prefixes.select(
        "o", "range", F.col("k").alias(f"k{e}"), F.col("r").alias(f"r{e}"), F.col("size").alias(f"n{e}"), F.col("nd").alias(f"d{e}"),
        *[F.get("bits", F.lit(w)).alias(f"w{e}{w}") for w in range(WORDS)], F.transform(e, lambda m: m["x"]).alias(f"q{e}"), F.explode(e).alias("m"),
    ).select("*", F.col("m.place").alias(f"p{e}"), F.col("m.x").alias("x")).drop("m")
    near = F.expr(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)")
    # A pair meets in the larger of its ranges only.
    one = F.col("range") == F.greatest(_span("na", threshold), _span("nb", threshold))
    # The first common element leaves room for the overlap that the pair needs.
    room = F.expr(f"1 + least(da - pa, db - pb) >= (da + db - {c} * (na + nb)) / 2 - 1e-9")
    _, close = _apart("wa{}", "wb{}", "na + nb", threshold)
    first = F.col("x") == F.get(F.array_intersect("qa", "qb"), F.lit(0))
    # Few rows, but each with a prefix to compare: as many tasks as there are partitions, whatever their bytes.
    tasks = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda e: side(e).repartition(tasks, "o", "range", "x")
    met = dealt("a").join(dealt("b"), ["o", "range", "x"]).where("ra <> rb").where(near & room & one & close & first)
    return met.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))


def _leads(differ: DataFrame) -> DataFrame:
    """Links (ka, kb) that hang nodes together with the leaders they are linked to.

    A node is linked to the least of its leaders (it has 2 * RETAINED at most), and that one to the node's others; the
    links between leaders are told once each, so there are about as many links as nodes.
    """
    own = differ.where("linked AND k <> o").groupBy("k").agg(F.sort_array(F.collect_set("o")).alias("os"))
    chain = own.select(F.get("os", F.lit(0)).alias("ka"), F.explode(F.expr("slice(os, 2, size(os))")).alias("kb")).distinct()
    return own.select(F.col("k").alias("ka"), F.get("os", F.lit(0)).alias("kb")).union(chain)


def _ends(pairs: DataFrame) -> DataFrame:
    """Each pair once for either node, `k`."""
    return pairs.withColumn("k", F.explode(F.array("ka", "kb")))


def _labelled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of `pairs` whose nodes are in different components."""
    own = _common.small(roots)
    return (
        pairs.join(own.toDF("ka", "ra"), "ka", "left").join(own.toDF("kb", "rb"), "kb", "left")
        .where(F.coalesce("ra", "ka") != F.coalesce("rb", "kb")).select("ka", "kb")
    )


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text). `threshold` is in per cent."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _common.stash(sketches(docs, words))
    nodes = _common.stash(
        found.where("n > 0 AND doc_id IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    ids = nodes.select("k", "id")
    low = (threshold - 100 * MARGIN) / 100
    alike = F.expr(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)")

    # Hot values, and each node's own.
    spread = nodes.select("k", F.explode("sketch").alias("v"))
    hot = _common.stash(spread.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("v"))
    if hot.isEmpty():
        marked = nodes.withColumn("hot", F.expr("cast(array() as array<bigint>)"))
    else:
        own = spread.join(_common.small(hot), "v").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("hot"))
        marked = nodes.join(own, "k", "left").withColumn("hot", F.coalesce("hot", F.expr("cast(array() as array<bigint>)")))
        marked = _common.stash(marked)

    # Pairs from lists of retained values.
    kept = marked.select("k", "n", F.explode(F.expr(f"slice(array_except(sketch, hot), 1, {RETAINED})")).alias("v"))
    a, b = kept.toDF("ka", "na", "v"), kept.toDF("kb", "nb", "v")
    pairs = a.join(b, "v").where(F.col("ka") < F.col("kb")).where(alike).select("ka", "kb").distinct()
    s = nodes.select("k", "n", "sketch")
    judged = (
        pairs.join(s.toDF("ka", "na", "sa"), "ka").join(s.toDF("kb", "nb", "sb"), "kb")
        .where(alike).withColumn("est", estimate("sa", "sb")).where(F.col("est") >= low).select("ka", "kb", "est")
    )
    judged = _common.stash(judged)

    # First each node with its most alike and one at random, and members of very large groups with their leaders.
    best = _ends(judged).groupBy("k").agg(
        F.expr("array(max_by(struct(ka, kb), struct(est, xxhash64(ka, kb))), min_by(struct(ka, kb), xxhash64(ka, kb)))").alias("p")
    )
    best = _common.stash(best.select(F.explode("p").alias("p")).select("p.ka", "p.kb").distinct())
    links = _confirm(best, docs, ids, words, threshold)
    differ = None
    if not hot.isEmpty():
        mostly = marked.where("2 * size(hot) > size(sketch)").select("k", "id", "n", F.expr(f"slice(hot, 1, {RETAINED})").alias("hot"))
        differ = _common.stash(_differences(mostly, docs, words, threshold))
        links = links.union(_leads(differ))
    roots = _common.stash(_common.components(links.toDF("a", "b")))
    # What hangs together is from here on a star around its root: later rounds add their links to that.
    star = lambda: roots.where("id <> root").select(F.col("id").alias("ka"), F.col("root").alias("kb"))
    strays = None
    if differ is not None:
        prefixes = _prefixes(differ, threshold)
        for turn in range(TURNS):
            some = _common.stash(_stars(prefixes, roots, threshold, turn))
            if some.isEmpty():
                break
            links = star().union(_confirm(some, docs, ids, words, threshold))
            roots = _common.stash(_common.components(links.toDF("a", "b")))
        strays = _strays(prefixes, roots, threshold)
    links = star()
    rest = _labelled(judged.select("ka", "kb"), roots)
    rest = _common.stash(rest if strays is None else rest.union(strays).distinct())

    # Then round by round one at random of what is not connected yet, and at last all that is left: a group's links are
    # not confirmed once it hangs together.
    for turn in range(ROUNDS + 1):
        if rest.isEmpty():
            break
        last = turn == ROUNDS or rest.count() <= 8 * _ends(rest).select("k").distinct().count()
        some = rest if last else _ends(rest).groupBy("k").agg(F.expr(f"min_by(struct(ka, kb), xxhash64(ka, kb, {turn}))").alias("p")).select("p.ka", "p.kb").distinct()
        some = _common.stash(some)
        links = links.union(_confirm(some, docs, ids, words, threshold))
        if last:
            break
        roots = _common.stash(_common.components(links.toDF("a", "b")))
        links = star()
        rest = _common.stash(_labelled(rest.join(some, ["ka", "kb"], "left_anti"), roots))

    # Components of documents: nodes by their least doc_id, and doc_ids with several texts.
    links = _common.stash(links)
    named = _common.small(_common.stash(_of_ends(ids, links)))
    id_of = lambda c, to: named.toDF(c, to)
    links = links.join(id_of("ka", "a"), "ka").join(id_of("kb", "b"), "kb").select("a", "b")
    members = _common.stash(found.where("doc_id IS NOT NULL").join(ids, "k", "left").select("doc_id", "n", F.coalesce("id", "doc_id").alias("node")))
    twice = members.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    links = links.union(members.join(twice, "doc_id").where("node <> doc_id").select("doc_id", "node"))
    roots = _common.small(_common.stash(_common.components(links)))
    out = members.join(roots.toDF("node", "root"), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id")
    )
    lone = found.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


