"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenised, cut where they exceed the sequence length, and the pieces are dealt to buckets of
bounded size. Each bucket is solved on several islands (a row each, so islands run in different tasks), which begin with
different individuals: best-fit decreasing on one, on the others with sizes blurred before sorting. Crossover injects
whole well-filled bins of one parent into the other, drops the bins that now hold duplicates and best-fits the displaced
pieces; an island evolves until generations bring nothing more, or until its bins are as few as the tokens allow. Then the
islands' elites migrate to the next island in a ring, for some rounds, and last to one place, where they cross once more.
The emptiest bins of a bucket are opened again and their pieces meet those of other buckets, level by level, until one
bucket is left: so the rest of a bucket is not lost to a bin of its own.

Defined results: a null text is empty, and an empty text is the closing id alone; repeated rows are packed once
each; an empty table gives an empty result; other columns are ignored. Nothing but over-long documents is cut.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

CAPACITY = 2048
#: Bytes of text that are encoded at a time, unless a text is longer: a call takes some 20 times as much.
AT_ONCE = 1 << 20
#: Pieces in a bucket, on average. Bounds the memory of a task.
BUCKET = 4096
ISLANDS = 3
#: Migrations between islands before the elites meet.
MIGRATIONS = 2
POPULATION = 6
#: Children of a generation, and generations without a better best that end an island's turn.
CHILDREN, PATIENCE = 4, 3
#: One of so many bins of a bucket, the emptiest, are opened for the next level, where so many buckets meet.
MERGED = 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: A point or comma that ends a chunk after other punctuation: both are one run to the tokenizer.
RUN = re.compile(r"[.,](?<=(?:[^\w\s]|_)[.,])(?:\s|$)")


class Encoder:
    """Token ids of texts, by the tokenizer file at `path`.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its chunks
    between spaces and newlines, one after another. A point or comma that ends a chunk is a chunk of its own, unless
    other punctuation stands beside it; texts where that may be so take their chunks whole.

    The distinct chunks of a call are looked up in a sorted table of 64-bit hashes with a check sum, whose entries point
    into one array of ids: some 40 bytes for a chunk. Before a call, a table of over `MOST` chunks or `MOST_IDS` ids goes on
    with those chunks that were met again since it was last cut down, or starts anew if these are over half as many. Unknown
    chunks of letters alone are tokenised many at once: each is one word, which its last id ends.
    """

    MOST, MOST_IDS = 3 << 18, 1 << 22
    TOGETHER = 256
    BLOCK = 1 << 18

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.tok.get_vocab().values()) + 1, dtype=bool)
        self.ends[[k for t, k in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        self.at, self.n, self.again = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
        self.arena, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _cut_down(self) -> None:
        """Keep the chunks that were met again, if they are few enough."""
        kept = np.flatnonzero(self.again)
        size = self.n[kept]
        end = np.cumsum(size, dtype=np.int64)
        if not len(kept) or 2 * len(kept) > self.MOST or 2 * end[-1] > self.MOST_IDS:
            return self._clear()
        self.arena = self.arena[np.repeat(self.at[kept] - (end - size), size) + np.arange(end[-1])]
        self.keys, self.checks, self.n, self.used = self.keys[kept], self.checks[kept], size, len(self.arena)
        self.at, self.again = (end - size).astype(np.uint32), np.zeros(len(kept), dtype=bool)

    def _insert(self, into: np.ndarray, **columns: np.ndarray) -> None:
        """Put entries before those at `into`, column by column, so that one column at a time is held twice."""
        new = into + np.arange(len(into))
        old = np.ones(len(self.keys) + len(into), dtype=bool)
        old[new] = False
        for name, values in columns.items():
            both = np.empty(len(old), dtype=getattr(self, name).dtype)
            both[old], both[new] = getattr(self, name), values
            setattr(self, name, both)

    def _ids(self, texts: list[str], at_once: int) -> Iterator[np.ndarray]:
        # The tokenizer's own results hold far more than the ids, so only a few are held at a time.
        for a in range(0, len(texts), at_once):
            for e in self.tok.encode_batch_fast(texts[a : a + at_once], add_special_tokens=False):
                yield np.asarray(e.ids, dtype=np.uint32)

    def _tokenise(self, chunks: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(chunks)
        alone = [k for k, c in enumerate(chunks) if not c.isalpha()]
        words = [k for k, c in enumerate(chunks) if c.isalpha()]
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group, ids in zip(groups, self._ids(["\n".join([chunks[k] for k in g]) for g in groups], 16)):
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group):  # else lower-casing has split a word
                for k, own in zip(group, np.split(ids, cut[:-1])):
                    out[k] = own
            else:
                alone += group
        for k, own in zip(alone, self._ids([chunks[k] for k in alone], 16 * self.TOGETHER)):
            out[k] = own
        return out

    def _places(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of the distinct `chunks` begin in the arena, and how many there are."""
        key = np.fromiter(map(hash, chunks), np.int64, len(chunks)).view(np.uint64)
        check = np.fromiter([zlib.crc32(c.encode("utf-8", "surrogatepass")) for c in chunks], np.uint32, len(chunks))
        at, n = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int32)
        known = np.zeros(len(chunks), dtype=bool)
        if len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[k] == key) & (self.checks[k] == check)
            k = k[known]
            at[known], n[known], self.again[k] = self.at[k], self.n[k], True
        new = np.flatnonzero(~known)
        if len(new):
            found = self._tokenise([chunks[k] for k in new])
            size = np.fromiter(map(len, found), np.int32, len(found))
            end = self.used + int(size.sum())
            if end > len(self.arena):
                self.arena = np.concatenate([self.arena, np.zeros(max(end - len(self.arena), len(self.arena) // 4), dtype=np.uint32)])
            self.arena[self.used : end] = np.concatenate(found)
            at[new], n[new] = self.used + np.cumsum(size) - size, size
            self.used = end
            new = new[np.argsort(key[new], kind="stable")]
            into = np.searchsorted(self.keys, key[new])
            self._insert(into, checks=check[new], at=at[new], n=n[new], again=np.zeros(len(new), dtype=bool), keys=key[new])
        return at, n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.keys) > self.MOST or self.used > self.MOST_IDS:
            self._cut_down()
        ready = []
        for t in texts:
            # Lower-casing here is the tokenizer's own up to U+00FF, and such letters are their own NFC form.
            if ".," in t or ",." in t or ".." in t or ",," in t or not (t.isascii() or max(t) <= "\xff") or RUN.search(t):
                ready.append(t.replace("\n", " "))
            else:
                ready.append(f"{t.lower()} ".replace("\n", " ").replace(". ", " . ").replace(", ", " , "))
        lists = pc.split_pattern(pa.array(ready, pa.large_string()), " ")
        chunks = lists.flatten().dictionary_encode()
        at, n = self._places(chunks.dictionary.to_pylist())
        which = chunks.indices.to_numpy()
        ids = [np.zeros(0, dtype=np.uint32)]
        for k in range(0, len(which), self.BLOCK):
            own = which[k : k + self.BLOCK]
            size = n[own]
            end = np.cumsum(size, dtype=np.int64)
            ids.append(self.arena[np.repeat(at[own] - (end - size), size) + np.arange(end[-1])])
        flat = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(n[which], dtype=np.int64)])[lists.offsets.to_numpy()]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of at most `capacity` ids of each document: PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in _common.slices(batches, "text", AT_ONCE):
            out: list[tuple] = []
            every = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), every):
                total = len(ids) + 1
                for k, at in enumerate(range(0, total, capacity)):
                    part = ids[at : at + capacity]
                    crc, size = zlib.crc32(part), len(part)
                    if at + capacity >= total:  # the closing id
                        crc, size = zlib.crc32(b"\0\0\0\0", crc), size + 1
                    out.append((doc, k, at, size, crc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# ---- the genetic algorithm; an individual is a list of bins, a bin a list of item numbers ----


def best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """Put `items`, largest first, each into the fullest bin that still takes it; open bins as needed.

    `mask` has a bit for each free space that some bin has, so the tightest fit is its lowest bit from the item's size on.
    """
    free: dict[int, list[int]] = {}
    mask = 0
    for k, b in enumerate(bins):
        f = capacity - sum(size[i] for i in b)
        free.setdefault(f, []).append(k)
        mask |= 1 << f
    for i in sorted(items, key=lambda i: -size[i]):
        s = size[i]
        m = mask >> s
        if m:
            f = s + (m & -m).bit_length() - 1
            k = free[f].pop()
            if not free[f]:
                mask ^= 1 << f
            bins[k].append(i)
        else:
            f, k = capacity, len(bins)
            bins.append([i])
        free.setdefault(f - s, []).append(k)
        mask |= 1 << (f - s)
    return bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then uneven filling, which leaves room to empty a bin later."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of `b` into `a`."""
    full = sorted(b, key=lambda x: -sum(size[i] for i in x))[: max(1, len(b) // 2)]
    put = [x for x in full if rng.random() < 0.5] or full[:1]
    taken = {i for x in put for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    if kept:  # open the emptiest bins too, so that displaced items can be arranged anew
        kept.sort(key=lambda x: -sum(size[i] for i in x))
        for _ in range(min(len(kept), 1 + len(kept) // 20)):
            displaced += kept.pop()
    return best_fit([list(x) for x in put] + [list(x) for x in kept], displaced, size, capacity)


def first_individual(size: list[int], capacity: int, rng: random.Random, exact: bool) -> list[list[int]]:
    """Best-fit decreasing; by sizes blurred by up to a fifth, unless `exact`."""
    items = list(range(len(size)))
    if exact:
        return best_fit([], items, size, capacity)
    blurred = [x * rng.uniform(0.8, 1.0) for x in size]
    bins: list[list[int]] = []
    order = sorted(items, key=lambda i: -blurred[i])
    for a in range(0, len(order), max(1, len(order) // 16)):  # each part by size, parts by blurred sizes
        best_fit(bins, order[a : a + max(1, len(order) // 16)], size, capacity)
    return bins


def evolve(size: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), exact: bool = True) -> list[list[int]]:
    """The best individual once PATIENCE generations have brought nothing better, or the lower bound is met.

    Begins with `elites`, without any with best-fit decreasing (if `exact`), and with blurred individuals. Where best-fit
    decreasing meets the bound, no individual has fewer bins, and every island has it at once.
    """
    rng = random.Random(seed)
    bound = -(-sum(size) // capacity)
    people = [list(x) for x in elites]
    if not people:
        plain = first_individual(size, capacity, rng, True)
        people = [plain] if exact or len(plain) <= bound else []
    if not people or min(map(len, people)) > bound:
        people += [first_individual(size, capacity, rng, False) for _ in range(max(1, POPULATION - len(people)))]
    scored = sorted(((fitness(p, size, capacity), p) for p in people), key=lambda x: x[0], reverse=True)
    idle = 0
    while -scored[0][0][0] > bound and idle < PATIENCE and len(scored) > 1:
        best = scored[0][0]
        for _ in range(CHILDREN):
            i, j = rng.sample(range(len(scored)), 2)
            child = cross(scored[i][1], scored[j][1], size, capacity, rng)
            scored.append((fitness(child, size, capacity), child))
        scored = sorted(scored, key=lambda x: x[0], reverse=True)[:POPULATION]
        idle = idle + 1 if scored[0][0] <= best else 0
    return scored[0][1]


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of each item."""
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(numbers) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        out.setdefault(int(b), []).append(i)
    return list(out.values())


def _solved(sizes: DataFrame, tasks: int, capacity: int, islands: int) -> DataFrame:
    """(bucket, bins): the best bin number of each item of every row of `sizes` (bucket, lengths)."""

    def turn(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for bucket, island, lengths, elites in zip(*(batch.column(c) for c in ("bucket", "island", "lengths", "elites"))):
                    own, bucket, island = lengths.as_py(), bucket.as_py(), island.as_py()
                    best = evolve(own, capacity, 1000 * island + bucket % 997 + 7 * len(elites), [_bins(e.values.to_numpy()) for e in elites.values], island == 0)
                    out.append(_numbers(best, len(own)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("bucket", "island", "lengths")), pa.array(out, pa.list_(pa.int32()))], names=["bucket", "island", "lengths", "bins"]
                )

        return run

    schema = "bucket long, island int, lengths array<int>, bins array<int>"
    # Few bytes but long work: as many tasks as there are islands to run, up to what is asked for.
    deal = lambda df: df.repartition(tasks, "bucket", "island")
    state = sizes.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("elites", F.expr("cast(array() AS array<array<int>>)"))
    state = deal(state).mapInArrow(turn(False), schema)
    for last in [False] * MIGRATIONS + [True]:
        met = state.groupBy("bucket").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list(F.struct("island", "bins"))).alias("all"))
        if last:
            met = met.withColumns({"island": F.lit(0), "elites": F.transform("all", lambda x: x["bins"])})
        else:  # an island keeps its elite and gets its neighbour's
            met = met.withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))
            met = met.withColumn("elites", F.array(F.get("all", F.col("island"))["bins"], F.get("all", (F.col("island") + 1) % islands)["bins"]))
        state = deal(met.select("bucket", "island", "lengths", "elites")).mapInArrow(turn(last), schema)
    return state.select("bucket", "bins")


def pack(found: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET, islands: int = ISLANDS) -> DataFrame:
    """Place pieces (PIECES, written out beforehand) into sequences: adds sequence_id and offset.

    Pieces that fill a sequence alone get one at once. The others are dealt to buckets by a hash of the row and its
    place in the input, so that rows of one document, or repeated rows, do not meet in one bucket. Every level writes its
    buckets and its result out; a level holds one of MERGED of the pieces of the one before.
    """
    spark = found.sparkSession
    out = found.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    names = [c.split()[0] for c in PIECES.split(", ")]
    rest = found.where(F.col("length") < capacity).withColumn("nr", F.monotonically_increasing_id())
    n = max(1, -(-rest.count() // bucket))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nr"), F.lit(n))).drop("nr")
    level = 0
    while True:
        # A bucket's pieces in one row, in an order that does not depend on how they came.
        items = _common.stash(rest.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32"))).alias("items")))
        tasks = max(1, min(n * islands, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), n * islands // 16)))
        best = _solved(items.select("bucket", F.expr("transform(items, x -> cast(x.length AS int))").alias("lengths")), tasks, capacity, islands)
        one = items.join(best, "bucket").select("bucket", F.expr("inline(arrays_zip(items, bins))")).select("bucket", "bins", "items.*")
        # Bins in order of how full they are; places in a bin are running sums over the bucket's pieces.
        gathered = one.groupBy("bucket", "bins").agg(F.sort_array(F.collect_list(F.struct("length", "doc_id", "piece", "start", "ids_crc32"))).alias("own"), F.sum("length").alias("full"))
        counted = gathered.groupBy("bucket").agg(F.count("*").alias("n_bins"), F.sort_array(F.collect_list(F.struct("full", "bins"))).alias("fulls"))
        # The emptiest bins up to a bucket's share are opened.
        line = F.get("fulls", F.ceil(F.col("n_bins") / MERGED).cast("int") - 1)
        marked = gathered.join(counted.select("bucket", line.alias("line")), "bucket").withColumn("again", F.lit(n > 1) & (F.struct("full", "bins") <= F.col("line")) & (F.col("full") < capacity))
        placed = marked.select("bucket", "again", (F.shiftleft(F.lit(level).cast("long"), 56) + F.col("bucket") * (1 << 24) + F.col("bins")).alias("sequence_id"), F.posexplode("own").alias("k", "x"), "own")
        before = F.aggregate(F.slice("own", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
        placed = _common.stash(placed.select(*[F.col(f"x.{c}").alias(c) for c in names], "sequence_id", before.alias("offset"), "bucket", "again"))
        out = out.unionByName(placed.where("NOT again").drop("bucket", "again"))
        if n == 1:
            return out
        rest = placed.where("again").select(*names, F.expr(f"bucket div {MERGED}").alias("bucket"))
        n = -(-n // MERGED)
        level += 1


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(_common.stash(pieces(docs, tokenizer, capacity)), capacity)
