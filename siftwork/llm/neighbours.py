"""Approximate nearest neighbours by largest inner product: a permutation index over pivots.

Equal vectors are folded into one, told by its smallest vec_id, with its members; only the `k` + 1 smallest of them can be
among a query's nearest. A vector is the order of its `LENGTH` nearest pivots, and is posted to the inverted files of
its first `POSTS`. A query reads the files of its own `PROBES` nearest pivots, and meets each vector in the first file
that the two share. There Spearman's footrule on the truncated permutations ranks what is posted; what is as near as the
nearest `SHARE` of the query's posted vectors (no fewer than `FEWEST`), which a sample tells beforehand as a radius for
each query, is ranked anew by the exact inner product in double precision. Files are split by hash into parts of bounded
size, and queries into blocks, so that a task holds one of each. Queries that find fewer than `k` go through all files.

Pivots and sample are the rows with the least hashes; every row is indexed. For inner products with vectors of other
lengths than one, vectors gain a component that makes them as long as the longest, and queries a zero.

Defined results: vectors that are null, zero, of another dimension than most, or hold null or non-finite components
take no part; rows with a null vec_id take no part; of rows with one vec_id the least vector counts; ties go to the
smaller vec_id; a query with fewer candidates gets them all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common

#: Pivots: the square root of the vectors' number, within these bounds.
FEWEST_PIVOTS, MOST_PIVOTS = 16, 256
LENGTH = 32
POSTS, PROBES = 4, 40
SHARE = 0.5
FEWEST = 400
#: Vectors that a query's radius is told by.
SAMPLE = 2000
#: Vectors in a part of a file and queries in a block, on average.
PART, BLOCK = 8192, 4096

FOUND = "query_rep long, rep long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = whole.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))
    fine = fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most = fine.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return fine.where(F.size("embedding") == (most["n"] if most else 0))


def permutations(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """The numbers of all pivots of each row, nearest first."""
    return np.argsort(-(x @ pivots.T + np.outer(extra, pivot_extra)), axis=1, kind="stable").astype(np.int16)


def agreement(order: np.ndarray, perms: np.ndarray, n_pivots: int) -> np.ndarray:
    """How far each row of `perms` agrees with the beginning of `order`: the footrule, less what any two have in common.

    A pivot that both hold counts by the length less the larger of its two places.
    """
    length = perms.shape[1]
    place = np.full(n_pivots, length, dtype=np.int16)
    place[order[:length]] = np.arange(length, dtype=np.int16)
    return (length - np.maximum(place[perms], np.arange(length, dtype=np.int16))).sum(axis=1, dtype=np.int32)


def shared_rank(order: np.ndarray, posts: np.ndarray, n_pivots: int, probes: int) -> np.ndarray:
    """The place among the query's probes of the first file that it shares with each row of `posts`; `probes` if none."""
    rank = np.full(n_pivots, probes, dtype=np.int16)
    rank[order[:probes]] = np.arange(min(probes, len(order)), dtype=np.int16)
    return rank[posts].min(axis=1)


def search_part(vec: pd.DataFrame, query: pd.DataFrame, k: int, n_pivots: int, probes: int) -> pd.DataFrame:
    """The k best of one part of a file for each query of one block."""
    reps = vec["rep"].to_numpy()
    x, perm = np.stack(vec["embedding"].to_numpy()), np.stack(vec["perm"].to_numpy())
    posts = perm[:, :POSTS]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rep, q, order, at, radius in zip(query["rep"], query["embedding"], query["perm"], query["at"], query["radius"]):
        near = np.flatnonzero(shared_rank(order, posts, n_pivots, probes) == at)
        near = near[agreement(order, perm[near], n_pivots) >= radius]
        score = x[near] @ q
        best = np.lexsort((reps[near], -score))[:k]
        out.append((np.full(len(best), rep), reps[near][best], score[best]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pd.DataFrame({"query_rep": cols[0], "rep": cols[1], "score": cols[2]}).astype({"query_rep": "int64", "rep": "int64", "score": "float64"})


def top(found: DataFrame, key: str, of: str, k: int) -> DataFrame:
    """The k rows with the largest score for each `key`, ties to the smaller `of`, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), of)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, every: int, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose vec_id is divisible by `every`."""
    spark = rows.sparkSession
    vectors = _common.stash(usable(rows))
    longest = vectors.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = vectors.withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    reps = _common.stash(members.select(F.get("members", F.lit(0)).alias("rep"), "embedding", "members"))
    asked = _common.stash(vectors.where(F.col("vec_id") % every == 0).join(reps.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query_rep")))
    total = reps.count()
    n_pivots = min(total, max(FEWEST_PIVOTS, min(MOST_PIVOTS, isqrt(total))))
    chosen = np.array([r["embedding"] for r in reps.orderBy(F.xxhash64("rep", F.lit(17)), "rep").limit(max(SAMPLE, n_pivots)).collect()])
    rest = lambda x: np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))
    pivots, pivot_extra = chosen[:n_pivots], rest(chosen[:n_pivots])
    length, probes = min(LENGTH, n_pivots), min(PROBES, n_pivots)
    sample = permutations(chosen, rest(chosen), pivots, pivot_extra)[:, :length]
    share = min(1.0, max(SHARE, FEWEST / total))

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("embedding").flatten().to_numpy().reshape(len(batch), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = rows_of(batch)
                perm = permutations(x, rest(x), pivots, pivot_extra)[:, :length]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("embedding"), pa.array(list(perm), pa.list_(pa.int16()))], names=["rep", "embedding", "perm"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = rows_of(batch)
                perm = permutations(x, np.zeros(len(x)), pivots, pivot_extra)
                radius = []
                for order in perm:
                    agree = agreement(order, sample[shared_rank(order, sample[:, :POSTS], n_pivots, probes) < probes], n_pivots)
                    radius.append(int(np.quantile(agree, 1 - share)) if len(agree) else 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("embedding"), pa.array(list(perm), pa.list_(pa.int16())), pa.array(radius, pa.int32())], names=["rep", "embedding", "perm", "radius"]
                )

    indexed = _common.stash(reps.select("rep", "embedding").mapInArrow(index, "rep long, embedding array<double>, perm array<smallint>"))
    queries = asked.select(F.col("query_rep").alias("rep")).distinct().join(reps.select("rep", "embedding"), "rep")
    queries = _common.stash(queries.mapInArrow(ask, "rep long, embedding array<double>, perm array<smallint>, radius int"))
    posted = indexed.select("rep", "embedding", "perm", F.explode(F.slice("perm", 1, POSTS)).alias("pivot"))

    def search(some: DataFrame, probes: int) -> DataFrame:
        sent = some.select("rep", "embedding", "perm", "radius", F.posexplode(F.slice("perm", 1, probes)).alias("at", "pivot"))
        # At most as many rows as there are pivots come to the driver.
        size = lambda df, most: {r["pivot"]: -(-r["n"] // most) for r in df.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        parts, blocks = size(posted, PART), size(sent, BLOCK)
        number = lambda of: F.get(F.array(*[F.lit(of.get(p, 0)) for p in range(n_pivots)]), F.col("pivot"))
        to = lambda of: F.explode(F.expr("sequence(0, n - 1)")).alias(of)
        own = posted.withColumns({"n": number(blocks), "part": F.pmod(F.xxhash64("rep"), number(parts)).cast("int")}).where("n > 0").select("rep", "embedding", "perm", "pivot", "part", to("block"))
        sent = sent.withColumns({"n": number(parts), "block": F.pmod(F.xxhash64("rep", F.lit(3)), number(blocks)).cast("int")}).where("n > 0").select("rep", "embedding", "perm", "radius", "at", "pivot", "block", to("part"))

        def run(vec: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
            if vec.empty or query.empty:
                return pd.DataFrame({"query_rep": [], "rep": [], "score": []}).astype({"query_rep": "int64", "rep": "int64", "score": "float64"})
            return search_part(vec, query, k + 1, n_pivots, probes)

        keys = ("pivot", "part", "block")
        return own.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, FOUND)

    found = _common.stash(top(search(queries, probes), "query_rep", "rep", k + 1).drop("rank"))
    enough = found.groupBy("query_rep").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, total)).select(F.col("query_rep").alias("rep"))
    short = _common.stash(queries.join(enough, "rep", "left_anti").withColumn("radius", F.lit(0)))
    if not short.isEmpty():
        more = top(search(short, n_pivots), "query_rep", "rep", k + 1).drop("rank")
        found = found.join(short.select(F.col("rep").alias("query_rep")), "query_rep", "left_anti").unionByName(more)
    each = found.join(reps.select("rep", "members"), "rep").select("query_rep", F.explode("members").alias("vec_id"), "score")
    each = top(each, "query_rep", "vec_id", k + 1).drop("rank")
    out = asked.join(each, "query_rep").where("vec_id <> query_id")
    return top(out, "query_id", "vec_id", k).select("query_id", "rank", "vec_id", "score")
