"""Merkle manifest of a dataset: a tree for each source over its rows, one tree over the sources, and a proof for each row.

H is the SHA-256 of its inputs, concatenated, in lowercase hex. A row's leaf is H of its columns, each `-` if null, else
its length in UTF-8 bytes, a colon and its value. `numbered` gives the leaves of each source consecutive indexes: rows
are dealt by ranges of (source, doc_id), sorted, and counted on from range to range, so that no source is ordered in one
task. A tree's level after level is written as a table of nodes (tree, level, index), GROUP consecutive ones making the
next, until every tree has one node left.

Proofs are looked up by coordinates: from a node's index and the number of nodes in its group, `siblings` explodes the
coordinates it needs, joins them with the node table, and puts what it finds in order. Nodes and requests are dealt by
group, and a sibling's place is compared within the group, so requests are never shuffled. The coordinates above a group
are the same for all its nodes and are looked up once for it: paths come down level by level. A row's proof is the
concatenation of its path, and folding hashes its leaf, or a tampered one, with the siblings up to the root.

Defined results: sources sort null first, then by UTF-8 bytes; null ids come first in their source, equal ids by leaf;
repeated rows are leaves of their own; a lone row's leaf is its subroot, a lone source's subroot the root; an empty table
gives an empty result; columns that don't go into a leaf are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common

#: Nodes that make one of the next level.
GROUP = 16
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range of leaves, on average.
RANGE = 1 << 17


def h(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf(columns: dict[str, Column]) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns.values())]
    return h(*parts)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has its A-Z lowered, for rows whose id's CRC-32 is divisible by 5; null for others."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf({c: lowered if c == "text" else docs[c] for c in COLUMNS}))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`rows` with `i`, from 0 in each `tree` by `order`, and `n`, the tree's rows. Written to the shared folder."""
    ranges = max(1, -(-rows.count() // RANGE), min(64, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(ranges, tree, *order).sortWithinPartitions(tree, *order)
    # The number of a range, and the place in it: a range's rows are in order.
    placed = _common.stash(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    parts = placed.groupBy(tree, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(tree).alias("_tree"), F.col("_range").alias("_r"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    out = placed.join(parts, placed[tree].eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_r")))
    return _common.stash(out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("i"), "n"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Node tables (tree, i, n, digest) from the leaves up, each written; a tree that has one node left is in no more of them.

    Leaves keep their other columns.
    """
    out = [_common.stash(leaves)]
    while not out[-1].where("n > 1").isEmpty():
        below = out[-1].where("n > 1").withColumn("g", F.floor(F.col("i") / GROUP))
        up = below.groupBy("tree", "g").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("run"))
        up = up.select("tree", F.col("g").alias("i"), F.ceil(F.col("n") / GROUP).alias("n"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"))
        out.append(_common.stash(up))
    return out


def roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, root)."""
    out = None
    for table in tables:
        one = table.where("n = 1").select("tree", F.col("digest").alias("root"))
        out = one if out is None else out.unionByName(one)
    return out


def siblings(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tree, g, i, before, after): of each node that isn't alone in its tree, the digests of its group's others to its left
    and right, concatenated. Columns `keep`, which a node's place determines, come along."""
    table = nodes.where("n > 1").withColumns({"g": F.floor(F.col("i") / GROUP), "k": (F.col("i") % GROUP).cast("int")}).repartition("tree", "g")
    size = F.least(F.lit(GROUP), F.col("n") - F.col("g") * GROUP).cast("int")
    others = F.filter(F.sequence(F.lit(0), size - 1), lambda x: x != F.col("k"))
    asked = table.select("tree", "g", "i", "k", *keep, F.explode_outer(others).alias("sibling"))
    there = table.select(F.col("tree").alias("_tree"), F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("digest").alias("_digest"))
    # As a difference, the place isn't a key of the join: both sides stay dealt by group. A lone node of a group asks for none.
    met = asked.join(there, (F.col("tree") == F.col("_tree")) & (F.col("g") == F.col("_g")) & (F.col("sibling") - F.col("_k") == 0), "left")
    found = F.sort_array(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "k", F.col("_digest").alias("digest")))))
    side = lambda left: F.array_join(F.transform(F.filter("found", lambda x: (x["_k"] < x["k"]) == F.lit(left)), lambda x: x["digest"]), "")
    return met.groupBy("tree", "g", "i", *keep).agg(found.alias("found")).select("tree", "g", "i", *keep, side(True).alias("before"), side(False).alias("after"))


def paths(tables: list[DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """(tree, i, path) of every leaf: the siblings at each level from its own up, as (before, after).

    The leaves' columns `keep` come along, so that nobody has to join paths, which are long, with leaves again.
    """
    above = None
    for k in reversed(range(len(tables))):
        own_keep = keep if k == 0 else ()
        alone = tables[k].where("n = 1").select("tree", "i", *own_keep, F.expr("cast(array() AS array<struct<before: string, after: string>>)").alias("path"))
        if above is None:
            above = alone
            continue
        up = above.select(F.col("tree").alias("_tree"), F.col("i").alias("_g"), F.col("path").alias("_path"))
        own = siblings(tables[k], own_keep)
        met = own.join(up, (F.col("tree") == F.col("_tree")) & (F.col("g") == F.col("_g")))
        above = met.select("tree", "i", *own_keep, F.concat(F.array(F.struct("before", "after")), "_path").alias("path")).unionByName(alone)
        if k:
            above = _common.stash(above)
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda d, x: h(x["before"], d, x["after"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of `docs`. Texts don't move."""
    kinds = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
    docs = docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS])
    rows = docs.select("doc_id", "source", leaf({c: docs[c] for c in COLUMNS}).alias("leaf"), tampered(docs).alias("other"))
    leaves = numbered(rows, "source", ["doc_id", "leaf"])
    # Trees have numbers: the places of their sources.
    sources = numbered(leaves.select("source").distinct().withColumn("all", F.lit(0)), "all", ["source"])
    known = leaves.join(sources.select(F.col("source").alias("_source"), F.col("i").alias("tree")), F.col("source").eqNullSafe(F.col("_source")))
    tables = levels(known.select("tree", "i", "n", F.col("leaf").alias("digest"), "doc_id", "other"))
    subroots = _common.stash(roots(tables))
    top = sources.select(F.lit(0).alias("tree"), "i", "n").join(subroots.select(F.col("tree").alias("i"), F.col("root").alias("digest")), "i")
    top_tables = levels(top.select("tree", "i", "n", "digest"))
    root = roots(top_tables).select("root")
    ends = subroots.withColumnRenamed("root", "subroot").join(paths(top_tables).select(F.col("i").alias("tree"), F.col("path").alias("rest")), "tree")
    # One row, the root, meets the row of each source.
    ends = _common.stash(ends.withColumn("one", F.lit(1)).join(root.withColumn("one", F.lit(1)), "one").drop("one"))
    met = paths(tables, ("doc_id", "digest", "other")).withColumnRenamed("digest", "leaf").join(ends, "tree").withColumn("path", F.concat("path", "rest"))
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    out = met.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
