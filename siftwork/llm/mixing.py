"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame and SQL functions only.

A source's target is its weight's share of the mix, at most `CAP` times its own size, the excess going to the others by
weight. Targets are cut to blocks of `BLOCK` words, and blocks are allotted to sources by highest quotients
v / (2 k + 1), exactly, then a source's blocks to its shards (documents dealt by hash) in the same way, never more than a shard
can give. In a shard, documents stand in a seeded order, and its quota is a run of blocks from a seeded start, taken
around in a circle: whole rounds take every document, the last one those that the run covers. Capped sources take every
document CAP times.

Sources sort by code point, null last, and weigh WEIGHTS in turn. Defined results: null and empty texts have size 0 and
give nothing; repeated rows are documents of their own; rows alike in everything may change places; an empty table gives
an empty result; other columns are ignored. Reruns agree: order and starts depend on hashes of the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common

WEIGHTS = (3, 1, 2)
#: The mix's words over all words, in per cent.
SHARE = 150
#: Times that a document is taken at most.
CAP = 2
#: Words in a block.
BLOCK = 16
#: Words in a shard, on average; a shard is ordered in one task.
SHARD = 1 << 20
SEED = 7
#: Lines that are tried at a time, quotients that are ranked, and turns to close in (a turn narrows by SECTIONS, and two
#: numbers are at most 2**64 apart).
SECTIONS, FEW, MOST_TURNS = 16, 1000, 40


def seats_above(votes: str, most: str, line: str) -> str:
    """SQL for the number of quotients votes / (2 k + 1) that are at least `line`, `most` at most.

    A division may round across the line, so the count is set right by the quotients beside it, which are compared as they
    are ranked: a line that is itself a quotient counts it.
    """
    near = f"cast(floor(({votes} / {line} + 1) / 2) AS bigint)"
    right = f"{near} + if({votes} / (2 * {near} + 1) >= {line}, 1L, 0L) - if({near} > 0 AND {votes} / (2 * {near} - 1) < {line}, 1L, 0L)"
    return f"if({votes} > 0 AND coalesce({line}, 0) > 0, least({most}, {right}), 0L)"


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, most: str) -> DataFrame:
    """`df` with `quota`: the `seats` of each group allotted to its rows by the highest quotients of `votes`.

    A row gets at most `most` seats; a group's rows need a column `tie` to break ties. Quotients are not enumerated: the
    line that parts those that win from the others is closed in on from both sides, a sum over a group's rows for each of
    SECTIONS + 1 lines at a time, until few quotients are left between (`FEW`, or only equal ones), and only those are ranked.
    Two of these lines are told by the votes alone and mostly leave no more than twice as many quotients as a group has rows.
    """
    rows = _common.stash(df)
    named = [f"_g{k}" for k in range(len(group))]
    same = lambda a, b: [a[g].eqNullSafe(b[n]) for g, n in zip(group, named)]
    wins = F.col(votes) > 0
    # At `low` no fewer quotients pass than there are seats, at `high` no more.
    state = rows.groupBy(*group).agg(
        F.max(F.greatest(F.col(seats), F.lit(0))).alias("_seats"), F.sum(F.when(wins, F.col(most)).otherwise(0)).alias("_from_low"),
        F.min(F.when(wins & (F.col(most) > 0), F.col(votes) / (2 * F.col(most) - 1))).alias("_low"), (2 * F.max(F.when(wins, F.col(votes)))).alias("_high"),
        F.sum(F.when(wins, F.col(votes))).alias("_votes"), F.count(F.when(wins, 1)).alias("_rows"),
    ).withColumnsRenamed(dict(zip(group, named))).withColumn("_from_high", F.lit(0).cast("long"))
    state = state.withColumn("_seats", F.least("_seats", "_from_low"))
    kept = state.columns
    for _ in range(MOST_TURNS):
        state = _common.stash(state)
        # Lines at equal ratios, or at equal distances once they are near; none where no number lies between.
        line = lambda k: F.expr(f"if(_high > 2 * _low, _low * pow(_high / _low, {k / SECTIONS}D), _low + (_high - _low) * {k / SECTIONS}D)")
        # Without `most`, a row passes a line within half a quotient of votes / (2 line) times, so the seats lie between these two.
        near = [F.expr(f"if({seats_} > 0, _votes / ({seats_}), null)") for seats_ in ("2 * _seats + _rows + 1", "2 * _seats - _rows - 1")]
        lines = F.filter(F.array(*map(line, range(1, SECTIONS)), *near), lambda t: (t > F.col("_low")) & (t < F.col("_high")))
        open_ = state.where(f"_from_low - _from_high > {FEW} AND _from_high < _seats").select(*named, lines.alias("_t")).where("size(_t) > 0")
        if open_.isEmpty():
            break
        passed = [F.sum(F.expr(seats_above(votes, most, f"get(_t, {k})"))) for k in range(SECTIONS + 1)]
        tried = F.zip_with(F.first("_t"), F.array(*passed), lambda t, c: F.struct(t.alias("t"), c.alias("c")))
        sums = rows.join(open_, same(rows, open_)).groupBy(*named).agg(tried.alias("_tried")).withColumnsRenamed({n: f"_c{n}" for n in named})
        met = state.join(sums, [state[n].eqNullSafe(sums[f"_c{n}"]) for n in named], "left")
        met = met.withColumns({"_b": F.array_max(F.filter("_tried", lambda x: x["t"].isNotNull() & (x["c"] >= F.col("_seats")))), "_a": F.array_min(F.filter("_tried", lambda x: x["t"].isNotNull() & (x["c"] <= F.col("_seats"))))})
        closer = {"_from_low": F.coalesce("_b.c", "_from_low"), "_low": F.coalesce("_b.t", "_low"), "_high": F.coalesce("_a.t", "_high"), "_from_high": F.coalesce("_a.c", "_from_high")}
        state = met.select(*[closer[c].alias(c) if c in closer else state[c] for c in kept])
    else:
        raise RuntimeError("apportionment did not close in")
    both = rows.join(state, same(rows, state)).withColumns({"_base": F.expr(seats_above(votes, most, "_high")), "_top": F.expr(seats_above(votes, most, "_low"))})
    left = both.where("_from_high < _seats AND _top > _base").withColumn("_k", F.explode(F.expr("sequence(_base, _top - 1)")))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), "tie", "_k")
    won = left.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.col("_seats") - F.col("_from_high"))
    won = won.groupBy(*group, "tie").agg(F.count("*").alias("_more")).withColumnsRenamed({**dict(zip(group, [f"_w{n}" for n in named])), "tie": "_wtie"})
    out = both.join(won, [both[g].eqNullSafe(won[f"_w{n}"]) for g, n in zip(group, named)] + [both["tie"].eqNullSafe(won["_wtie"])], "left")
    return out.select(*[both[c] for c in df.columns], (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("quota"))


def targets(sources: DataFrame) -> DataFrame:
    """`sources` (source, source_size: long) with weight and target. One row for each source throughout.

    A source is capped if the others, at the level where it meets its cap, would not yet fill the mix: sources in order
    of cap over weight, each with what stands before and behind it.
    """
    order = Window.partitionBy("all").orderBy(F.col("source").isNull(), F.col("source"))
    nth = sources.withColumn("all", F.lit(0)).withColumn("nth", F.row_number().over(order) - 1)
    weighed = nth.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int")))
    one = Window.partitionBy("all")
    cap = CAP * F.col("source_size")
    by_level = Window.partitionBy("all").orderBy(cap / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    run = weighed.withColumns({
        "total": F.sum("source_size").over(one) * SHARE / 100.0,
        "before": F.coalesce(F.sum(cap).over(by_level), F.lit(0)),
        "behind": F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)),
    })
    capped = F.col("before") + F.col("behind") * (cap / F.col("weight")) <= F.col("total")
    run = run.withColumn("capped", capped)
    level = run.withColumns({
        "spent": F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(one), F.lit(0)),
        "open": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(one), F.lit(0)),
    })
    target = F.when(F.col("capped"), cap.cast("double")).otherwise((F.col("total") - F.col("spent")) * F.col("weight") / F.col("open"))
    return level.withColumn("target", target).select("source", "nth", "source_size", "weight", "capped", "target")


def number(text: Column) -> Column:
    """A number from 0 below 2**32 for a text, by MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length that the spans [a, b) and [c, d) share."""
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0))


def mix(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of `docs` (doc_id, source, text), and the columns `keep`.

    Without `keep`, only sizes and hashes move, not texts.
    """
    tie = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), _common.n_words("text").alias("size"), tie.alias("tie"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    bare = _common.stash(sized.drop(*[f"_keep_{c}" for c in keep]))
    if not keep:
        sized = bare
    words = bare.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-words // SHARD))
    # The shard depends on the row's hash alone, so that a hot source is dealt to all of them.
    shard = F.pmod(number(F.col("tie")), F.lit(shards))
    per_shard = bare.groupBy("source", shard.alias("shard")).agg(F.sum("size").alias("words"))
    per_shard = _common.stash(per_shard)
    by_source = targets(per_shard.groupBy("source").agg(F.sum("words").alias("source_size")))
    by_source = by_source.withColumns({
        "tie": F.col("nth"),
        "most": F.floor(CAP * F.col("source_size") / BLOCK).cast("long"),
        "all": F.lit(0),
        "open": F.when(F.col("capped"), 0.0).otherwise(F.col("target")),
    })
    by_source = by_source.withColumn("blocks", F.round(F.sum("open").over(Window.partitionBy("all")) / BLOCK).cast("long"))
    quota = sainte_lague(by_source, ["all"], "open", "blocks", "most").select("source", "source_size", "target", "capped", F.col("quota").alias("seats"))
    a = per_shard.alias("a")
    b = quota.withColumnRenamed("source", "_s")
    split = a.join(b, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    split = split.withColumns({"tie": F.col("shard"), "most": F.floor(CAP * F.col("words") / BLOCK).cast("long"), "votes": F.col("words").cast("double")})
    split = sainte_lague(split, ["source"], "votes", "seats", "most")
    split = split.select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), "words", "source_size", "target",
        F.when(F.col("capped"), CAP * F.col("words")).otherwise(F.least(F.col("quota") * BLOCK, CAP * F.col("words"))).alias("take"),
    )
    split = _common.stash(split)
    dealt = sized.withColumn("shard", shard).join(split, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    order = Window.partitionBy("source", "shard").orderBy("tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0).cast("long")
    rest = F.col("take") - rounds * F.col("words")
    seeded = number(F.concat_ws("|", F.lit(str(SEED)), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    first = F.when(F.col("words") > 0, F.pmod(seeded, F.greatest(F.col("words"), F.lit(1)))).otherwise(0)
    first = F.floor(first / BLOCK).cast("long") * BLOCK
    end = F.col("at") + F.col("size")
    part = overlap(F.col("at"), end, first, first + rest) + overlap(F.col("at"), end, F.lit(0), first + rest - F.col("words"))
    return placed.select(
        "doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"_keep_{c}").alias(f"_keep_{c}") for c in keep]
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as the words it gives amount to its size, to the nearest.

    A shard's run begins and ends within a document at most, so rounding changes a source by no more than two
    documents' halves for each shard. Documents of no words give nothing and stay once.
    """
    taken = mix(docs, docs.columns)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    rows = taken.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])
