"""Line dedup by a segment-partition edit join; DataFrame and SQL functions only.

Lines are equal, or near each other if their edit distance is within the threshold of the shorter one's length (`TAUS`);
classes are the components of these links, and the first line of a class (smallest doc_id, then hash of the row's text,
then line number) stays.

The join splits a line into as many segments as its threshold and one. A longer or equally long partner within the
threshold holds one of them within a few places of where it stood, so every line probes, for its own and each shorter
length that may be near, the substrings that the multi-match-aware rule leaves. A signature of letter counts is part of
the join condition, so that families of variants do not come out of the join as all pairs. Survivors are trimmed of their
common beginning and end (found by binary search), and the rest is verified by a bit-parallel automaton over the band of
diagonals that the largest threshold spans.

A row is told by doc_id and a hash of its text. Defined results: a null text has no lines, an empty text one blank line;
blank lines are never dropped or linked; repeated rows (same doc_id and text) get the same result each; rows of one doc_id,
or of none, with different texts are rows of their own; rows with a null doc_id come first in their class' order; an empty
table gives an empty result; other columns are passed on by `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common

#: Code points of a line, and the edits that it may be away from a line at least as long.
TAUS = ((16, 1), (32, 2))
TAU = TAUS[-1][1]
#: Letters that a line's signature counts, each modulo 16.
LETTERS = "aeinotrslhcdgm"
#: Above the counts a signature holds a probe's kind in two bits, then the threshold.
KIND, LIMIT = 4 * len(LETTERS), 4 * len(LETTERS) + 2
#: Ids are broadcast up to this many (8 MB), which is checked.
MOST_BROADCAST = 1_000_000


def segment(i: str, size: str, tau: str) -> tuple[str, str]:
    """SQL for the 0-based start and the length of segment i (from 0) of a line of `size`: the last ones are longer."""
    short = f"cast({size} div ({tau} + 1) AS int)"
    plain = f"({tau} + 1 - {size} + ({tau} + 1) * {short})"  # segments before the longer ones
    return f"{i} * {short} + greatest(0, {i} - {plain})", f"{short} + if({i} >= {plain}, 1, 0)"


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift) of every substring that a line probes."""
    out = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            out += [(delta, i, shift) for shift in range(low, high + 1)]
    return out


def signature(line: str) -> str:
    """SQL for the letter counts, four bits each, in one long that is not negative."""
    count = lambda c: f"cast((octet_length({line}) - octet_length(replace({line}, '{c}', ''))) & 15 AS bigint)"
    return " | ".join(f"shiftleft({count(c)}, {4 * k})" for k, c in enumerate(LETTERS))


def apart(a: str, b: str) -> str:
    """SQL for a lower bound on the sum of differences of the counts in two signatures: at most 2 * TAU for a pair."""
    gap = lambda k: f"((shiftright({a}, {4 * k}) & 15L) - (shiftright({b}, {4 * k}) & 15L) & 15L)"
    return " + ".join(f"least({gap(k)}, 16L - {gap(k)})" for k in range(len(LETTERS)))


def threshold(size: str) -> str:
    """SQL for the edits that a pair may be apart whose shorter line has `size` code points."""
    return "CASE " + " ".join(f"WHEN {size} >= {least} THEN {tau}" for least, tau in reversed(TAUS)) + " ELSE 0 END"


def blank(line: Column) -> Column:
    return F.coalesce(F.trim(line) == "", F.lit(True))


def all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), nr, line, h, h2 (two hashes that stand for the line) of every line.

    A row without a text has one row with a null nr and line. Hashes of blank lines are their places', so that they
    never meet.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    lines = rows.select("doc_id", "t", F.posexplode_outer(F.split("text", "\n")).alias("nr", "line"))
    own = F.xxhash64("doc_id", "t", "nr")
    return lines.withColumns({"h": F.when(blank(F.col("line")), own).otherwise(F.xxhash64("line")), "h2": F.when(blank(F.col("line")), own).otherwise(F.xxhash64("line", F.lit(1)))})


def entries(lines: DataFrame) -> DataFrame:
    """key, h, sig of every index entry and probe of the lines that are long enough.

    A probe's kind tells an index entry (0), which is also the unshifted probe for the line's own length, a shifted one
    (1) and one for a shorter length (2). Probes are a table of constants that every line is joined with in place, so that
    one short expression computes all keys.
    """
    long_enough = lines.select("h", "line", F.length("line").alias("n")).where(F.col("n") >= TAUS[0][0])
    # Bytes are found at once where each is a character; the hash is that of the same characters.
    raw = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary"))
    long_enough = long_enough.select("h", "line", "n", F.expr(signature("line")).alias("sig"), raw.alias("raw"))
    specs = []
    for (least, tau), most in zip(TAUS, [*[x for x, _ in TAUS[1:]], (1 << 31) - 1]):
        own = [(0, i, 0, 0) for i in range(tau + 1)] + [(d, i, shift, 2 if d else 1) for d, i, shift in probes(tau) if d or shift]
        specs += [f"struct({d} AS d, {i} AS i, {shift} AS shift, {kind}L AS kind, {tau} AS tau, {least} AS least, {most} AS most)" for d, i, shift, kind in own]
    every = long_enough.select("h", "line", "n", "sig", "raw", F.expr(f"inline(array({', '.join(specs)}))"))
    every = every.withColumn("size", F.col("n") - F.col("d")).where("size >= least AND size < most")
    every = every.withColumn("start", F.expr(segment("i", "size", "tau")[0])).withColumn("len", F.expr(segment("i", "size", "tau")[1]))
    piece = lambda of: f"xxhash64(substring({of}, 1 + start + shift, len), i, size)"
    key = F.expr(f"if(raw IS NOT NULL, {piece('raw')}, {piece('line')})")
    return every.select(key.alias("key"), "h", F.expr(f"sig | shiftleft(kind, {KIND}) | shiftleft(cast(tau AS bigint), {LIMIT})").alias("sig"))


def once(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """`lines` with each distinct line at its first place only. Just the lines that repeat have to be looked up."""
    again = firsts.where("n > 1").select("h", "h2", "first")
    if again.count() <= MOST_BROADCAST // 2:
        again = F.broadcast(again)
    return lines.join(again, ["h", "h2"], "left").where("first IS NULL OR first <=> struct(doc_id, t, nr)").drop("first")


def candidates(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of line hashes that share a segment where it may stand and pass the signature; `lines` are distinct."""
    every = entries(lines)
    a, b = every.toDF("key", "a", "sa"), every.toDF("key", "b", "sb")
    # One condition on both sides: so the two sides stay the same plan, which is run and shuffled once.
    kind = lambda sig: f"shiftright({sig}, {KIND}) & 3"
    probed = f"{kind('sa')} = 0 AND if({kind('sb')} = 2, a <> b, a < b)"
    met = a.join(b, "key").where(f"CASE WHEN {probed} THEN {apart('sa', 'sb')} <= 2 * shiftright(sa, {LIMIT}) ELSE false END")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common_prefix(a: str, b: str, most: str) -> str:
    """SQL for the length of the longest common prefix, `most` at most, by binary search."""
    steps = ", ".join(str(1 << k) for k in range(30, -1, -1))
    return (
        f"aggregate(array({steps}), 0, (at, s) -> if(at + s <= {most} AND "
        f"substring({a}, at + 1, s) = substring({b}, at + 1, s), at + s, at))"
    )


def let(name: str, value: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, which is so computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def within(pairs: DataFrame, tau: int = TAU, limit: str | None = None) -> DataFrame:
    """Rows of `pairs` (with texts x and y) that are at most `limit` (SQL, at most `tau`; without it `tau`) edits apart."""
    limit = limit or str(tau)
    # Splitting at nothing would part the halves of characters beyond U+FFFF.
    chars = lambda c: (
        f"CASE WHEN {c} = '' THEN array() WHEN {c} rlike '[\\\\x{{10000}}-\\\\x{{10FFFF}}]' "
        f"THEN transform(sequence(1, length({c})), i -> substring({c}, i, 1)) ELSE split({c}, '') END"
    )
    # Bit k of a mask: whether x's character equals y's on diagonal k - tau.
    bits = " | ".join(f"if(get(c.y, i + {k - tau - 1}) <=> get(c.x, i - 1), {1 << k}, 0)" for k in range(2 * tau + 1))
    masks = f"if(size(c.x) = 0, array(), transform(sequence(1, greatest(size(c.x), 1)), i -> {bits}))"
    # s{e}: diagonals that are reachable with at most e edits.
    full = (1 << 2 * tau + 1) - 1
    start = ", ".join(f"{sum(1 << tau + j for j in range(e + 1))} AS s{e}" for e in range(tau + 1))
    step = ["(t.s0 & m)"]
    for e in range(1, tau + 1):
        step.append(f"((t.s{e} & m) | t.s{e - 1} | shiftright(t.s{e - 1}, 1) | (shiftleft({step[-1]}, 1) & {full}))")
    move = ", ".join(f"{s} AS s{e}" for e, s in enumerate(step))
    states = f"aggregate({masks}, struct({start}), (t, m) -> struct({move}))"
    reached = f"CASE {limit} " + " ".join(f"WHEN {e} THEN e.s{e}" for e in range(tau + 1)) + " END"
    last = let("e", states, f"shiftright({reached}, size(c.y) - size(c.x) + {tau}) & 1")
    found = let("c", f"struct({chars('v.x')} AS x, {chars('v.y')} AS y)", last)
    trimmed = "struct(substring(x, p + 1, length(x) - p - q) AS x, substring(y, p + 1, length(y) - p - q) AS y)"
    found = let("v", trimmed, found)
    found = let("q", common_prefix("reverse(x)", "reverse(y)", "(least(length(x), length(y)) - p)"), found)
    found = let("p", common_prefix("x", "y", "least(length(x), length(y))"), found)
    return pairs.where(f"abs(length(x) - length(y)) <= {limit} AND {found} = 1")


def links(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Verified links between distinct lines: (a, a2, b, b2), both hashes of either."""
    pairs = _common.stash(candidates(once(lines, firsts)))
    need = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    if pairs.count() <= MOST_BROADCAST // 2:
        need = F.broadcast(need)
    texts = lines.join(need, "h", "left_semi").groupBy("h", "h2").agg(F.first("line").alias("line"))
    texts = _common.stash(texts)
    x = texts.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("x"))
    y = texts.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("limit", F.expr(threshold("least(length(x), length(y))")))
    return within(both, TAU, "limit").select("a", "a2", "b", "b2")


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, t, nr, root (the first line of its class: doc_id, t, nr), links of every line.

    Rows without a text have one row with a null nr.
    """
    lines = all_lines(docs)
    firsts = lines.where(~blank(F.col("line"))).groupBy("h", "h2").agg(F.min(F.struct("doc_id", "t", "nr")).alias("first"), F.count("*").alias("n"))
    firsts = _common.stash(firsts)
    near = _common.stash(links(lines, firsts))
    if near.isEmpty():
        classes = firsts.select("h", "h2", F.col("first").alias("root"), F.lit(0).cast("long").alias("links"))
    else:
        ends = near.select(F.col("a").alias("h"), F.col("a2").alias("h2")).union(near.select("b", "b2"))
        degree = ends.groupBy("h", "h2").agg(F.count("*").alias("links"))
        to = lambda h, h2, name: firsts.select(F.col("h").alias(h), F.col("h2").alias(h2), F.col("first").alias(name))
        named = near.join(to("a", "a2", "u"), ["a", "a2"]).join(to("b", "b2", "v"), ["b", "b2"])
        roots = _common.components(named.select(F.col("u").alias("a"), F.col("v").alias("b")))
        classes = (
            firsts.join(degree, ["h", "h2"], "left").join(roots.select(F.col("id").alias("first"), "root"), "first", "left")
            .select("h", "h2", F.coalesce("root", "first").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        )
    own = F.struct("doc_id", "t", "nr")
    return (
        lines.select("doc_id", "t", "nr", "h", "h2").join(classes, ["h", "h2"], "left")
        .select("doc_id", "t", "nr", F.coalesce("root", own).alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def kept(root: str = "root") -> Column:
    """Whether a line of `line_classes` stays."""
    return F.expr(f"{root} <=> struct(doc_id, t, nr)")


def summary(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_lines, n_kept, n_links and classes, the (doc_id, nr) of each line's class in order.

    Repeated rows are `m` alike, so their lines are counted m times and their result comes m times.
    """
    each = line_classes(docs).groupBy("doc_id", "t").agg(
        F.count_if(F.coalesce("nr", F.lit(0)) == 0).alias("m"), F.count("nr").alias("n"), F.count_if(F.col("nr").isNotNull() & kept()).alias("k"), F.sum("links").alias("l"),
        F.expr("transform(sort_array(collect_set(if(nr IS NOT NULL, struct(nr, root), null))), x -> struct(x.root.doc_id, x.root.nr))").alias("classes"),
    )
    share = lambda c: F.expr(f"{c} div m")
    each = each.select("doc_id", share("n").alias("n_lines"), share("k").alias("n_kept"), share("l").alias("n_links"), "classes", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("nth"))
    return each.drop("nth")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that repeat an earlier one; documents of which nothing is left go, others stay whole."""
    gone, key, text_key = _common.fresh(docs, "drops"), _common.fresh(docs, "drops_of"), _common.fresh(docs, "drops_text")
    drops = line_classes(docs).where(F.col("nr").isNotNull() & ~kept()).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("nr")).alias(gone))
    drops = drops.withColumnsRenamed({"doc_id": key, "t": text_key})
    both = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left")
    all_of = F.split("text", "\n")
    rest = F.array_join(F.filter(F.transform(all_of, lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "\n")
    both = both.where(F.col(gone).isNull() | (F.size(gone) < F.size(all_of)))
    out = both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
