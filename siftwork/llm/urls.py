"""URL filters: rules on host and path, found through a blocked Bloom filter and confirmed by an exact hash join.

A rule `host/path` fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins
(then the later in code point order). Every url yields the keys that a fitting rule could have: each suffix of its host
with each prefix of its path whose length some rule has. A split-block Bloom filter of the rules (one bit in each of
eight words of a block) lets possible hits pass; a hash join with the rules removes what passed by chance. The filter's
size is bounded; more rules than it is made for only let more keys pass to the join. Urls are judged once each.

Defined results: a null url, or one without `://`, has the empty host and path and fits no rule; what no rule fits is
allowed, with a null rule; of repeated rules the first verdict in code point order counts; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import host_of

#: 64-byte blocks of the filter at most (16 MB), and rules that a block is made for.
MOST_BLOCKS, PER_BLOCK = 1 << 18, 32


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block, and its bit in each of the block's eight words."""
    bits = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), [F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int") for k in range(8)]


def bloom_filter(keys: DataFrame, blocks: int) -> Column:
    """The filter of `keys` (key) as a constant array of longs: at most 8 * `blocks` numbers reach the driver."""
    block, bits = place(F.col("key"), blocks)
    marks = keys.select(F.posexplode(F.array(*bits)).alias("k", "b"), block.alias("block")).select((F.col("block") * 8 + F.col("k")).alias("at"), F.expr("shiftleft(1L, b)").alias("bit"))
    found = [0] * (8 * blocks)
    for r in marks.groupBy("at").agg(F.bit_or("bit").alias("w")).collect():
        found[r["at"]] = r["w"]
    return F.from_json(F.lit(str(found)), "array<bigint>")


def maybe(key: Column, words: Column, blocks: int) -> Column:
    """Whether the filter may hold `key`."""
    block, bits = place(key, blocks)
    out = F.lit(True)
    for k, b in enumerate(bits):
        out = out & (F.call_function("shiftright", F.get(words, block * 8 + k), b).bitwiseAND(1) == 1)
    return out


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of `pages` (page_id, url) by `rules` (rule, verdict)."""
    rules = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    sizes = rules.select(F.length(F.expr("substring(rule, instr(rule, '/'))")).alias("n"))
    lengths = sorted(r["n"] for r in sizes.distinct().collect())
    blocks = min(MOST_BLOCKS, 1 << max(0, -(-rules.count() // PER_BLOCK) - 1).bit_length())
    words = bloom_filter(rules.select(F.col("rule").alias("key")), blocks)

    urls = pages.select("url").where("url IS NOT NULL").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    hits = urls.select("url", F.explode(F.filter(keys, lambda k: maybe(k, words, blocks))).alias("rule"))
    best = hits.join(rules, "rule").groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("r"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    return out.select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"),
    )
