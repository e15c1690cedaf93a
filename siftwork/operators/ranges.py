"""Points joined with ranges of any length by equality: both sides are keyed by blocks of a tree over the numbers.

Level k of the tree has blocks of FAN ** k numbers. A range is cut into the largest whole blocks that it consists of, a few for
each level whatever its length; a point lies in one block of each level. A point is in a range exactly if one of its blocks is
one of the range's, and there is one such block at most, so the join is by (what else must be equal, level, block) and
makes no row for a point and a range that don't meet. Points are exploded to LEVELS keys, narrow columns alone.

Defined results: ranges without a start or end, or that end before they start, and points without a number meet nothing; both
count from 0 to FAN ** LEVELS - 1; repeated rows meet each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN, LEVELS = 8, 11


def blocks_of(start: Column, end: Column) -> Column:
    """The blocks (k, b) that the numbers from `start` to `end`, both included, consist of."""
    levels = []
    for k in range(LEVELS):
        size = FAN**k
        # Whole blocks of this level and of the next; what those of the next hold is left to them.
        a, b = F.ceil(start / size), F.floor((end + 1) / size)
        up_a, up_b = F.ceil(start / (size * FAN)) * FAN, F.floor((end + 1) / (size * FAN)) * FAN
        above = (up_a < up_b) & F.lit(k + 1 < LEVELS)
        span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        own = F.when(above, F.concat(span(a, F.least(b, up_a)), span(F.greatest(a, up_b), b))).otherwise(span(a, b))
        levels.append(F.transform(own, _tagged(k)))
    return F.flatten(F.array(*levels))


def _tagged(level: int):
    return lambda b: F.struct(F.lit(level).alias("k"), b.alias("b"))


def blocks_at(at: Column) -> Column:
    """The block of each level that a number lies in."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.floor(at / FAN**k).alias("b")) for k in range(LEVELS)])


def met(points: DataFrame, ranges: DataFrame, same: tuple[str, str], at: str, start: str, end: str) -> DataFrame:
    """Rows of `points` with those of `ranges` (whose columns must have other names) that hold `at` and agree in `same`."""
    a = points.where(F.col(at) >= 0).withColumn("_point", F.explode(blocks_at(F.col(at).cast("long"))))
    b = ranges.where(F.col(end) >= F.col(start)).withColumn("_range", F.explode(blocks_of(F.greatest(F.col(start).cast("long"), F.lit(0)), F.col(end).cast("long"))))
    on = (F.col(same[0]) == F.col(same[1])) & (F.col("_point.k") == F.col("_range.k")) & (F.col("_point.b") == F.col("_range.b"))
    return a.join(b, on).drop("_point", "_range")


def split(points: DataFrame, ranges: DataFrame, same: tuple[str, str], at: str, start: str, end: str, asks: list[str], condition: Column | None, how: str) -> DataFrame:
    """Rows of `points` that some range covers (`how` left_semi) or none does (left_anti), `condition` being true of both.

    `condition` reads the columns `asks` of points: their distinct values are looked up once, and `points` as a whole move for the last join only.
    """
    keys = list(dict.fromkeys([same[0], at, *asks]))
    found = met(points.select(*keys).distinct(), ranges, same, at, start, end)
    found = (found.where(condition) if condition is not None else found).select(*[F.col(c).alias(f"_is_{c}") for c in keys]).distinct()
    equal = [F.col(c).eqNullSafe(F.col(f"_is_{c}")) for c in keys]
    return points.join(found, equal, how)
