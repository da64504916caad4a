"""Joining two tables on a class whose members may be very many on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.session import skew_join, staged

#: Members of a class that one task pairs with as many of the other side.
PART = 2000


def class_join(left: DataFrame, right: DataFrame, keys: list[str], spread_left: str, spread_right: str, most: int = PART) -> DataFrame:
    """``left`` and ``right`` joined on ``keys``; classes with more than ``most`` members on a side are joined in parts.

    Such a class is cut into parts of about ``most`` members on either side, by a
    hash of ``spread_left`` and ``spread_right``, and every part of one side
    meets every part of the other in a task of its own. What is added to the
    shuffle is members squared / ``most``, against members squared rows of the
    result. Nulls in ``keys`` match nothing. ``left`` and ``right`` are read more
    than once, so they should be staged; only ``keys`` may be columns of both.
    """
    known = lambda d: d.where(" and ".join(f"{k} is not null" for k in keys))
    count = lambda d, n: known(d).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > most)
    sizes = staged(count(left, "__l").join(count(right, "__r"), keys, "full"), "classes")
    # the small files of a staged table would be taken for a small table
    if sizes.isEmpty():
        return left.join(right.hint("merge"), keys)
    parts = lambda c: F.coalesce(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    sizes = sizes.select(*keys, parts("__l").alias("__pl"), parts("__r").alias("__pr"), F.greatest(F.coalesce("__l", F.lit(0)), F.coalesce("__r", F.lit(0))).alias("__n"))

    def spread(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        rows = known(rows)
        cut = skew_join(rows, sizes, keys, "__n", rows.count(), "left")
        mine = F.pmod(F.xxhash64(by), F.coalesce(own, F.lit(1))).cast("int")
        theirs: Column = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return cut.withColumn("__mine", mine).withColumn("__theirs", theirs).drop("__pl", "__pr")

    a = spread(left, spread_left, "__pl", "__pr").withColumnsRenamed({"__mine": "__i", "__theirs": "__j"})
    b = spread(right, spread_right, "__pr", "__pl").withColumnsRenamed({"__mine": "__j", "__theirs": "__i"})
    return a.join(b.hint("merge"), [*keys, "__i", "__j"]).drop("__i", "__j")
