"""One-to-one assignment of two sides by confidence, in rounds over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.session import staged


def _best(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(side).agg(F.max(F.struct("c", "left", "right")).alias("best")).select("best.*")


def dominant(edges: DataFrame) -> DataFrame:
    """A one-to-one part of ``edges`` (left, right, c), taken by descending confidence; ties by the ids.

    In each round the edges that are the best of both their ends are taken and
    all others of these ends are dropped. That is the assignment which going
    through the edges one by one in descending order gives.
    """
    left, taken = staged(edges.select("left", "right", "c"), "edges"), None
    while not left.isEmpty():
        new = staged(_best(left, "left").intersect(_best(left, "right")), "taken")
        taken = new if taken is None else taken.unionByName(new)
        left = staged(left.join(new.select("left"), "left", "left_anti").join(new.select("right"), "right", "left_anti").select("left", "right", "c"), "edges")
    return edges.select("left", "right", "c").limit(0) if taken is None else taken


def augmented(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """``taken`` with every exchange that raises the total: someone without a partner takes over one, whose owner moves to a free partner or to none.

    All exchanges of a round that are the best for everyone in them are made at
    once. The total rises with each, so the rounds end.
    """
    while True:
        taken = staged(taken, "assigned")
        open_left = edges.join(taken.select("left"), "left", "left_anti")
        free = edges.join(taken.select("right"), "right", "left_anti")
        moves = free.join(taken.select("left"), "left", "left_semi").groupBy("left").agg(F.max(F.struct("c", "right")).alias("to")).select(F.col("left").alias("owner"), "to")
        owned = taken.select(F.col("left").alias("owner"), "right", F.col("c").alias("had"))
        swaps = open_left.join(owned, "right").join(moves, "owner", "left").withColumn("gain", F.col("c") + F.coalesce(F.col("to.c"), F.lit(0.0)) - F.col("had")).where("gain > 1e-9")
        swaps = staged(swaps.select("left", "right", "c", "owner", F.col("to.right").alias("free"), F.col("to.c").alias("free_c"), F.struct("gain", "left", "right").alias("rank")), "swaps")
        if swaps.isEmpty():
            return taken
        made = swaps
        for who in ("left", "right", "owner"):
            made = made.join(swaps.groupBy(who).agg(F.max("rank").alias("rank")).select("rank"), "rank", "left_semi")
        best_free = swaps.where("free is not null").groupBy("free").agg(F.max("rank").alias("rank")).select("rank")
        made = staged(made.where("free is null").unionByName(made.where("free is not null").join(best_free, "rank", "left_semi")), "made")
        kept = taken.join(made.select(F.col("owner").alias("left")), "left", "left_anti").select("left", "right", "c")
        moved = made.where("free is not null").select(F.col("owner").alias("left"), F.col("free").alias("right"), F.col("free_c").alias("c"))
        taken = kept.unionByName(made.select("left", "right", "c")).unionByName(moved)


def one_to_one(edges: DataFrame) -> DataFrame:
    """A one-to-one part of ``edges`` (left, right, c; each pair once) with a large total confidence.

    Ends with a single edge that no other edge touches are taken at once. The
    rest is assigned by descending confidence (:func:`dominant`), then improved by
    exchanges along paths of three edges (:func:`augmented`), which leaves no such
    exchange that would raise the total. Nothing is collected and no component
    is put into one task.
    """
    edges = staged(edges.select("left", "right", "c"), "all")
    several = lambda side: edges.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(side)
    # with a left end that has several edges, all edges of their right ends are contested, and the other way round
    disputed = edges.join(several("right"), "right", "left_semi").unionByName(edges.join(several("left"), "left", "left_semi").select("right", "left", "c")).distinct()
    disputed = staged(disputed.select("left", "right", "c"), "disputed")
    alone = edges.join(disputed.select("left").distinct(), "left", "left_anti").join(disputed.select("right").distinct(), "right", "left_anti")
    if disputed.isEmpty():
        return alone.select("left", "right", "c")
    return alone.select("left", "right", "c").unionByName(augmented(disputed, dominant(disputed)))
