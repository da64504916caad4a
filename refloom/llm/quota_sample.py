"""A sample whose categories follow target proportions, by divisor-method priorities."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which each category is cut before its first rows are merged.
SALTS = 32

_SEATS = "cat string, available long, target double, floor long, seats long"


def allot(available: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, names: list[str]) -> np.ndarray:
    """Seats per category: floors first, then the globally smallest (rank - 0.5) / target; ties by name.

    A category never gets more than it has, so the seats of an exhausted one go
    to the others. With a target of 0 or less only the floor counts, last.
    """
    floor = np.minimum(floor, available)
    weight = np.where(target > 0, target, np.nan)

    def prio(i: int, rank: int) -> tuple[float, str]:
        return ((rank - 0.5) / weight[i] if target[i] > 0 else float("inf"), names[i])

    if floor.sum() > size:  # not even the floors fit: they compete by their priorities
        available, floor = floor, np.zeros_like(floor)
    seats = floor.copy()

    def at(level: float) -> np.ndarray:
        earned = np.where(target > 0, np.floor(level * np.nan_to_num(weight) + 0.5), 0)
        return np.maximum(floor, np.minimum(available, earned.clip(0, 2**53).astype(np.int64)))

    low, high = 0.0, 1.0
    while at(high).sum() < min(size, available[target > 0].sum() if (target > 0).any() else 0) and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() <= size else (low, mid)
    if (target > 0).any():
        seats = at(low * (1 - 1e-9))
    heap = [(*prio(i, int(seats[i]) + 1), i) for i in range(len(seats)) if seats[i] < available[i] and target[i] > 0]
    heapq.heapify(heap)
    left = size - int(seats.sum())
    while left > 0 and heap:
        *_, i = heapq.heappop(heap)
        seats[i] += 1
        left -= 1
        if seats[i] < available[i]:
            heapq.heappush(heap, (*prio(i, int(seats[i]) + 1), i))
    return seats


def tidy(stratum: Column) -> Column:
    """A category's name for comparison: without white space at its ends, in lower case; a blank one is null."""
    return F.nullif(F.lower(F.regexp_replace(stratum, r"(?U)^\s+|\s+$", "")), F.lit(""))


def usable(candidates: DataFrame) -> DataFrame:
    """(cat, cand_id, id, rank): one row per paper, its smallest rank; a missing stratum is read from primary_category."""
    picked = candidates.select(F.coalesce(tidy(F.col("stratum")), tidy(F.col("primary_category"))).alias("cat"), F.col("cand_id").cast("long").alias("cand_id"), "id", F.col("rank").cast("long").alias("rank"))
    picked = picked.where("cat is not null")
    named = picked.where("id is not null")
    best = named.groupBy("id").agg(F.min(F.struct(F.coalesce("rank", F.lit(2**62)).alias("r"), "cand_id", "cat", "rank")).alias("b")).select("b.cat", "b.cand_id", "id", "b.rank")
    return best.unionByName(picked.where("id is null"))


def _seats(rows: DataFrame, targets: DataFrame, size: int | None, ratio: int) -> DataFrame:
    """(cat, available, target, floor, seats), one row per category of either table: one small task."""
    have = rows.groupBy("cat").agg(F.count(F.lit(1)).alias("available"))
    want = targets.select(tidy(F.col("stratum")).alias("cat"), F.col("target_share").cast("double").alias("t"), F.col("min_rows").cast("long").alias("m"), F.col("n_ai_in_stratum").cast("long").alias("a")).where("cat is not null").groupBy("cat").agg(F.sum("t").alias("target"), F.max("m").alias("floor"), F.sum("a").alias("ai"))
    both = want.join(have, "cat", "full").select("cat", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("floor", F.lit(0)).alias("floor"), F.coalesce("ai", F.lit(0)).alias("ai"), F.lit(0).alias("one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = size if size is not None else ratio * int(pdf["ai"].sum())
        seats = allot(pdf["available"].to_numpy(), pdf["target"].to_numpy(), pdf["floor"].to_numpy(), n, pdf["cat"].tolist())
        return pdf.assign(seats=seats)[["cat", "available", "target", "floor", "seats"]]

    return both.groupBy("one").applyInPandas(run, _SEATS)


def quota_sample(candidates: DataFrame, targets: DataFrame, size: int | None = None, ratio: int = 2) -> DataFrame:
    """(stratum, cand_id, id, rank, seat): the sample, taken in rank order within each stratum.

    ``size`` rows are drawn, by default ``ratio`` times the targets' n_ai_in_stratum.
    Strata are compared without regard to case and outer white space; a null
    one is read from primary_category, and rows with neither are left out, as
    are strata without a target. A paper listed twice counts once, at its
    smallest rank; rows without an id are papers of their own. Equal ranks go by
    cand_id, a null rank comes last. Empty tables give an empty sample.

    The seats follow from the strata's row counts alone, so no stratum is
    sorted whole: each part of it keeps no more rows than the stratum has seats,
    then the parts are merged.
    """
    rows = usable(candidates)
    seats = _seats(rows, targets, size, ratio).where("seats > 0").select("cat", "seats")
    order = [F.col("rank").asc_nulls_last(), F.col("cand_id")]
    part = F.pmod(F.xxhash64("cand_id"), F.lit(SALTS))
    first = rows.join(F.broadcast(seats), "cat").withColumn("part", part).withColumn("k", F.row_number().over(W.partitionBy("cat", "part").orderBy(*order))).where("k <= seats")
    last = first.withColumn("seat", F.row_number().over(W.partitionBy("cat").orderBy(*order))).where("seat <= seats")
    return last.select(F.col("cat").alias("stratum"), "cand_id", "id", "rank", F.col("seat").cast("long").alias("seat"))


def quota_report(candidates: DataFrame, targets: DataFrame, size: int | None = None, ratio: int = 2) -> DataFrame:
    """(stratum, target_share, min_rows, available, taken, wanted, missed, reason): every stratum of either table.

    ``wanted`` is the share of the sample's rows rounded half up, at least the
    floor; ``missed`` how many fewer were taken. Reasons: ``no candidates``, ``too
    few candidates``, ``no target``, ``seats went to others`` (rounding, floors), ''.
    """
    seats = _seats(usable(candidates), targets, size, ratio)
    wanted = F.greatest(F.floor(F.col("target") * F.sum("seats").over(W.partitionBy()) + 0.5), "floor")
    out = seats.withColumn("wanted", wanted.cast("long")).withColumn("missed", F.greatest(F.col("wanted") - F.col("seats"), F.lit(0)))
    reason = F.when(F.col("target") <= 0, "no target").when(F.col("missed") == 0, "").when(F.col("available") == 0, "no candidates").when(F.col("available") == F.col("seats"), "too few candidates").otherwise("seats went to others")
    return out.select(F.col("cat").alias("stratum"), F.col("target").alias("target_share"), F.col("floor").alias("min_rows"), "available", F.col("seats").alias("taken"), "wanted", "missed", reason.alias("reason"))
