"""Ranked candidate lists, quotas along them, and repair of their logs."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 20261007
# Subclasses of an archive-level label.
SUBCLASSES = {"cond-mat": ["dis-nn", "mes-hall", "mtrl-sci", "other", "quant-gas", "soft", "stat-mech", "str-el", "supr-con"]}


def listing_query(category: str) -> str:
    """The search for a category, an archive-level label expanded to its subclasses."""
    subs = SUBCLASSES.get(category)
    return f"({' OR '.join(f'cat:{category}.{s}' for s in subs)})" if subs else f"cat:{category}"


def in_window(papers: DataFrame, category: str, start: str, end: str) -> DataFrame:
    """Papers whose primary category is ``category`` or below it, first published within the days given."""
    c = F.col("primary_category")
    return papers.where(((c == category) | c.startswith(f"{category}.")) & F.col("published").between(start, end))


def seeded_rank(rows: DataFrame, stratum: str, item: str, seed: int = SEED) -> DataFrame:
    """``rows`` with rank from 0 in each stratum, in the order of a hash of seed and item; ties by item.

    A stratum is ranked in 4,096 ranges of the hash, whose counts are summed up first.
    """
    hashed = rows.withColumn("__order", F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))).withColumn("__part", F.substring("__order", 1, 3))
    counts = hashed.groupBy(stratum, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(stratum).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col(stratum).alias("__s"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    placed = hashed.join(starts, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    within = F.row_number().over(W.partitionBy(stratum, "__part").orderBy("__order", item)) - 1
    return placed.withColumn("rank", (F.col("__start") + within).cast("int")).select(*rows.columns, "rank")


def shuffled_rank(rows: DataFrame, stratum: str, item: str, seed: int = SEED) -> DataFrame:
    """(stratum, item, rank) by the standard generator's shuffle of each stratum in the order of its items, seeded by seed and stratum. A stratum is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = sorted(pdf[item])
        random.Random(f"{seed}-{pdf[stratum].iat[0]}").shuffle(items)
        return pd.DataFrame({stratum: pdf[stratum].iat[0], item: items, "rank": range(len(items))})

    kind = dict(rows.dtypes)
    return rows.select(stratum, item).groupBy(stratum).applyInPandas(run, f"{stratum} {kind[stratum]}, {item} {kind[item]}, rank int")


def _usable_before(log: DataFrame, stratum: str, rank: str, usable: str, name: str) -> DataFrame:
    """``log`` with the number of usable rows of the stratum at a lower rank, by totals of ranges of 10,000 ranks."""
    parted = log.withColumn("__part", F.floor(F.col(rank) / 10_000))
    one = F.when(F.col(usable), 1).otherwise(0)
    totals = parted.groupBy(stratum, "__part").agg(F.sum(one).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(stratum).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select(F.col(stratum).alias("__s"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    placed = parted.join(starts, F.col(stratum).eqNullSafe(F.col("__s")) & F.col("__part").eqNullSafe(F.col("__p")))
    within = F.coalesce(F.sum(one).over(W.partitionBy(stratum, "__part").orderBy(rank).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, F.col("__start") + within).select(*log.columns, name)


def select_quota(log: DataFrame, stratum: str, rank: str, usable: str, target: str) -> DataFrame:
    """``log`` with selected yes/no: the first ``target`` usable rows of each stratum in rank order."""
    counted = _usable_before(log, stratum, rank, usable, "__before")
    return counted.withColumn("selected", F.when(F.col(usable) & (F.col("__before") < F.col(target)), "yes").otherwise("no")).drop("__before")


def walk_order(candidates: DataFrame, ratio: int = 2) -> DataFrame:
    """``candidates`` with pass and place: the order in which sources are fetched, all strata to 1 x quota first, larger quotas first."""
    passes = candidates.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(ratio))))
    return passes.withColumn("place", F.row_number().over(W.partitionBy("pass", "stratum").orderBy("rank"))).orderBy("pass", F.desc("n_ai_in_stratum"), "stratum", "rank")


def two_pass_walk(candidates: DataFrame, usable: str, ratio: int = 2) -> DataFrame:
    """The ``candidates`` (stratum, rank, n_ai_in_stratum) that are examined, with ``pass``: the pass in which each one is.

    Pass p walks every stratum in rank order, over what earlier passes have
    not examined, and stops at p times the stratum's quota of usable rows. A
    row is therefore examined in the first pass whose target is above the
    usable rows before it, or not at all.
    """
    walked = _usable_before(candidates, "stratum", "rank", usable, "__before")
    number = F.floor(F.col("__before") / F.col("n_ai_in_stratum")) + 1
    return walked.where("n_ai_in_stratum > 0").withColumn("pass", number.cast("int")).where(F.col("pass") <= ratio).drop("__before")


def repair_log(candidates: DataFrame, log: DataFrame, sources: DataFrame) -> DataFrame:
    """(stratum, rank, id, status) of candidates that must have been examined but are not logged.

    Those up to the highest rank with a log row or source in their stratum:
    with a source ``included`` or ``no_bibliography`` by its number of references
    (``sources``: id, n_references), else ``failed_unrecorded``.
    """
    seen = candidates.join(log.select("id", F.lit(True).alias("logged")).distinct(), "id", "left").join(sources.select("id", "n_references").distinct(), "id", "left")
    last = seen.where(F.col("logged") | F.col("n_references").isNotNull()).groupBy("stratum").agg(F.max("rank").alias("last"))
    missing = seen.where("logged is null").join(last, "stratum").where("rank <= last")
    status = F.when(F.col("n_references").isNull(), "failed_unrecorded").when(F.col("n_references") > 0, "included").otherwise("no_bibliography")
    return missing.select("stratum", "rank", "id", status.alias("status"), F.coalesce("n_references", F.lit(0)).alias("n_references"))
