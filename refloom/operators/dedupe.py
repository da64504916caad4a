"""First-wins, last-wins and not-yet-done, with the order made explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    # a rank filter: every task keeps one row of a key before the shuffle, so a hot key is no hot task, and unused columns are not read
    by = [F.desc_nulls_last(c) if last else F.asc_nulls_first(c) for c in order]
    return df.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__place = 1").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``. Null keys are a key; ties on the whole order give either row."""
    return _pick(df, keys, order, False)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    return _pick(df, keys, order, True)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose key ``done`` lacks: what a resumed run still has to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
