"""Session helpers: the shared folder for cut lineage, table loading, skew-aware joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys are ever treated as hot, so what is broadcast for them is bounded.
MAX_HOT_KEYS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, a Parquet file or folder ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_refloom_dir", None)
    if made is None or not os.path.isdir(made):
        made = tempfile.mkdtemp(prefix="refloom-")
        spark._refloom_dir = made
    return f"file://{made}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage durably (an executor may be lost afterwards) and lets a
    result that is used several times be computed once. The files are removed
    by :func:`release`, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/refloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Remove the files of all staged tables. Call it when the results that read them have been written."""
    while _STAGED:
        _drop(*_STAGED.pop())


atexit.register(release)


def hot_threshold(total: int, least: int = 20_000, most_hot: int = MAX_HOT_KEYS) -> int:
    """Rows from which a key counts as hot. No more than ``most_hot`` keys can reach it."""
    return max(least, -(-total // most_hot))


def skew_join(rows: DataFrame, lookup: DataFrame, keys: list[str], count_col: str, total: int, how: str = "inner", least: int = 20_000) -> DataFrame:
    """Join many ``rows`` with a ``lookup`` that is unique by ``keys`` and knows each key's row count.

    Keys at or above :func:`hot_threshold` are at most ``MAX_HOT_KEYS``; they are
    joined by a broadcast of that proven bound, so no task receives all rows of
    a hot key. The rest is an ordinary shuffled join, where a key has fewer rows
    than the threshold. ``lookup`` is scanned twice; stage it if it is dear.
    Null keys never match.
    """
    at = hot_threshold(total, least)
    hot = lookup.where(F.col(count_col) >= at).drop(count_col)
    cold = lookup.where(F.col(count_col) < at).drop(count_col)
    if total < at or hot.isEmpty():
        return rows.join(lookup.drop(count_col), keys, how)
    flagged = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    mine = [c for c in flagged.columns if c != "__hot"]
    done = flagged.where(F.col("__hot")).select(*mine)
    rest = flagged.where(F.col("__hot").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(cold, keys, how).select(*mine))
