"""Duplicates hidden by formatting: one record per canonical key and the number of its copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.session import hot_threshold, staged

#: Parts into which a hot key is salted.
SALTS = 64

# The schemes an identifier may begin with.
SCHEMES = "doi|arxiv|title|isbn|issn|url|urn|hdl|pmid|mr|zbl"


def bare(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def bare_identifiers(text: Column) -> Column:
    """The identifiers in ``text``, each bare, in sorted order. An identifier begins at its scheme."""
    parts = F.split(F.regexp_replace(F.lower(text), rf"\b({SCHEMES})\s*:", "\u0001$1:"), "\u0001")
    bared = F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]", ""))
    return F.array_join(F.array_sort(F.filter(bared, lambda p: p != "")), " ")


def keyed(df: DataFrame, row_id: str, title: str, identifiers: str) -> DataFrame:
    """(id, key): the digest of each row's canonical title and identifiers; rows with either null are left out."""
    picked = df.where(F.col(title).isNotNull() & F.col(identifiers).isNotNull())
    return picked.select(F.col(row_id).cast("long").alias("id"), F.md5(F.concat_ws("\u0001", bare(F.col(title)), bare_identifiers(F.col(identifiers)))).alias("key"))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, and the rest. Hot keys are counted exactly; they are few by their definition, so they are broadcast."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = counts.where(F.col("n") >= hot_threshold(total)).select("key")
    flagged = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    return flagged.where("hot").drop("hot"), flagged.where("hot is null").drop("hot")


def _hot_totals(hot: DataFrame) -> DataFrame:
    """Two-level aggregation: by key and salt, then by key."""
    first = hot.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    return first.groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def collapse(df: DataFrame, row_id: str = "ref_id", title: str = "title", identifiers: str = "normalized_id") -> DataFrame:
    """(ref_id, n_copies): one record per work as cited, the smallest id of its copies, and how many copies there are.

    Copies are rows whose title and identifiers are both equal apart from letter
    case, characters that are neither letter nor digit, and the order of the
    identifiers. Empty strings are values; a row with either null is no case and has no
    record. Repeated ids count each.
    """
    hot, rest = _parts(staged(keyed(df, row_id, title, identifiers), "keyed"))
    one = rest.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(_hot_totals(hot)).select(F.col("least").alias(row_id), F.col("n").alias("n_copies"))


def copies(df: DataFrame, row_id: str = "ref_id", title: str = "title", identifiers: str = "normalized_id") -> DataFrame:
    """(ref_id_a, ref_id_b): every copy with its record, the smallest id of the copies. See :func:`collapse`."""
    hot, rest = _parts(staged(keyed(df, row_id, title, identifiers), "keyed"))
    # most keys occur once: only those that repeat are looked up again
    repeated = rest.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    one = rest.join(repeated, "key")
    many = hot.join(F.broadcast(_hot_totals(hot).select("key", "least")), "key")
    return one.select("id", "least").unionByName(many.select("id", "least")).where("id > least").select(F.col("least").alias("ref_id_a"), F.col("id").alias("ref_id_b"))
