"""References to records that do not exist, found with bitmaps per key range and period."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.session import skew_join, staged

#: Keys in one range; their local numbers fit 16 bits, a bitmap of them 8 KiB.
RANGE_KEYS = 1 << 16
_SPARSE = 4096


class Bits:
    """A compressed set of local key numbers: sorted uint16 while sparse, a packed bitmap beyond 4,096 of them."""

    __slots__ = ("few", "many")

    def __init__(self, numbers: np.ndarray):
        numbers = np.unique(np.asarray(numbers, dtype=np.uint16))
        self.few, self.many = numbers, None
        if len(numbers) > _SPARSE:
            dense = np.zeros(RANGE_KEYS, dtype=bool)
            dense[numbers] = True
            self.few, self.many = None, np.packbits(dense)

    def decode(self) -> np.ndarray:
        return self.few if self.many is None else np.flatnonzero(np.unpackbits(self.many)).astype(np.uint16)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        if self.many is None:
            at = np.searchsorted(self.few, numbers)
            at[at == len(self.few)] = 0
            return self.few[at] == numbers if len(self.few) else np.zeros(len(numbers), dtype=bool)
        return (self.many[numbers >> 3] >> (7 - (numbers & 7))) & 1 == 1

    def and_not(self, other: Bits) -> Bits:
        if self.many is not None and other.many is not None:
            return Bits(np.flatnonzero(np.unpackbits(self.many & ~other.many)))
        mine = self.decode()
        return Bits(mine[~other.has(mine)])

    def union(self, other: Bits) -> Bits:
        return Bits(np.concatenate([self.decode(), other.decode()]))


def clean_key(key: Column) -> Column:
    """The key without white space at its ends; a blank one is null."""
    return F.nullif(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""), F.lit(""))


# kinds of (key, period) facts: a reference of a table, a claim of use, a parent that exists at all, one that is there from a period on
_REF, _CLAIM, _EVER, _SINCE, _USED = range(5)
_LEFT = T.StructType([T.StructField("range", T.LongType()), T.StructField("local", T.IntegerType()), T.StructField("tab", T.IntegerType()), T.StructField("period", T.IntegerType()), T.StructField("absent", T.BooleanType())])


def _and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    """References AND-NOT parents of one key range; the surviving bits decoded."""
    out: list[pd.DataFrame] = []
    key_range = pdf["range"].iat[0]
    kind, local, period, tab = pdf["kind"].to_numpy(), pdf["local"].to_numpy(), pdf["period"].to_numpy(), pdf["tab"].to_numpy()

    def keep(bits: Bits, t: int, p: int, absent: bool) -> None:
        found = bits.decode()
        if len(found):
            out.append(pd.DataFrame({"range": key_range, "local": found.astype(np.int32), "tab": np.int32(t), "period": np.int32(p), "absent": absent}))

    ever, used = Bits(local[kind == _EVER]), Bits(local[kind == _USED])
    since = sorted(set(period[kind == _SINCE]))
    for p in sorted(set(period[(kind == _REF) | (kind == _CLAIM)])):
        # there throughout p: received before p and not removed since
        live = Bits(local[(kind == _SINCE) & (period < p)]) if since and since[0] < p else Bits(np.empty(0))
        for t in sorted(set(tab[(kind == _REF) & (period == p)])):
            refs = Bits(local[(kind == _REF) & (period == p) & (tab == t)])
            absent = refs.and_not(ever)
            keep(absent, t, p, True)
            keep(refs.and_not(absent).and_not(live), t, p, False)
        if len(claims := local[(kind == _CLAIM) & (period == p)]):
            keep(Bits(claims).and_not(used), -1, p, True)
    return pd.concat(out) if out else pd.DataFrame({"range": [], "local": [], "tab": [], "period": [], "absent": []})


def _month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


_END = "9999-12-31 00:00:00"


def _islands(spans: DataFrame) -> DataFrame:
    """Per key, [at, went) intervals that touch or overlap as one: as many as there are gaps between them, however many records came."""
    w = W.partitionBy("folder", "key").orderBy("at", "went")
    marked = spans.withColumn("before", F.max("went").over(w.rowsBetween(W.unboundedPreceding, -1)))
    starts = F.sum(F.when(F.col("before").isNull() | (F.col("at") > F.col("before")), 1).otherwise(0)).over(w)
    return marked.withColumn("island", starts).groupBy("folder", "key", "island").agg(F.min("at").alias("came"), F.max("went").alias("went"))


def orphan_references(refs: list[tuple[str, DataFrame, str, str, str, str]], parents: DataFrame, uses: str) -> DataFrame:
    """(tab, row_id bigint, period, reason): references without a record at their time, and claims of uses that never occur.

    ``refs``: (tab, table, row id, folder, key, time) for each referring table;
    ``parents``: the table of records with ref_id, preprint_folder, cite_key,
    cited_in_text, loaded_at, removed_at; ``uses``: the tab of ``refs`` whose rows
    are uses. Reasons: ``absent`` (no record of that key in the folder ever),
    ``late`` (all loaded after the reference's time), ``removed`` (else), and
    ``uncited`` for records with cited_in_text ``yes`` that no use names.

    Keys are numbered densely within ranges; one task holds the distinct
    (key, period) facts of a range as bitmaps and keeps reference AND-NOT parent.
    Only the keys that survive are joined to rows, hot ones by a bounded
    broadcast, and only those with some parent have their exact times compared.

    Keys are compared without white space at their ends. A null or blank key or
    a null folder is no case; neither is a null time of a reference, or of a
    record (it counts as never received). Repeated rows each come out. Columns
    other than those named are ignored.
    """
    months = []
    for i, (_, df, row_id, folder, key, at) in enumerate(refs):
        months.append(df.select(F.lit(i).alias("tab"), F.col(row_id).cast("long").alias("row_id"), F.col(folder).alias("folder"), clean_key(F.col(key)).alias("key"), F.col(at).alias("at")))
    rows = months[0]
    for m in months[1:]:
        rows = rows.unionByName(m)
    rows = rows.where("folder is not null and key is not null")
    own = parents.select(F.lit(-1).alias("tab"), F.col("ref_id").cast("long").alias("row_id"), F.col("preprint_folder").alias("folder"), clean_key(F.col("cite_key")).alias("key"), F.col("loaded_at").alias("at"), "removed_at", (F.col("cited_in_text") == "yes").alias("claim")).where("folder is not null and key is not null")

    # distinct facts: map-side aggregation reduces a hot key to a row per period before anything is shuffled
    uses_at = next(i for i, r in enumerate(refs) if r[0] == uses)
    said = rows.groupBy("folder", "key", "tab", _month(F.col("at")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    there = own.groupBy("folder", "key", F.when(F.col("claim"), _month(F.col("at"))).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min(F.when(F.col("removed_at").isNull(), F.col("at"))).alias("stays"))
    facts = said.select("folder", "key", "n", F.array(F.when(F.col("period").isNotNull(), F.struct(F.lit(_REF).alias("kind"), F.col("tab"), F.col("period"))), F.when(F.col("tab") == uses_at, F.struct(F.lit(_USED).alias("kind"), F.lit(0).alias("tab"), F.lit(0).alias("period")))).alias("fact")).unionByName(
        there.select("folder", "key", "n", F.array(F.when(F.col("period").isNotNull(), F.struct(F.lit(_CLAIM).alias("kind"), F.lit(-1).alias("tab"), F.col("period"))), F.when(F.col("first").isNotNull(), F.struct(F.lit(_EVER).alias("kind"), F.lit(0).alias("tab"), F.lit(0).alias("period"))), F.when(F.col("stays").isNotNull(), F.struct(F.lit(_SINCE).alias("kind"), F.lit(0).alias("tab"), _month(F.col("stays")).alias("period")))).alias("fact"))
    )
    facts = facts.select("folder", "key", "n", F.array_compact("fact").alias("fact")).groupBy("folder", "key").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("fact"))).alias("facts"))

    # the dictionary: ranges by hash, numbered densely inside each
    facts = staged(facts, "facts")
    n_keys, n_rows = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # half full on average, so the largest of the hash ranges stays below 65,536 keys; the remainder of the number names a further range if one does not
    n_ranges = max(1, -(-2 * n_keys // RANGE_KEYS), min(64, n_keys // 4096))
    number = F.row_number().over(W.partitionBy("bucket").orderBy("folder", "key")) - 1
    coded = facts.withColumn("bucket", F.pmod(F.xxhash64("folder", "key"), F.lit(n_ranges))).withColumn("number", number)
    coded = coded.select("folder", "key", "n", "facts", (F.col("bucket") + n_ranges * F.floor(F.col("number") / RANGE_KEYS)).alias("range"), (F.col("number") % RANGE_KEYS).cast("int").alias("local"))
    coded = staged(coded, "codes")
    left = coded.select("range", "local", F.explode("facts").alias("f")).select("range", "local", F.col("f.kind").alias("kind"), F.col("f.tab").alias("tab"), F.col("f.period").alias("period")).groupBy("range").applyInPandas(_and_not, _LEFT)
    found = left.join(coded.select("folder", "key", "n", "range", "local"), ["range", "local"])
    # one row per surviving key: its suspicious (tab, period) pairs
    found = staged(found.groupBy("folder", "key").agg(F.max("n").alias("n"), F.collect_set(F.when(F.col("absent"), F.struct("tab", "period"))).alias("gone"), F.collect_set(F.when(~F.col("absent"), F.struct("tab", "period"))).alias("doubt")), "orphans")

    mine = F.struct(F.col("tab"), _month(F.col("at")).alias("period"))
    sure = found.where(F.size("gone") > 0).select("folder", "key", "gone", "n")
    all_rows = rows.unionByName(own.where("claim").select("tab", "row_id", "folder", "key", "at")).where("at is not null")
    absent = skew_join(all_rows, sure, ["folder", "key"], "n", n_rows).where(F.array_contains("gone", mine)).select("tab", "row_id", "at", F.when(F.col("tab") < 0, "uncited").otherwise("absent").alias("reason"))

    # those with some parent: their exact times against the parents' intervals; equal intervals are kept once
    doubt = found.where(F.size("doubt") > 0).select("folder", "key", "doubt", "n")
    spans = own.where("at is not null").select("folder", "key", "at", F.coalesce("removed_at", F.lit(_END).cast("timestamp_ntz")).alias("went")).distinct().join(doubt.select("folder", "key"), ["folder", "key"], "left_semi")
    spans = _islands(spans).groupBy("folder", "key").agg(F.collect_list(F.struct("came", "went")).alias("spans"), F.min("came").alias("came"))
    doubt = staged(doubt.join(spans, ["folder", "key"]), "doubt")
    checked = skew_join(rows.where("at is not null"), doubt, ["folder", "key"], "n", n_rows).where(F.array_contains("doubt", mine))
    there_then = F.exists("spans", lambda s: (s["came"] <= F.col("at")) & (s["went"] > F.col("at")))
    late = F.col("came") > F.col("at")
    checked = checked.where(~there_then).select("tab", "row_id", "at", F.when(late, "late").otherwise("removed").alias("reason"))

    names = F.array(*(F.lit(r[0]) for r in refs))
    tab = F.when(F.col("tab") < 0, F.lit("ai_citations")).otherwise(F.get(names, F.greatest(F.col("tab"), F.lit(0))))
    return absent.unionByName(checked).select(tab.alias("tab"), "row_id", F.date_format("at", "yyyy-MM").alias("period"), "reason")


def orphans_by_table_and_period(found: DataFrame) -> DataFrame:
    """The report: orphan references counted by table, period and reason."""
    return found.groupBy("tab", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


def corpus_orphans(ai: DataFrame, intext: DataFrame, cross: DataFrame) -> DataFrame:
    """:func:`orphan_references` of the corpus tables."""
    return orphan_references([("ai_intext_citations", intext, "cit_id", "paper_id", "key", "extracted_at"), ("ai_cross_citations", cross, "xref_id", "citing_folder", "cite_key", "linked_at")], ai, "ai_intext_citations")
