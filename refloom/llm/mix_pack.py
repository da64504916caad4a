"""Fixed-capacity containers filled with texts in a controlled mixture of sources."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.llm.bpe import VOCABULARIES, count_tokens
from refloom.session import staged

#: A window is so many tokens, or 16 containers if those are more; one task packs one window.
WINDOW_TOKENS = 1 << 20
#: Rows in a part of a source's queue; the parts' totals are summed up before any row is ranked.
PART_ROWS = 100_000
#: Sources that can be mixed; more are refused, as their shares are known to every task.
MOST_SOURCES = 1000

_PACKED = "capacity_id int, capacity_tokens int, window long, container long, doc_id long, source string, piece int, start_token long, n_tokens long"


def pack_window(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, best fit, largest items first; ties keep their order.

    No size is above ``capacity``. Items of size 0 go into the first container.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    room: list[int] = []  # sorted room left, and beside it the container
    owner: list[int] = []
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        if size == 0:
            continue
        at = bisect_left(room, size)
        if at < len(room):
            left, c = room.pop(at) - size, owner.pop(at)
        else:
            left, c, made = capacity - size, made, made + 1
        out[i] = c
        if left:
            at = bisect_left(room, left)
            room.insert(at, left)
            owner.insert(at, c)
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "piece"], kind="stable")
    capacity = int(pdf["capacity_tokens"].iat[0])
    return pdf.assign(container=pack_window(pdf["n_tokens"].to_numpy(), capacity))[[c.split()[0] for c in _PACKED.split(", ")]]


def source_shares(items: DataFrame, targets: dict[str, float] | None = None) -> list[tuple[str, float, int]]:
    """(source, target, tokens) of each source of ``items``, the targets scaled to 1; sources without tokens have target 0."""
    found = items.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(r["tokens"] for r in found)
    weights = [(r["source"], (targets or {}).get(r["source"], r["tokens"] / max(total, 1)) if r["tokens"] else 0.0, r["tokens"]) for r in found]
    if any(w < 0 or (t and not w) for _, w, t in weights):
        raise ValueError("targets must be positive")
    scale = sum(w for _, w, _ in weights) or 1.0
    return sorted((s, w / scale, t) for s, w, t in weights)


def served_before(round_: Column, shares: list[tuple[str, float, int]]) -> Column:
    """Tokens that all sources together have given when each still full one has given ``round_`` tokens per unit of its target.

    A source that has run out gives what it had, so the sum is a line with a bend
    at every exhaustion; behind a bend the others fill its place in the
    proportions of their targets.
    """
    if not shares:
        return F.lit(0.0)
    known = F.array(*(F.struct(F.lit(float(t)).alias("tokens"), F.lit(w).alias("target")) for _, w, t in shares))
    return F.aggregate(known, F.lit(0.0), lambda acc, x: acc + F.least(x["tokens"], x["target"] * round_))


def source_windows(items: DataFrame, shares: list[tuple[str, float, int]], capacities: DataFrame, window_tokens: int) -> DataFrame:
    """``items`` (doc_id, source, n_tokens) for each capacity, with their place in the source's queue and the window that serves them.

    Deficit round-robin in closed form: an item whose tokens end at C within the
    queue of a source with target t is served in round C / t, wherever its
    partition lies, since C is a prefix sum over all partitions before it. The
    sources together have given :func:`served_before` that round, so the item
    lies in window ceil(that / window) - 1. What an item takes beyond its
    window's share is the deficit the source carries into the next one.
    """
    parts = 1 << max(4, (-(-items.count() // PART_ROWS) - 1).bit_length())
    hashed = items.withColumn("order", F.xxhash64("doc_id", F.lit(20261007))).withColumn("part", F.shiftrightunsigned("order", 64 - (parts.bit_length() - 1)))
    totals = hashed.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("source", "part", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.sum("n_tokens").over(W.partitionBy("source", "part").orderBy(F.shiftleft("order", 1), "order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = hashed.withColumn("within", within).join(starts, ["source", "part"])
    target = F.create_map(*(F.lit(x) for s, w, t in shares if t for x in (s, w))) if any(t for *_, t in shares) else F.lit(None).cast("map<string,double>")
    served = served_before((F.col("start") + F.col("within")) / F.try_element_at(target, F.col("source")), shares)
    placed = placed.select("doc_id", "source", "n_tokens", "order", F.coalesce(served, F.lit(0.0)).alias("served"))
    size = F.greatest(F.lit(window_tokens), F.col("capacity_tokens") * 16)
    return placed.crossJoin(F.broadcast(capacities)).withColumn("window", F.greatest(F.ceil(F.col("served") / size) - 1, F.lit(0)).cast("long")).drop("served")


def pack_texts(docs: DataFrame, capacities: DataFrame, targets: dict[str, float] | None = None, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Rows of ``docs`` assigned to containers of each capacity in ``capacities``.

    Result: capacity_id, capacity_tokens, window, container (numbered within the
    window), doc_id, source, piece, start_token, n_tokens. A text is one piece
    unless it has more tokens than the container; then it is cut into full
    pieces and a rest. Every window takes from the sources in the proportions
    ``targets`` (source -> weight, any positive numbers; by default each
    source's share of all tokens); a source that is not named gets its own
    share, then all are scaled to 1. When a source runs out the windows after it
    are filled from the others, in the proportions of their targets, so every
    window but the last is full; :func:`mixture_report` shows the shares.

    Null and empty texts have 0 tokens and lie in their window's first
    container. A null source is the source ''. Repeated doc_ids are items of
    their own. Null or non-positive capacities are left out; without documents
    or capacities the result is empty. Other columns are ignored.
    """
    return pack_items(sized(docs, vocabulary, folder), capacities, targets, window_tokens)


def sized(docs: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, source, n_tokens) of each text."""
    return staged(count_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text"), ["doc_id", "source"], "text", vocabulary, folder), "tokens")


def pack_items(items: DataFrame, capacities: DataFrame, targets: dict[str, float] | None = None, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """:func:`pack_texts` of items whose sizes are known: doc_id, source, n_tokens."""
    caps = capacities.where("capacity_tokens > 0").select("capacity_id", "capacity_tokens")
    placed = source_windows(items, source_shares(items, targets), caps, window_tokens)
    size, cap = F.col("n_tokens"), F.col("capacity_tokens")
    # items of no size need no room, and a window may have any number of them
    empty = placed.where("n_tokens = 0").select("capacity_id", "capacity_tokens", "window", F.lit(0).cast("long").alias("container"), "doc_id", "source", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), size.cast("long").alias("n_tokens"))
    pieces = F.sequence(F.lit(0), (F.ceil(size / cap) - 1).cast("int"))
    rows = placed.where("n_tokens > 0").select("capacity_id", "capacity_tokens", "window", "order", "doc_id", "source", size.alias("whole"), F.explode(pieces).alias("piece"))
    rows = rows.withColumn("start_token", F.col("piece").cast("long") * cap).withColumn("n_tokens", F.least(F.col("whole") - F.col("start_token"), cap).cast("long")).drop("whole")
    return rows.groupBy("capacity_id", "window").applyInPandas(_pack, _PACKED).unionByName(empty)


def mixture_report(packed: DataFrame) -> DataFrame:
    """By capacity, window and source: tokens, share of the window, and by window the containers and the unused share of their space."""
    shares = packed.groupBy("capacity_id", "capacity_tokens", "window", "source").agg(F.sum("n_tokens").alias("tokens"))
    w = W.partitionBy("capacity_id", "window")
    full = packed.groupBy("capacity_id", "window").agg((F.max("container") + 1).alias("containers"))
    out = shares.withColumn("all_tokens", F.sum("tokens").over(w)).join(full, ["capacity_id", "window"])
    return out.select("capacity_id", "window", "source", "tokens", F.round(F.try_divide("tokens", "all_tokens"), 6).alias("share"), "containers", F.round(1 - F.col("all_tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused"))


def packing_faults(items: DataFrame, packed: DataFrame, capacities: DataFrame, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """By capacity: the items packed, and how many items, containers and windows are not as promised (all 0).

    ``split_items`` fit a container and were cut all the same, ``changed_items`` lost
    or gained tokens, ``overfull`` counts containers above their capacity,
    ``uneven_windows`` windows at whose end the tokens so far differ from full
    windows by more than one item of each source.
    """
    whole = packed.groupBy("capacity_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    sizes = items.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.max("n_tokens").alias("largest"), F.count(F.lit(1)).alias("items"))
    by_item = whole.join(sizes, "doc_id").groupBy("capacity_id").agg(F.sum("items").alias("items"), F.count_if((F.col("largest") <= F.col("capacity_tokens")) & (F.col("pieces") > F.col("items"))).alias("split_items"), F.count_if(F.col("n") != F.col("size")).alias("changed_items"))
    by_container = packed.groupBy("capacity_id", "capacity_tokens", "window", "container").agg(F.sum("n_tokens").alias("n")).groupBy("capacity_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    windows = packed.groupBy("capacity_id", "capacity_tokens", "window").agg(F.sum("n_tokens").alias("n"))
    w = W.partitionBy("capacity_id").orderBy("window")
    upto = windows.withColumns({"upto": F.sum("n").over(w), "next": F.lead("window").over(w)}).where("next is not null")
    slack = items.agg((F.max("n_tokens") * F.countDistinct("source")).alias("slack"))
    full = (F.col("window") + 1) * F.greatest(F.lit(window_tokens), F.col("capacity_tokens") * 16)
    uneven = upto.crossJoin(F.broadcast(slack)).groupBy("capacity_id").agg(F.count_if(F.abs(F.col("upto") - full) > F.col("slack")).alias("uneven_windows"))
    out = capacities.where("capacity_tokens > 0").select("capacity_id").join(by_item, "capacity_id", "left").join(by_container, "capacity_id", "left").join(uneven, "capacity_id", "left")
    return out.select("capacity_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "split_items", "changed_items", "overfull", "uneven_windows")))
