"""Several values packed in one field: infer each source's delimiters, then one row per value."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.packed import PACKED, Field, decide, name_of, settled
from refloom.session import skew_join, staged

#: Fields of a source and shape count against its shape's fields in all sources as this many fields do.
PRIOR = 4

_SUMS = "source string, kind string, shape string, cand string, n long, pieces double, squares double, regular double"
_VALUES = "tab string, row_id long, pos long, val string"
_CUT = "part string, source string, val string, n long, sums array<struct<shape: string, cand: string, n: long, pieces: double, squares: double, regular: double>>"
#: Distinct values, sources or fields of which a task of :func:`value_counts` keeps account at once.
KEPT = 50_000


def _score(least: int):
    """Batches of (source, kind, field): for each source, shape and candidate the sums that its score is made of, of fields with ``least`` candidates or more.

    The candidate '' counts the fields of the source.
    """
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.float64()] * 3
    names = [c.split()[0] for c in _SUMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            sums: dict[tuple, list[float]] = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
            if len(known) > 100_000:
                known = {}
            for source, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen = known.get((kind, text))
                if seen is None:
                    field = Field(text, kind)
                    combos = field.combos()
                    cuts = ((name_of(c), field.cut(c)) for c in combos) if len(combos) >= least else ()
                    seen = known[kind, text] = (field.shape, [(n, len(pieces), regular) for n, (pieces, regular) in cuts])
                shape, cands = seen
                sums[source, kind, "", ""][0] += 1
                for cand, n, regular in cands:
                    s = sums[source, kind, shape, cand]
                    s[0] += 1
                    s[1] += n
                    s[2] += n * n
                    s[3] += regular
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def _add(sums: dict[tuple[str, str], list[float]], shape: str, cands: list[tuple[str, int, float]]) -> None:
    """One more field of a source, or of all."""
    sums["", ""][0] += 1
    for cand, n, regular in cands:
        s = sums[shape, cand]
        s[0] += 1
        s[1] += n
        s[2] += n * n
        s[3] += regular


def _cut(kind: str):
    """Batches of (source, field): rows of four kinds, see :func:`value_counts`."""
    struct = [pa.string()] * 2 + [pa.int64()] + [pa.float64()] * 3

    def rows(counts: dict[str, int], unsure: dict[tuple[str, str], int], own: dict[str, dict], total: dict) -> pa.RecordBatch:
        sums = [*own.values(), total]
        flat = [(*k, *v) for s in sums for k, v in s.items()]
        ends = np.cumsum([0] * (len(counts) + len(unsure) + 1) + [len(s) for s in sums])
        parts = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(struct)], ["shape", "cand", "n", "pieces", "squares", "regular"])
        part = ["value"] * len(counts) + ["unsure"] * len(unsure) + ["own"] * len(own) + ["all"]
        source = [None] * len(counts) + [s for s, _ in unsure] + [*own] + [None]
        val = [*counts] + [f for _, f in unsure] + [None] * (len(own) + 1)
        n = [*counts.values(), *unsure.values()] + [None] * (len(own) + 1)
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(source, pa.string()), pa.array(val, pa.string()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)], ["part", "source", "val", "n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: (defaultdict(int), defaultdict(int), defaultdict(lambda: defaultdict(lambda: [0, 0.0, 0.0, 0.0])), defaultdict(lambda: [0, 0.0, 0.0, 0.0]))
        counts, unsure, own, total = kept = new()
        known: dict[str, tuple] = {}
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = known.get(text)
                if seen is None:
                    field = Field(text, kind)
                    cands = []
                    if len(field.present) < 2:
                        got = decide(field)[0]
                    else:
                        cuts = [(name_of(c), *field.cut(c)) for c in field.combos()]
                        got, cands = settled([c[1:] for c in cuts]), [(c, len(pieces), regular) for c, pieces, regular in cuts]
                    seen = (got, field.shape if cands else "", cands)
                    if len(known) >= KEPT // 5:
                        known = {}
                    if len(text) < 1000:
                        known[text] = seen
                got, shape, cands = seen
                if got is None:
                    unsure[source, text] += 1
                else:
                    for v in got:
                        counts[v] += 1
                if cands:
                    _add(own[source], shape, cands)
                    _add(total, shape, cands)
            if max(map(len, kept)) > KEPT:
                yield rows(*kept)
                counts, unsure, own, total = kept = new()
        yield rows(*kept)

    return run


def _orders(packed: str) -> dict[str, list[str]]:
    """For each shape its candidates, the best first, of a text of :func:`source_orders`."""
    return {s: c.split(",") for s, _, c in (x.partition("=") for x in packed.split(" ") if x)}


def _choose(kind: str):
    """Batches of (field, n, orders): the values of each field by its source's order, each n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = defaultdict(int)
            for text, n, orders in zip(*(c.to_pylist() for c in batch.columns)):
                field = Field(text, kind)
                for v in decide(field, _orders(orders or "").get(field.shape, []))[0]:
                    counts[v] += n
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["val", "n"])

    return run


def _split(least: int):
    """Batches of (tab, row_id, kind, field, orders): the values of each field that has ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, val, at, orders = [], [], [], batch.column(4)
            seen: dict[str, dict[str, list[str]]] = {}  # each distinct text of orders is read once
            for i, (kind, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                field = Field(text, kind)
                order: list[str] = []
                if field.present:
                    packed = orders[i].as_py() or ""
                    if packed not in seen:
                        seen[packed] = _orders(packed)
                    order = seen[packed].get(field.shape, order)
                got = decide(field, order)[0]
                if len(got) >= least:
                    at += [i] * len(got)
                    pos += range(1, len(got) + 1)
                    val += got
            ids = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(pos, pa.int64()), pa.array(val, pa.string())], ["tab", "row_id", "pos", "val"])

    return run


def delimiter_scores(fields: DataFrame, least: int = 1) -> DataFrame:
    """(source, kind, shape, cand, n, score) of ``fields`` (source, kind, field): how well each candidate explains the fields of a source and shape.

    A candidate is a delimiter or several together, a shape the set of
    delimiters that occur in a field and whether family names stand first. The
    score is the mean share of pieces that look like a value, times a factor
    for the consistency of the piece count (from 3/4 to 1, by its coefficient of
    variation). Both are those of the source's fields and, as far as these are
    few, of all fields of the shape. The sums are formed within each batch before
    they are shuffled; there are as many shapes as sets of delimiters. Fields
    with fewer than ``least`` candidates are counted, but not cut and scored.
    """
    own = _added(fields.select("source", "kind", "field").mapInArrow(_score(least), _SUMS), "source", "kind", "shape", "cand")
    return _scored(own, _added(own, "kind", "shape", "cand"))


def _added(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "pieces", "squares", "regular")))


def _scored(own: DataFrame, everywhere: DataFrame) -> DataFrame:
    """The scores of :func:`delimiter_scores` from the sums of each source and those of all sources."""
    everywhere = everywhere.withColumnsRenamed({c: f"all_{c}" for c in ("n", "pieces", "squares", "regular")})
    # at most two shapes for each set of six delimiters, with eleven candidates each, and two kinds
    both = own.join(F.broadcast(everywhere), ["kind", "shape", "cand"])
    total = lambda c: F.col(c) + PRIOR * F.col(f"all_{c}") / F.col("all_n")
    n = F.col("n") + PRIOR
    mean = total("pieces") / n
    spread = F.sqrt(F.greatest(total("squares") / n - mean * mean, F.lit(0.0))) / F.greatest(mean, F.lit(1e-9))
    score = F.when(F.col("cand") != "", F.round(total("regular") / n * (0.75 + 0.25 / (1 + spread)), 9))
    return both.select("source", "kind", "shape", "cand", "n", score.alias("score"))


def source_orders(scores: DataFrame) -> DataFrame:
    """(source, kind, orders, size): for each shape of the source its candidates, the best first, as text, and the source's number of fields."""
    width = F.size(F.split("cand", r"\+"))
    ranked = F.transform(F.array_sort(F.collect_list(F.when(F.col("cand") != "", F.struct(-F.col("score"), width, "cand")))), lambda x: x["cand"])
    shapes = scores.groupBy("source", "kind", "shape").agg(F.array_join(ranked, ",").alias("order"), F.max("n").alias("n"))
    one = F.when(F.col("shape") != "", F.concat_ws("=", "shape", "order"))
    return shapes.groupBy("source", "kind").agg(F.array_join(F.array_sort(F.collect_list(one)), " ").alias("orders"), F.max(F.when(F.col("shape") == "", F.col("n"))).alias("size"))


def split_fields(rows: DataFrame, least: int) -> DataFrame:
    """(tab, row_id, pos, val) of ``rows`` (tab, row_id, source, kind, field), for fields that hold ``least`` or more values; see :func:`split_packed`."""
    holds = F.when(F.col("kind") == "name", F.col("field").rlike(PACKED["name"])).otherwise(F.col("field").rlike(PACKED["code"]))
    packed = rows.where(F.col("field").isNotNull() & holds).select("tab", "row_id", "kind", "field", F.concat_ws("\u0001", "tab", "source").alias("source"))
    # where there is only one candidate, its score decides nothing
    orders = staged(source_orders(delimiter_scores(packed, 2)), "orders")
    total = orders.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    joined = skew_join(packed, orders.drop("kind"), ["source"], "size", total, "left")
    out = joined.select("tab", "row_id", "kind", "field", "orders").mapInArrow(_split(least), _VALUES)
    if least > 1:
        return out
    plain = rows.where(F.col("field").isNotNull() & ~holds).select("tab", "row_id", "kind", "field", F.lit("").alias("orders"))
    return out.unionByName(plain.mapInArrow(_split(least), _VALUES))


def _picked(df: DataFrame, tab: str, row_id: str, field: str, source: str, kind: str) -> DataFrame:
    return df.select(F.lit(tab).alias("tab"), F.col(row_id).cast("long").alias("row_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.lit(kind).alias("kind"), F.col(field).alias("field"))


def split_packed(df: DataFrame, row_id: str, field: str, source: str, kind: str = "name", single: bool = True) -> DataFrame:
    """(row_id bigint, pos bigint, val): every value of ``field``, position from 1.

    ``kind`` is ``name`` (people and organisations) or ``code`` (short codes).
    First the delimiters are inferred: for each source and shape of field the
    candidate with the best score over its fields (:func:`delimiter_scores`).
    Then every field is cut by its source's choice. A field in which that leaves
    a piece that does not look like a value is compared under all candidates,
    ties by the source's order. ``single=False`` leaves out fields with one
    value. A null, blank or delimiter-only field has no value and no row; a
    null source is a source of its own; repeated rows are each split; other
    columns are ignored, whatever their names.

    Fields without any delimiter are not scored and not shuffled. Hot sources get
    their choice by a bounded broadcast.
    """
    return split_fields(_picked(df, "", row_id, field, source, kind), 1 if single else 2).select("row_id", "pos", "val")


def split_multi(df: DataFrame, row_id: str, field: str, source: str, kind: str = "name") -> DataFrame:
    """As :func:`split_packed`, but only fields that hold two or more values."""
    return split_packed(df, row_id, field, source, kind, single=False)


def value_counts(df: DataFrame, field: str, source: str, kind: str = "name") -> DataFrame:
    """(val, n): the values of :func:`split_packed` and how often each occurs; a value may have several rows.

    A field is cut once, under all its candidates. Where the most regular cuts
    are the same (see :func:`settled`), no source's order can change the values,
    and they are counted where the field is read. The pass also adds up what the
    scores are made of; so for the other fields the orders of their sources
    follow without reading any field again. Its rows are of four kinds: values
    counted, fields that wait for an order, sums of a source, sums of all.
    """
    fields = df.where(F.col(field).isNotNull()).select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(field).alias("field"))
    cut = staged(fields.mapInArrow(_cut(kind), _CUT), "values")
    sure, unsure = cut.where("part = 'value'").select("val", "n"), cut.where("part = 'unsure'").select("source", "val", "n")
    if unsure.isEmpty():
        return sure
    sums = lambda rows: rows.select("source", F.lit(kind).alias("kind"), F.inline("sums"))
    # one row for each source and task at most, however many fields it has
    own = cut.where("part = 'own'").join(unsure.select("source").distinct(), "source", "left_semi")
    scores = _scored(_added(sums(own), "source", "kind", "shape", "cand"), _added(sums(cut.where("part = 'all'")), "kind", "shape", "cand"))
    orders = staged(source_orders(scores).drop("kind"), "orders")
    total = orders.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    chosen = skew_join(unsure, orders, ["source"], "size", total, "left")
    return sure.unionByName(chosen.select("val", "n", "orders").mapInArrow(_choose(kind), "val string, n long"))


#: The packed fields of the tables: table, field, row id, source, kind.
PACKED_FIELDS = [("ai_citations", "author", "ref_id", "preprint_folder", "name"), ("human_citations", "author", "ref_id", "preprint_folder", "name"), ("human_candidates", "categories", "cand_id", "primary_category", "code")]


def packed_found(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, fld, row_id, pos, val) for every packed field of ``tables`` that holds two or more values, all tables in one pass."""
    rows = reduce(DataFrame.unionByName, [_picked(tables[tab], tab, row_id, fld, source, kind) for tab, fld, row_id, source, kind in PACKED_FIELDS])
    fld = F.create_map(*[F.lit(x) for tab, fld, *_ in PACKED_FIELDS for x in (tab, fld)])
    return split_fields(rows, 2).select("tab", fld[F.col("tab")].alias("fld"), "row_id", "pos", "val")
