"""In-text citations with their context: tokens of a body, and running state over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions import columns as C
from refloom.functions.latex import tokens

_TOKENS = "paper_id string, length long, offset long, token string, title string, command string, cite_keys array<string>, postnote string, before string, after string"


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        rows = [{"paper_id": p, "length": max(len(b), 1), **t} for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if b for t in tokens(b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def body_tokens(bodies: DataFrame) -> DataFrame:
    """The tokens of ``bodies`` (paper_id, body), offsets in characters."""
    return bodies.select("paper_id", "body").mapInArrow(_tokenize, _TOKENS)


def with_clamped_depth(df: DataFrame, delta: F.Column, partition: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the clamped running depth of ``delta`` (+1, -1, 0) as ``name``."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumn("__sum", F.sum(delta).over(w))
    return summed.withColumn(name, F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w))).drop("__sum")


def with_running_marks(df: DataFrame, mark: F.Column, value: F.Column, partition: list[str], order: list[str], count: str, last: str) -> DataFrame:
    """``df`` with the number of marked rows so far as ``count`` and the last marked row's value as ``last``."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({count: F.count_if(mark).over(w), last: F.last(F.when(mark, value), True).over(w)})


def intext_citations(bodies: DataFrame) -> DataFrame:
    """One row per key of each citation command, with section, proof, abstract, pinpoint and position.

    All running state comes from windows in the order of the text: the last
    section token, the first appendix token, the clamped depth of proofs, the
    last border of an abstract. A command without keys takes a number but gives no
    row. Papers without citations give none.
    """
    t = body_tokens(bodies)
    w = W.partitionBy("paper_id").orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    tok = F.col("token")
    t = with_clamped_depth(t, F.when(tok == "begin_proof", 1).when(tok == "end_proof", -1).otherwise(0), ["paper_id"], ["offset"], "proofs")
    t = with_running_marks(t, tok == "section", F.col("title"), ["paper_id"], ["offset"], "sections", "section_title").withColumn("appendices", F.count_if(tok == "appendix").over(w))
    kind = F.when(tok == "section", C.section_kind(F.col("title"), F.col("sections"), F.col("appendices") > 0)).when(tok == "appendix", "appendix")
    t = t.withColumn("kind", F.coalesce(F.last(kind, True).over(w), F.lit("front"))).withColumn("section_title", F.coalesce("section_title", F.lit("")))
    t = t.withColumn("in_abstract", F.coalesce(F.last(F.when(tok == "begin_abstract", True).when(tok == "end_abstract", False), True).over(w), F.lit(False)))
    t = t.withColumn("cite_index", F.count_if(tok == "cite").over(w)).where("token = 'cite'")
    rows = t.select("*", F.posexplode("cite_keys").alias("key_pos", "key"))
    return rows.select("paper_id", F.col("cite_index").cast("int").alias("cite_index"), "command", "key", F.size("cite_keys").alias("group_size"), "postnote", C.classify_postnote(F.col("postnote")).alias("pinpoint_class"), F.when(C.prose_pinpoint(F.col("before"), F.col("after")), "yes").otherwise("no").alias("prose_pinpoint"), F.col("sections").cast("int").alias("section_number"), F.substring("section_title", 1, 120).alias("section_title"), F.when(F.col("in_abstract"), "abstract").otherwise(F.col("kind")).alias("section_kind"), F.when(F.col("proofs") > 0, "yes").otherwise("no").alias("in_proof"), F.bround(F.col("offset") / F.col("length"), 4).alias("position"))
