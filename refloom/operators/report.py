"""The summary as JSON and as a Markdown table."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions.columns import formatted, formatted_difference
from refloom.operators.metrics import METRICS


def summary_table(summary: DataFrame, differences: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row per metric: label, kind, means of the three groups, difference and interval."""
    spark = summary.sparkSession
    names = spark.createDataFrame([(i, *m) for i, m in enumerate(METRICS)], "place int, metric string, label string, kind string")
    wide = summary.groupBy("metric").agg(*(F.max(F.when(F.col("grp") == g, F.col("mean"))).alias(g) for g in ("ai_all", "ai", "human")))
    return names.join(wide, "metric", "left").join(differences, "metric", "left").join(intervals, "metric", "left").orderBy("place")


def markdown(table: DataFrame, counts: dict[str, int]) -> str:
    """The table in Markdown; it has as many rows as there are metrics."""
    kind = F.col("kind")
    cells = table.select("label", *(formatted(F.col(g), kind).alias(g) for g in ("ai_all", "ai", "human")), formatted_difference(F.col("diff_mean"), F.col("low"), F.col("high"), kind).alias("d")).collect()
    head = ["# Summary of paper-level citation metrics", "", f"AI papers: {counts['ai_all']} (matched: {counts['ai']}); human papers: {counts['human']}.", "Values are means across papers. Δ is AI minus human with a 95% bootstrap interval.", "", "| Metric | AI (all) | AI (matched) | Human | Δ (95% CI) |", "|---|---|---|---|---|"]
    return "\n".join([*head, *("| " + " | ".join(r) + " |" for r in cells)]) + "\n"


def paper_counts(metrics: DataFrame) -> DataFrame:
    """One row: the papers of each group, ai_all, ai_matched (with a subject) and human."""
    is_ai = F.col("corpus") == "ai"
    return metrics.agg(F.count_if(is_ai).alias("ai_all"), F.count_if(is_ai & (F.coalesce("subject", F.lit("")) != "")).alias("ai_matched"), F.count_if(F.col("corpus") == "human").alias("human"))


def summary_json(table: DataFrame, histograms: dict[str, DataFrame], single: dict[str, DataFrame] | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """One row, one column ``json``: the metrics, the named histograms and the frames of a single row (such as n_papers and ai_internal_citations) as one document.

    ``statuses`` (status, n) becomes the block ai_doi_check. All parts are as small as
    there are metrics, bins or statuses; they are put together in the cluster.
    """
    doc = table.agg(F.sort_array(F.collect_list(F.struct("place", "metric", "label", "kind", "ai_all", "ai", "human", "diff_mean", "low", "high"))).alias("metrics"))
    for name, h in histograms.items():
        doc = doc.crossJoin(h.agg(F.sort_array(F.collect_list(F.struct(*h.columns))).alias(name)))
    for name, one in (single or {}).items():
        doc = doc.crossJoin(one.select(F.struct(*one.columns).alias(name)))
    if statuses is not None:
        doc = doc.crossJoin(statuses.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("ai_doi_check")))
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("json"))


def publish(files: list[str], folder: str) -> None:
    """Copies of finished files for a dashboard's folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for f in files:
        shutil.copyfile(f, Path(folder) / Path(f).name)
