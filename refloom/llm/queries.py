"""Registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.llm import bpe, entity_match, format_dups, mix_pack, name_variants, quota_sample, shared_spans, visual_forms
from refloom.session import staged, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.matches(table(spark, sf_dir, "ai_citations"), table(spark, sf_dir, "registry_records")).select("ref_id", "reg_id")


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.matches(table(spark, sf_dir, "ai_citations"), table(spark, sf_dir, "registry_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, sf_dir, "ai_citations"), table(spark, sf_dir, "doi_check_ai_flags_for_review"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.quota_sample(table(spark, sf_dir, "human_candidates"), table(spark, sf_dir, "stratum_targets"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample.quota_report(table(spark, sf_dir, "human_candidates"), table(spark, sf_dir, "stratum_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.copies(table(spark, sf_dir, "ai_citations"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.collapse(table(spark, sf_dir, "ai_citations"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_forms.same_look(table(spark, sf_dir, "human_citations"), "ref_id", ["author", "title"])


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_forms.with_consistent_form(table(spark, sf_dir, "human_citations").select("ref_id", "author", "title"), ["author", "title"]).select("ref_id", "author_form", "title_form")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


#: A mixture unlike the documents' own shares: as much of each source, but twice as much of papers' texts.
MIXTURE = {"tex": 2.0, "bbl": 1.0, "bib": 1.0, "abstract": 1.0, "readme": 1.0, "note": 1.0}


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_pack.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_pack.mixture_report(staged(mix_pack.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"), MIXTURE), "packed"))


def p9_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, caps = mix_pack.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_capacities")
    return mix_pack.packing_faults(items, staged(mix_pack.pack_items(items, caps, MIXTURE), "packed"), caps)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.span_pairs(table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p5_sample": p5_sample, "p5_report": p5_report, "p6_found": p6_found, "p6_records": p6_records, "p7_found": p7_found, "p7_forms": p7_forms, "p8_ids": p8_ids, "p9_pack": p9_pack, "p9_mixture": p9_mixture, "p9_faults": p9_faults, "p10_found": p10_found, "p10_share": p10_share}
