"""Registered queries of the core's training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.operators.orphan_refs import corpus_orphans, orphans_by_table_and_period
from refloom.operators.packed_values import PACKED_FIELDS, packed_found
from refloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_found({tab: table(spark, sf_dir, tab) for tab, *_ in PACKED_FIELDS})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_orphans(*(table(spark, sf_dir, t) for t in ("ai_citations", "ai_intext_citations", "ai_cross_citations")))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_table_and_period(p2_found(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report}

_P2 = r"""
with parent as (
  select ref_id, preprint_folder as folder, nullif(regexp_replace(cite_key, '^\s+|\s+$', '', 'g'), '') as k, loaded_at, removed_at, cited_in_text from ai_citations
), ref as (
  select 'ai_intext_citations' as tab, cit_id as row_id, paper_id as folder, nullif(regexp_replace(key, '^\s+|\s+$', '', 'g'), '') as k, extracted_at as tm from ai_intext_citations
  union all
  select 'ai_cross_citations', xref_id, citing_folder, nullif(regexp_replace(cite_key, '^\s+|\s+$', '', 'g'), ''), linked_at from ai_cross_citations
), seen as (
  select r.tab, r.row_id, r.tm, count(p.ref_id) as n, count(*) filter (where p.loaded_at <= r.tm and (p.removed_at is null or p.removed_at > r.tm)) as there, min(p.loaded_at) as first
  from ref r left join parent p on p.folder = r.folder and p.k = r.k
  where r.folder is not null and r.k is not null and r.tm is not null group by all
), found as (
  select tab, row_id, strftime(tm, '%Y-%m') as period, case when n = 0 then 'absent' when first > tm then 'late' else 'removed' end as reason from seen where there = 0
  union all
  select 'ai_citations', ref_id, strftime(loaded_at, '%Y-%m'), 'uncited' from parent p
  where cited_in_text = 'yes' and folder is not null and k is not null and loaded_at is not null
    and not exists (select 1 from ref r where r.tab = 'ai_intext_citations' and r.folder = p.folder and r.k = p.k)
)"""

ORACLES = {"p2_found": _P2 + " select tab, row_id, period, reason from found", "p2_report": _P2 + " select tab, period, reason, count(*) as n from found group by all"}
