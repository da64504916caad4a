"""SQL of the subpackage's queries, where SQL can express them."""

from __future__ import annotations

from refloom.llm.format_dups import SCHEMES

_P5 = r"""
with tidy as (
  select coalesce(nullif(lower(regexp_replace(stratum, '^\s+|\s+$', '', 'g')), ''), lower(regexp_replace(primary_category, '^\s+|\s+$', '', 'g'))) as cat, cand_id, id, rank from human_candidates
), one as (
  select * from tidy qualify row_number() over (partition by id order by rank, cand_id) = 1
), want as (
  select lower(stratum) as cat, target_share, min_rows, n_ai_in_stratum from stratum_targets
), ranked as (
  select o.cat, cand_id, id, rank, row_number() over (partition by o.cat order by rank, cand_id) as seat from one o
), sized as (
  select r.*, row_number() over (order by seat > min_rows, case when seat <= min_rows then 0 else (seat - 0.5::double) / target_share end, r.cat, seat) as place
  from ranked r join want w on w.cat = r.cat
), sample as (
  select cat as stratum, cand_id, id, cast(rank as bigint) as rank, seat from sized where place <= (select 2 * sum(n_ai_in_stratum) from want)
)"""

_P6 = rf"""
with bare as (
  select ref_id, regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]', '', 'g') as t,
    array_to_string(list_sort(list_filter(list_transform(str_split(regexp_replace(lower(normalized_id), '\b({SCHEMES})\s*:', chr(1) || '\1:', 'g'), chr(1)), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '')), ' ') as n
  from ai_citations where title is not null and normalized_id is not null
), grouped as (select ref_id, min(ref_id) over (partition by t, n) as least, count(*) over (partition by t, n) as copies from bare)"""

ORACLES: dict[str, str] = {
    "p5_sample": _P5 + " select * from sample",
    "p5_report": _P5
    + """, taken as (select stratum as cat, count(*) as n from sample group by all), available as (select cat, count(*) as n from one group by all)
    , rows as (
      select coalesce(w.cat, a.cat) as stratum, coalesce(w.target_share, 0.0)::double as target_share, coalesce(w.min_rows, 0)::bigint as min_rows, coalesce(a.n, 0) as available, coalesce(t.n, 0) as taken
      from want w full join available a on a.cat = w.cat left join taken t on t.cat = coalesce(w.cat, a.cat)
    ), wanted as (select *, cast(greatest(floor(target_share * (sum(taken) over ()) + 0.5), min_rows) as bigint) as wanted from rows)
    select *, greatest(wanted - taken, 0) as missed,
      case when target_share <= 0 then 'no target' when wanted <= taken then '' when available = 0 then 'no candidates' when available = taken then 'too few candidates' else 'seats went to others' end as reason
    from wanted""",
    "p6_found": _P6 + " select least as ref_id_a, ref_id as ref_id_b from grouped where ref_id > least",
    "p6_records": _P6 + " select ref_id, copies as n_copies from grouped where ref_id = least",
    # the tokens are counted in Spark alone; what any packing has to keep is not
    "p9_faults": "select capacity_id, (select count(*) from documents) as items, 0 as split_items, 0 as changed_items, 0 as overfull, 0 as uneven_windows from pack_capacities where capacity_tokens > 0",
}
