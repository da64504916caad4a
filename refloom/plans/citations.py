"""Registered queries of the citation operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import columns as C
from refloom.operators import bootstrap, dedupe, linking, metrics, sampling
from refloom.operators.context import with_clamped_depth, with_running_marks
from refloom.plans.views import CTES, ai_tables, human_tables, planted
from refloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_M = [k for k, *_ in metrics.METRICS]
_ALL = _M + [f"share_section_{k}" for k in C.SECTION_KINDS] + ["share_refs_with_year", "share_refs_arxiv", "share_refs_doi"]


def _round(names: list[str]) -> str:
    return ", ".join(n if n.startswith("n_") else f"round({n}, 6) as {n}" for n in names)


def _metrics(spark: SparkSession, sf_dir: str, names: list[str] | None = None, gathered: bool = False) -> DataFrame:
    return metrics.paper_metrics(*planted(spark, sf_dir, gathered), names)


@query(f"{CTES} select corpus, paper_id, subject, year, {_round(_ALL)} from m")
def paper_metrics(spark, sf_dir):
    return metrics.rounded(_metrics(spark, sf_dir))


@query(f"{CTES} select paper_id, count(*) as n_references from rall group by all")
def paper_ref_counts(spark, sf_dir):
    return planted(spark, sf_dir)[1].groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_references"))


@query(f"{CTES} select paper_id, count(*) as n_references from r group by all")
def paper_printed_refs(spark, sf_dir):
    return metrics.printed(planted(spark, sf_dir)[1]).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_references"))


@query(f"{CTES} select * from cmd")
def cite_command_dedupe(spark, sf_dir):
    return metrics.commands(planted(spark, sf_dir)[2])


def _command(names: list[str]):
    return lambda spark, sf_dir: metrics.rounded(metrics.command_metrics(planted(spark, sf_dir)[2]).select("paper_id", *names))


for _name, _cols in {"pinpoint_shares": ["share_pinpoint_specific", "share_pinpoint_result", "share_pinpoint_any"], "section_shares": [f"share_section_{k}" for k in C.SECTION_KINDS] + ["share_intro_or_front", "share_in_proof"], "group_size_stats": ["mean_group_size", "share_group_3plus"], "first_quarter_share": ["share_first_quarter"]}.items():
    QUERIES[_name] = _command(_cols)
    ORACLES[_name] = f"{CTES} select paper_id, {_round(_cols)} from mc"


@query(f"{CTES} select paper_id, round(citations_per_reference, 6) as citations_per_reference from m")
def citations_per_reference(spark, sf_dir):
    return metrics.rounded(_metrics(spark, sf_dir, ["citations_per_reference"]).select("paper_id", "citations_per_reference"))


@query(f"{CTES} select paper_id, {_round(['share_refs_cited_once', 'max_share_one_reference'])} from mu")
def ref_use_concentration(spark, sf_dir):
    uses = metrics.reference_metrics(*planted(spark, sf_dir)).where("max_share_one_reference is not null")
    return metrics.rounded(uses.select("paper_id", "share_refs_cited_once", "max_share_one_reference"))


_AGE = ["median_reference_age", "share_refs_recent_3y", "share_refs_classic_30y", "share_refs_with_year", "share_refs_arxiv", "share_refs_doi"]


@query(f"{CTES} select paper_id, {_round(_AGE)} from mr")
def reference_age_metrics(spark, sf_dir):
    papers, refs, _ = planted(spark, sf_dir)
    return metrics.rounded(metrics.reference_metrics(papers, refs).select("paper_id", *_AGE))


_LONG = f""", g as (select 'ai_all' as grp, * from m where corpus = 'ai' union all select 'ai', * from m where corpus = 'ai' and subject <> '' union all select 'human', * from m where corpus = 'human'),
long as ({" union all ".join(f"select grp, paper_id, '{k}' as metric, cast({k} as double) as value from g where {k} is not null" for k in _M)})"""


@query(f"{CTES} {_LONG} select metric, grp, count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as median from long group by all")
def corpus_summary(spark, sf_dir):
    return metrics.rounded(metrics.corpus_summary(_metrics(spark, sf_dir, _M)))


@query(f"{CTES} {_LONG} select metric, round(avg(value) filter (where grp = 'ai') - avg(value) filter (where grp = 'human'), 6) as diff_mean from long group by all")
def diff_of_means(spark, sf_dir):
    return metrics.rounded(metrics.difference_of_means(_metrics(spark, sf_dir, _M)))


@query(CTES + " select subject, count(*) filter (where corpus = 'ai') as n_ai, count(*) filter (where corpus = 'human') as n_human, " + ", ".join(f"round(avg({k}) filter (where corpus = '{c}'), 6) as {k}_{c}" for k in metrics.BY_SUBJECT for c in ("ai", "human")) + " from m where corpus = 'human' or subject <> '' group by subject having n_ai > 0")
def by_subject(spark, sf_dir):
    return metrics.rounded(metrics.by_subject(_metrics(spark, sf_dir, metrics.BY_SUBJECT)))


_GAP = "share_in_proof"


@query(CTES + f", b as (select subject, count(*) filter (where corpus = 'ai') as n_ai, count(*) filter (where corpus = 'human') as n_human, avg({_GAP}) filter (where corpus = 'ai') as ai, avg({_GAP}) filter (where corpus = 'human') as human from m where corpus = 'human' or subject <> '' group by subject) select subject, n_ai, n_human, round(ai, 6) as ai, round(human, 6) as human, round(ai - human, 6) as gap from b where n_ai >= 10 and n_human >= 10")
def subject_gaps(spark, sf_dir):
    return metrics.rounded(metrics.subject_gaps(metrics.by_subject(_metrics(spark, sf_dir, metrics.BY_SUBJECT)), _GAP))


@query(f"{CTES} {_LONG}, d as (select metric, round(avg(value) filter (where grp = 'ai') - avg(value) filter (where grp = 'human'), 6) as diff_mean from long group by all) select * from d where metric like 'share%' or metric like 'max_share%'")
def metric_gaps(spark, sf_dir):
    return metrics.rounded(metrics.metric_gaps(metrics.difference_of_means(_metrics(spark, sf_dir, _M))))


_HIST = f"{CTES}, h as (select r.corpus, least(age, 100) as age, count(*) as n from r join p using (paper_id) where age >= 0 and (r.corpus = 'human' or subject <> '') group by all)"


@query(f"{_HIST} select * from h")
def age_histogram(spark, sf_dir):
    return metrics.age_histogram(*planted(spark, sf_dir)[:2])


@query(f"{_HIST}, b as (select corpus, case when age <= 3 then '0-3' when age <= 10 then '4-10' when age <= 20 then '11-20' when age <= 30 then '21-30' when age <= 50 then '31-50' else '51+' end as band, sum(n) as n from h group by all) select corpus, band, round(n / sum(n) over (partition by corpus), 6) as part from b")
def age_bands(spark, sf_dir):
    return metrics.rounded(metrics.age_bands(metrics.age_histogram(*planted(spark, sf_dir)[:2])))


_CM = f"{CTES}, k as (select cmd.*, corpus from cmd join p using (paper_id) where corpus = 'human' or subject <> '')"


@query(f"{_CM} select corpus, pinpoint_class, count(*) as n from k group by all")
def pinpoint_mix(spark, sf_dir):
    papers, _, cites = planted(spark, sf_dir)
    return metrics.pinpoint_mix(papers, cites)


@query(f"{_CM}, s as (select corpus, case when pinpoint_class = 'numbered' then 'other' else pinpoint_class end as pinpoint_class, count(*) as n from k group by all) select corpus, pinpoint_class, round(n / sum(n) over (partition by corpus), 6) as part from s")
def pinpoint_mix_shown(spark, sf_dir):
    papers, _, cites = planted(spark, sf_dir)
    return metrics.rounded(metrics.pinpoint_shares_shown(metrics.pinpoint_mix(papers, cites)))


@query(f"{_CM}, n as (select corpus, cast(least(floor(position * 20), 19) as int) as bin, count(*) as n from k group by all), d as (select corpus, cast(b.b as int) as bin, coalesce(n.n, 0) as n from (select distinct corpus from k) x cross join range(20) b(b) left join n using (corpus, bin)) select corpus, bin, n, round(n / sum(n) over (partition by corpus), 6) as part from d".replace("left join n using (corpus, bin)", "left join n on n.corpus = x.corpus and n.bin = b.b").replace("select corpus, cast(b.b as int)", "select x.corpus, cast(b.b as int)"))
def position_histogram(spark, sf_dir):
    papers, _, cites = planted(spark, sf_dir)
    return metrics.rounded(metrics.position_histogram(papers, cites))


@query(f"{CTES} select corpus, cast(case when share_pinpoint_specific = 0 then 0 else least(5, 1 + floor(share_pinpoint_specific * 5 - 1e-9)) end as int) as bin, count(*) as n from m where (corpus = 'human' or subject <> '') and share_pinpoint_specific is not null group by all")
def pinpoint_paper_hist(spark, sf_dir):
    return metrics.pinpoint_paper_histogram(_metrics(spark, sf_dir, ["share_pinpoint_specific"]))


_REPS = 2000
_POISSON = " + ".join(f"(u >= {x!r})::int" for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))


@query(f"""{CTES} {_LONG}, d as (select metric, grp, value, rep, cast(('0x' || md5('20261007:' || metric || ':' || paper_id || ':' || rep)[1:8]) as bigint) / 4294967296.0::double as u from long cross join range({_REPS}) t(rep) where grp <> 'ai_all'),
w as (select *, {_POISSON} as weight from d),
s as (select metric, rep, sum(weight * value) filter (where grp = 'ai') / sum(weight) filter (where grp = 'ai') - sum(weight * value) filter (where grp = 'human') / sum(weight) filter (where grp = 'human') as diff from w group by all),
o as (select *, row_number() over (partition by metric order by diff) - 1 as place from s)
select metric, round(max(diff) filter (where place = {int(0.025 * _REPS)}), 6) as low, round(max(diff) filter (where place = {int(0.975 * _REPS) - 1}), 6) as high from o group by all""")
def bootstrap_ci(spark, sf_dir):
    return metrics.rounded(bootstrap.interval(metrics.long_metrics(_metrics(spark, sf_dir, _M)), _REPS))


@query()
def bootstrap_ci_exact(spark, sf_dir):
    return bootstrap.interval_exact(metrics.long_metrics(_metrics(spark, sf_dir, _M, True)), _REPS)


_LABEL = """with t as (select ref_id as pos, preprint_folder as paper_id, coalesce(nullif(doi, ''), nullif(arxiv_id, '')) as item, journal_or_venue as category from ai_citations), cache as (select item, max(category) as category from t where item is not null group by all),
o as (select category, count(*) as overall from cache where coalesce(category, '') <> '' group by all),
k as (select paper_id, c.category, count(*) as n, min(pos) as pos, any_value(overall) as overall from t join cache c using (item) join o on o.category = c.category group by all),
b as (select paper_id, category as subject, n as most, cast(sum(n) over (partition by paper_id) as bigint) as n, row_number() over (partition by paper_id order by n desc, overall desc, pos) as place from k)
select paper_id, coalesce(subject, '') as subject, coalesce(n, 0) as n, case when n > 0 then printf('%.2f', most / n) else '' end as subject_share from (select distinct paper_id from t) left join (select * from b where place = 1) using (paper_id)"""


@query(_LABEL)
def modal_label_tiebreak(spark, sf_dir):
    refs = table(spark, sf_dir, "ai_citations").select("ref_id", F.col("preprint_folder").alias("paper_id"), F.coalesce(F.nullif("doi", F.lit("")), F.nullif("arxiv_id", F.lit(""))).alias("item"), F.col("journal_or_venue").alias("category")).withColumnRenamed("ref_id", "pos")
    cache = refs.where("item is not null").groupBy("item").agg(F.max("category").alias("category"))
    return linking.modal_label(refs.drop("category"), cache)


_RANK = "select c_mktsegment as stratum, c_custkey as id, row_number() over (partition by c_mktsegment order by md5(concat('20261007:', cast(c_custkey as string))), c_custkey) - 1 as rank from customer"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_rank(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("id")), "stratum", "id")


@query(_RANK)
def seeded_rank(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query()
def shuffled_rank(spark, sf_dir):
    return sampling.shuffled_rank(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("id")), "stratum", "id")


@query(f"with k as ({_RANK}), u as (select *, id % 7 <> 0 as usable, sum((id % 7 <> 0)::int) over (partition by stratum order by rank rows unbounded preceding) as so_far from k) select stratum, rank, id, case when usable and so_far <= 2 * length(stratum) then 'yes' else 'no' end as selected from u")
def quota_select(spark, sf_dir):
    log = _ranked(spark, sf_dir).withColumn("usable", F.col("id") % 7 != 0).withColumn("target", 2 * F.length("stratum"))
    return sampling.select_quota(log, "stratum", "rank", "usable", "target").select("stratum", "rank", "id", "selected")


@query(f"""with k as ({_RANK}), z as (select *, count(*) over (partition by stratum) as size from k), x as (select *, id % 5 = 0 and 3 * rank <= 2 * size as logged, case when id % 3 = 0 and 10 * rank <= 9 * size then id % 4 end as n_references from z),
l as (select *, max(rank) filter (where logged or n_references is not null) over (partition by stratum) as last from x)
select stratum, rank, id, case when n_references is null then 'failed_unrecorded' when n_references > 0 then 'included' else 'no_bibliography' end as status, coalesce(n_references, 0) as n_references from l where rank <= last and not logged""")
def log_gap_repair(spark, sf_dir):
    """The log goes to two thirds of a stratum, the sources to nine tenths of it."""
    cand = _ranked(spark, sf_dir)
    sized = cand.join(cand.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), "stratum")
    return sampling.repair_log(cand, sized.where("id % 5 = 0 and 3 * rank <= 2 * size").drop("size"), sized.where("id % 3 = 0 and 10 * rank <= 9 * size").select("id", (F.col("id") % 4).alias("n_references")))


@query("select cand_id, id from human_candidates c where not exists (select 1 from human_citations d where d.preprint_folder = c.id)")
def cache_antijoin(spark, sf_dir):
    """The candidates whose references have not been extracted yet."""
    done = table(spark, sf_dir, "human_citations").select(F.col("preprint_folder").alias("id"))
    return dedupe.not_done(table(spark, sf_dir, "human_candidates"), done, ["id"]).select("cand_id", "id")


@query(f"with k as ({_RANK}), u as (select *, coalesce(sum((id % 7 <> 0)::int) over (partition by stratum order by rank rows between unbounded preceding and 1 preceding), 0) as before, 3 * length(stratum) as quota from k) select stratum, rank, id, cast(before // quota + 1 as int) as pass from u where before // quota + 1 <= 2")
def two_pass_walk(spark, sf_dir):
    cand = _ranked(spark, sf_dir).withColumn("n_ai_in_stratum", 3 * F.length("stratum")).withColumn("usable", F.col("id") % 7 != 0)
    return sampling.two_pass_walk(cand, "usable").select("stratum", "rank", "id", "pass")


for _name, _f, _dir in (("first_wins_dedupe", dedupe.first_wins, "asc"), ("last_wins_dedupe", dedupe.last_wins, "desc")):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: f(table(spark, sf_dir, "ai_citations").select("preprint_folder", "cite_key", "ref_id", "title", "year"), ["preprint_folder", "cite_key"], ["ref_id"])
    ORACLES[_name] = f"select preprint_folder, cite_key, ref_id, title, year from ai_citations qualify row_number() over (partition by preprint_folder, cite_key order by ref_id {_dir}) = 1"

_STATE = """select event_id, user_id, count(*) filter (where event_type = 'view') over w as sections, last_value(case when event_type = 'view' then event_id end ignore nulls) over w as section from events window w as (partition by user_id order by event_id rows unbounded preceding)"""


@query(_STATE)
def running_section_state(spark, sf_dir):
    marked = with_running_marks(table(spark, sf_dir, "events"), F.col("event_type") == "view", F.col("event_id"), ["user_id"], ["event_id"], "sections", "section")
    return marked.select("event_id", "user_id", "sections", "section")


_DELTA = "case when event_id % 3 = 0 then 1 when event_id % 3 = 1 then -1 else 0 end"


@query(f"with s as (select event_id, user_id, sum({_DELTA}) over (partition by user_id order by event_id rows unbounded preceding) as s from events) select event_id, user_id, cast(s - least(0, min(s) over (partition by user_id order by event_id rows unbounded preceding)) as bigint) as depth from s")
def clamped_depth(spark, sf_dir):
    return with_clamped_depth(table(spark, sf_dir, "events"), F.expr(_DELTA), ["user_id"], ["event_id"], "depth").select("event_id", "user_id", "depth")


_WORDS = r"array_to_string(regexp_extract_all(lower(strip_accents(regexp_replace(coalesce({}, ''), '<[^>]+>|\\[a-zA-Z]+', ' ', 'g'))), '[a-z0-9]+'), ' ')"


@query(f"select ref_id, {_WORDS.format('title')} as words from ai_citations")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "ai_citations").select("ref_id", C.norm_text(F.col("title")).alias("words"))


@query(f"with w as (select ref_id, list_filter(str_split({_WORDS.format('title')}, ' '), lambda x: x <> '') as want, list_filter(str_split({_WORDS.format('raw_reference')}, ' '), lambda x: x <> '') as have from ai_citations) select ref_id, case when len(want) >= 2 and len(have) > 0 then round_even(len(list_filter(want, lambda x: list_contains(have, x))) / len(want), 3) end as coverage from w")
def raw_coverage(spark, sf_dir):
    words = table(spark, sf_dir, "ai_citations").select("ref_id", C.norm_text(F.col("raw_reference")).alias("r"), C.norm_text(F.col("title")).alias("t"))
    return words.select("ref_id", C.raw_coverage(F.col("r"), F.col("t")).alias("coverage"))


@query()
def title_similarity(spark, sf_dir):
    return table(spark, sf_dir, "doi_check_ai_flags_for_review").select("flag_id", C.title_similarity(F.col("title_cited"), F.col("title_registered")).alias("similarity"))


@query("select ref_id, case when try_cast(left(trim(year), 4) as int) between 1600 and 2030 then try_cast(left(trim(year), 4) as int) end as y from ai_citations")
def year_of(spark, sf_dir):
    return table(spark, sf_dir, "ai_citations").select("ref_id", C.year_of(F.col("year")).alias("y"))


@query(r"select ref_id, coalesce(nullif(replace(regexp_replace(regexp_extract(coalesce(doi, ''), '(10\.\d{4,9}/[^\s},]+)', 1), '[.;)]+$', ''), '\_', '_'), ''), nullif(replace(regexp_replace(regexp_extract(coalesce(url, ''), '(10\.\d{4,9}/[^\s},]+)', 1), '[.;)]+$', ''), '\_', '_'), ''), '') as found from ai_citations")
def find_doi(spark, sf_dir):
    return table(spark, sf_dir, "ai_citations").select("ref_id", C.find_doi(F.col("doi"), F.col("url")).alias("found"))


@query(r"select ref_id, regexp_replace(regexp_extract(coalesce(normalized_id, ''), '(?i)arxiv(?:\.org/(?:abs|pdf)/|[:\s]\s*)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})', 1), 'v\d+$', '') as found from ai_citations")
def find_arxiv(spark, sf_dir):
    return table(spark, sf_dir, "ai_citations").select("ref_id", C.find_arxiv(F.col("normalized_id")).alias("found"))


@query("select ref_id, case when coalesce(doi, '') <> '' then 'doi:' || lower(doi) when coalesce(arxiv_id, '') <> '' then 'arxiv:' || lower(arxiv_id) when trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) <> '' then 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) else '' end as nid from ai_citations")
def norm_id(spark, sf_dir):
    return table(spark, sf_dir, "ai_citations").select("ref_id", C.norm_id(F.col("doi"), F.col("arxiv_id"), F.col("title")).alias("nid"))


@query("select ref_id, doi as found from ai_citations where coalesce(doi, '') <> ''")
def normalize_doi(spark, sf_dir):
    """Identifiers written as links with escapes come back as they were."""
    d = table(spark, sf_dir, "ai_citations").where("coalesce(doi, '') <> ''")
    return d.select("ref_id", C.normalize_doi(F.concat(F.lit(" https://doi.org/"), F.replace("doi", F.lit("/"), F.lit("%2F")), F.lit(".pdf"))).alias("found"))


@query("select cit_id, pinpoint_class as given, pinpoint_class as found from ai_intext_citations")
def classify_postnote(spark, sf_dir):
    return table(spark, sf_dir, "ai_intext_citations").select("cit_id", F.col("pinpoint_class").alias("given"), C.classify_postnote(F.col("postnote")).alias("found"))


_CHECK = f"""with j as (select flag_id, {_WORDS.format('title_cited')} as a, {_WORDS.format('title_registered')} as b, first_author_cited, first_author_registered, status from doi_check_ai_flags_for_review)
select status, count(*) as n, count(*) filter (where a <> '' and b <> '' and a = b) as equal_titles from j group by all"""


@query(_CHECK)
def doi_status_counts(spark, sf_dir):
    f = table(spark, sf_dir, "doi_check_ai_flags_for_review").withColumns({"a": C.norm_text(F.col("title_cited")), "b": C.norm_text(F.col("title_registered"))})
    return f.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") != "") & (F.col("b") != "") & (F.col("a") == F.col("b"))).alias("equal_titles"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry records for the DOIs of the flags, as they are recorded there."""
    f = dedupe.first_wins(table(spark, sf_dir, "doi_check_ai_flags_for_review").where("doi is not null"), ["doi"], ["flag_id"])
    years = F.transform(F.filter(F.split(F.coalesce("years_registered", F.lit("")), " "), lambda y: y != ""), lambda y: y.cast("int"))
    return f.select("doi", F.when(F.col("status") == "not_found", "not_found").otherwise("crossref").alias("registry"), F.lit("journal-article").alias("type"), F.col("title_registered").alias("title"), years.alias("years"), F.col("first_author_registered").alias("first_author"), F.lit("").alias("venue"))


@query()
def doi_match_status(spark, sf_dir):
    return linking.doi_check(table(spark, sf_dir, "ai_citations"), _registry(spark, sf_dir))


@query()
def flagged_rollup(spark, sf_dir):
    refs = table(spark, sf_dir, "ai_citations")
    checked = linking.doi_check(refs, _registry(spark, sf_dir)).withColumn("order", F.concat_ws("/", "preprint_folder", F.coalesce("cite_key", F.lit(""))))
    return linking.flagged_dois(checked, "order")


_LINKED = f"""with r as (select a.*, b.preprint_folder as next_folder, b.preprint_title as next_title, {_WORDS.format('b.preprint_title')} as next_words from ai_citations a left join ai_citations b on b.ref_id = a.ref_id + 1),
meta as (select preprint_folder, arg_max(preprint_title, ref_id) as m_title, arg_max(preprint_date, ref_id) as m_date, min(ref_id) as first from ai_citations group by all),
titles as (select {_WORDS.format('m_title')} as t, arg_max(preprint_folder, first) as by_title from meta group by all),
k as (select r.*, case ref_id % 5 when 0 then case when next_folder is null then 'other' else 'repo_link' end when 1 then 'repo_link_unknown_folder' when 2 then case when next_title is not null then 'title' else 'other' end else 'other' end as method from r where ref_id % 5 < 4)
select k.preprint_folder as citing_folder, cite_key, case method when 'repo_link' then next_folder when 'repo_link_unknown_folder' then 'no-such-folder' when 'title' then by_title else '' end as cited_folder,
  case method when 'repo_link' then 'repo_link' when 'repo_link_unknown_folder' then 'repo_link_unknown_folder' when 'title' then 'title' else 'openai_other' end as match_method,
  case when (case method when 'repo_link' then next_folder when 'title' then by_title else '' end) = k.preprint_folder then 'yes' else 'no' end as self_citation,
  coalesce(case method when 'repo_link' then m1.m_date when 'title' then m2.m_date end, '') as cited_date
from k left join titles on t = next_words left join meta m1 on m1.preprint_folder = next_folder left join meta m2 on m2.preprint_folder = by_title"""


@query(_LINKED)
def cross_citation_link(spark, sf_dir):
    """Of five references in turn one links to the folder of the next reference, one to no folder, one names the next one's title with the publisher, one the publisher alone, one nothing."""
    a = table(spark, sf_dir, "ai_citations")
    after = a.select((F.col("ref_id") - 1).alias("ref_id"), F.col("preprint_folder").alias("next_folder"), F.col("preprint_title").alias("next_title"))
    turn = F.col("ref_id") % 5
    link = F.when((turn == 0) & F.col("next_folder").isNotNull(), F.concat(F.lit(linking.LINK_HEAD), "next_folder", F.lit("/main.tex"))).when(turn == 1, linking.LINK_HEAD + "no-such-folder/x")
    named = (turn == 2) | (turn == 3) | ((turn == 0) & F.col("next_folder").isNull())
    refs = a.join(after, "ref_id", "left").withColumns({"url": F.coalesce(link, F.lit("")), "author": F.when(named, F.lit(linking.PUBLISHER.title())).otherwise("Someone Else"), "title": F.when(turn == 2, F.col("next_title")).otherwise("No paper of this name"), "note": F.lit(""), "raw_reference": F.lit("")})
    return linking.cross_citations(refs).select("citing_folder", "cite_key", "cited_folder", "match_method", "self_citation", "cited_date")


@query("select count(*) as n_references, count(distinct citing_folder) as citing_papers, count(distinct cited_folder) as cited_papers, count(*) filter (where cited_date > citing_date) as cites_later_release, count(*) filter (where self_citation = 'yes') as self_citations from ai_cross_citations where match_method in ('repo_link', 'title')")
def internal_citation_summary(spark, sf_dir):
    return linking.internal_summary(table(spark, sf_dir, "ai_cross_citations"))


_AI = """with r0 as (select preprint_folder as paper_id, cite_key, source_format, cited_in_text, doi, arxiv_id, case when try_cast(left(trim(year), 4) as int) between 1600 and 2030 then try_cast(left(trim(year), 4) as int) end as y from ai_citations qualify row_number() over (partition by preprint_folder, cite_key order by ref_id) = 1),
r as (select *, case when y <= 2027 then 2026 - y end as age from r0 where source_format = 'bibitem' or cited_in_text = 'yes'), cmd as (select paper_id, cite_index, pinpoint_class from ai_intext_citations qualify row_number() over (partition by paper_id, cite_index order by cit_id) = 1)
select p.paper_id, coalesce(n, 0) as n_references, median_age as median_reference_age, coalesce(k, 0) as n_cite_commands, round(specific, 6) as share_pinpoint_specific from (select distinct preprint_folder as paper_id from ai_citations) p
left join (select paper_id, count(*) as n, median(age) as median_age from r group by all) using (paper_id) left join (select paper_id, count(*) as k, avg((pinpoint_class in ('result','location','page','numbered'))::int) as specific from cmd group by all) using (paper_id)"""


@query(_AI)
def ai_paper_metrics(spark, sf_dir):
    return metrics.rounded(metrics.paper_metrics(*ai_tables(spark, sf_dir))).select("paper_id", "n_references", "median_reference_age", "n_cite_commands", "share_pinpoint_specific")


_HUMAN = """with c as (select id, published from human_candidates qualify row_number() over (partition by id order by cand_id desc) = 1),
r as (select preprint_folder as paper_id, cast(left(published, 4) as int) as cy, case when try_cast(left(trim(year), 4) as int) between 1600 and 2030 then try_cast(left(trim(year), 4) as int) end as y, doi from (select * from human_citations qualify row_number() over (partition by preprint_folder, cite_key order by ref_id) = 1) h join c on c.id = h.preprint_folder)
select paper_id, count(*) as n_references, median(case when y <= cy + 1 then cy - y end) as median_reference_age, round(avg((coalesce(doi, '') <> '')::int), 6) as share_refs_doi from r group by all"""


@query(_HUMAN)
def human_reference_metrics(spark, sf_dir):
    papers, refs = human_tables(spark, sf_dir)
    return metrics.rounded(metrics.reference_metrics(papers, refs)).select("paper_id", "n_references", "median_reference_age", "share_refs_doi")


@query("select distinct preprint_folder, regexp_extract(preprint_folder, '-(\\w+)-(\\d{1,2})-(\\d{4})$', 3) as year, preprint_date as date from ai_citations")
def folder_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "ai_citations").select("preprint_folder").distinct()
    date = C.folder_date(F.col("preprint_folder"))
    return d.select("preprint_folder", F.substring(date, 1, 4).alias("year"), date.alias("date"))

