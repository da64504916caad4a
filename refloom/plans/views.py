"""Papers, references and in-text rows, from the domain tables and from the order tables given their shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators.dedupe import first_wins, last_wins
from refloom.session import table

# The order tables in the shapes of the domain, in SQL that both engines read.
P = """select o_orderkey as paper_id, case when o_orderkey % 3 = 0 then 'ai' else 'human' end as corpus, case when o_orderkey % 20 = 0 then '' else o_orderpriority end as subject,
  cast(case when o_orderkey % 3 = 0 then 2026 else year(o_orderdate) + 25 end as int) as citing_year from {orders} where o_orderkey in (select l_orderkey from {lineitem})"""
R0 = """select l_orderkey as paper_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as pos, concat('k', cast(l_linenumber as string)) as cite_key,
  case when l_partkey % 17 = 0 then '' when l_partkey % 19 = 0 then 'n.d.' else cast(2026 - l_partkey % 80 as string) end as year, case when l_suppkey % 2 = 0 then concat('10.1000/', cast(l_partkey as string)) else '' end as doi,
  case when l_suppkey % 3 = 0 then concat('2001.', lpad(cast(l_partkey % 100000 as string), 5, '0')) else '' end as arxiv_id, case when l_returnflag = 'A' then 'bibitem' else 'bibtex' end as source_format,
  case when l_linestatus = 'O' then 'yes' else 'no' end as cited_in_text, l_linenumber, l_partkey, l_suppkey, l_returnflag, cast(l_quantity as int) as qty from {lineitem}"""
# The rows of a command differ, so that taking the first one shows.
C = """select c.paper_id, c.cite_index, j.j as pos, concat('k', cast(1 + (c.l_linenumber + j.j - 1) % 7 as string)) as cite_key, c.group_size,
  case (c.l_partkey + j.j) % 6 when 0 then 'none' when 1 then 'result' when 2 then 'location' when 3 then 'page' when 4 then 'numbered' else 'other' end as pinpoint_class,
  case when (c.l_suppkey + j.j) % 5 = 0 then 'yes' else 'no' end as prose_pinpoint, c.section_kind, case when j.j > 0 and c.l_partkey % 2 = 0 then 'no' else c.in_proof end as in_proof, cast((c.l_partkey * 7919 + 977 * j.j) % 10000 as double) / cast(10000 as double) as position
  from (select paper_id, cast(row_number() over (partition by paper_id order by pos) as int) as cite_index, l_linenumber, l_partkey, l_suppkey, 1 + qty % 4 as group_size,
    case l_linenumber when 1 then 'abstract' when 2 then 'front' when 3 then 'intro' when 4 then 'prelim' when 5 then 'main' when 6 then 'discussion' else 'appendix' end as section_kind,
    case when l_returnflag = 'R' then 'yes' else 'no' end as in_proof from {r0} r0 where qty >= 5) c {numbers}"""
_NUMBERS = {"spark": "lateral view explode(sequence(0, c.group_size - 1)) j as j", "duckdb": ", unnest(range(c.group_size)) j(j)"}


def planted(spark: SparkSession, sf_dir: str, gathered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, references, in-text rows) from orders and lineitem; the first row per key is the reference. With ``gathered`` the rows of a paper are brought together first, and what follows by paper needs no other shuffle."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if gathered:
        orders, lineitem = orders.repartition("o_orderkey"), lineitem.repartition("l_orderkey")
    papers = spark.sql(P, orders=orders, lineitem=lineitem)
    r0 = spark.sql(R0, lineitem=lineitem)
    papers_corpus = papers.select("paper_id", "corpus")
    listed = r0.select("paper_id", "cite_key", "pos", "year", "doi", "arxiv_id", "source_format", "cited_in_text")
    refs = first_wins(listed, ["paper_id", "cite_key"], ["pos"]).join(papers_corpus, "paper_id")
    cites = spark.sql(C.replace("{numbers}", _NUMBERS["spark"]), r0=r0)
    return papers, refs, cites


_TABLES = {"orders": "orders", "lineitem": "lineitem"}
_R0 = R0.format(**_TABLES)
#: The same views as common table expressions for DuckDB: p, r (printed), rall, c, cmd, and the metrics m.
CTES = f"""
with p as ({P.format(**_TABLES)}), r0 as ({_R0}), rall as (
  select r0.*, p.corpus, p.citing_year, case when try_cast(left(trim(year), 4) as int) between 1600 and 2030 then try_cast(left(trim(year), 4) as int) end as y
  from r0 join p using (paper_id) qualify row_number() over (partition by paper_id, cite_key order by pos) = 1
), r as (select *, case when y <= citing_year + 1 then citing_year - y end as age from rall where corpus <> 'ai' or source_format = 'bibitem' or cited_in_text = 'yes'),
c as ({C.format(r0=f"({_R0})", numbers=_NUMBERS["duckdb"])}), cmd as (select paper_id, cite_index, pinpoint_class, prose_pinpoint, section_kind, in_proof, position, group_size from c qualify row_number() over (partition by paper_id, cite_index order by pos) = 1),
used as (select paper_id, cite_key, n from r join (select paper_id, cite_key, count(*) as n from c group by all) using (paper_id, cite_key)),
mr as (select paper_id, count(*) as n_references, median(age) as median_reference_age, avg((age <= 3)::int) as share_refs_recent_3y, avg((age >= 30)::int) as share_refs_classic_30y, avg((arxiv_id <> '')::int) as share_refs_arxiv, avg((doi <> '')::int) as share_refs_doi, case when count(age) > 0 then count(age) / count(*) end as share_refs_with_year from r group by all),
mc as (select paper_id, count(*) as n_cite_commands, avg((pinpoint_class in ('result','location','page','numbered'))::int) as share_pinpoint_specific, avg((pinpoint_class = 'result')::int) as share_pinpoint_result, avg((pinpoint_class in ('result','location','page','numbered') or prose_pinpoint = 'yes')::int) as share_pinpoint_any,
  avg((in_proof = 'yes')::int) as share_in_proof, avg((section_kind in ('abstract','front','intro'))::int) as share_intro_or_front, avg((position < 0.25)::int) as share_first_quarter, avg(group_size) as mean_group_size, avg((group_size >= 3)::int) as share_group_3plus,
  {", ".join(f"avg((section_kind = '{k}')::int) as share_section_{k}" for k in ("abstract", "front", "intro", "prelim", "main", "discussion", "appendix"))} from cmd group by all),
mu as (select paper_id, avg((n = 1)::int) as share_refs_cited_once, max(n) / sum(n) as max_share_one_reference from used group by all),
m as (select corpus, paper_id, subject, citing_year as year, coalesce(n_references, 0) as n_references, coalesce(n_cite_commands, 0) as n_cite_commands, coalesce(nc, 0) / nullif(coalesce(n_references, 0), 0) as citations_per_reference, share_pinpoint_specific, share_pinpoint_result, share_pinpoint_any, share_in_proof, share_intro_or_front, share_first_quarter, mean_group_size, share_group_3plus,
  share_refs_cited_once, max_share_one_reference, median_reference_age, share_refs_recent_3y, share_refs_classic_30y, share_section_abstract, share_section_front, share_section_intro, share_section_prelim, share_section_main, share_section_discussion, share_section_appendix, share_refs_with_year, share_refs_arxiv, share_refs_doi
  from p left join mr using (paper_id) left join mc using (paper_id) left join (select paper_id, count(*) as nc from c group by all) using (paper_id) left join mu using (paper_id))
"""


def ai_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, references, in-text rows) of the corpus as received: the first row per folder and key, papers without subject."""
    refs = table(spark, sf_dir, "ai_citations").withColumnRenamed("preprint_folder", "paper_id").withColumn("corpus", F.lit("ai"))
    papers = refs.select("paper_id").distinct().select("paper_id", F.lit("ai").alias("corpus"), F.lit("").alias("subject"), F.lit(2026).alias("citing_year"))
    cites = table(spark, sf_dir, "ai_intext_citations").withColumnsRenamed({"key": "cite_key", "cit_id": "pos"})
    return papers, first_wins(refs, ["paper_id", "cite_key"], ["ref_id"]), cites


def human_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(papers, references) of the human corpus; year and stratum from the last candidate row of the paper, papers that are no candidates left out."""
    refs = table(spark, sf_dir, "human_citations").withColumnRenamed("preprint_folder", "paper_id").withColumn("corpus", F.lit("human"))
    cand = last_wins(table(spark, sf_dir, "human_candidates").select("id", "cand_id", "stratum", "published"), ["id"], ["cand_id"])
    papers = refs.select("paper_id").distinct().join(cand.withColumnRenamed("id", "paper_id"), "paper_id").select("paper_id", F.lit("human").alias("corpus"), F.coalesce("stratum", F.lit("")).alias("subject"), F.substring("published", 1, 4).cast("int").alias("citing_year"))
    return papers, first_wins(refs, ["paper_id", "cite_key"], ["ref_id"])
