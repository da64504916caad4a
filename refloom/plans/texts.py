"""Registered queries of the parsers: text planted from columns, recovered by parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import columns as C
from refloom.operators.context import intext_citations
from refloom.operators.extract import bodies, parse_entries, reference_lists
from refloom.session import table

def _key() -> Column:
    return F.concat(F.lit("r"), F.col("ref_id").cast("string"))


def _field(head: str, name: str, tail: str) -> Column:
    """The column between ``head`` and ``tail``; nothing where it is null."""
    return F.coalesce(F.concat(F.lit(head), name, F.lit(tail)), F.lit(""))


def _planted(spark: SparkSession, sf_dir: str, entry: Column, begin: str = "", end: str = "") -> DataFrame:
    """(path, content): every reference as ``entry``, between ``begin`` and ``end`` of its file.

    A file holds a paper's references of 64 consecutive numbers, so that a hot
    paper is no hot row.
    """
    refs = table(spark, sf_dir, "ai_citations").select(F.coalesce("preprint_folder", F.lit("")).alias("folder"), (F.col("ref_id") / 64).cast("long").alias("part"), F.struct("ref_id", entry.alias("entry")).alias("e"))
    files = refs.groupBy("folder", "part").agg(F.array_sort(F.collect_list("e"))["entry"].alias("entries"))
    return files.select(F.concat_ws("/", "folder", "part").alias("path"), F.concat(F.lit(begin), F.array_join("entries", "\n"), F.lit(end)).alias("content"))


def _recovered(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("cite_key").alias("k"), "author", "title", "year", "volume")


def _people() -> Column:
    """The authors as an array, parted at each ' and ' outside braces."""
    return F.split("author", r" and (?![^{}]*\})")


def parse_bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in double braces, years in quotes, volumes bare where they are numbers; null fields are left out."""
    volume = F.when(F.col("volume").rlike(r"^\d+$"), _field(", volume = ", "volume", "")).otherwise(_field(", volume = {", "volume", "}"))
    entry = F.concat(F.lit("@article{"), _key(), _field(", author = {", "author", "}"), _field(", title = {{", "title", "}}"), _field(', year = "', "year", '"'), volume, F.lit("}"))
    return _recovered(parse_entries(_planted(spark, sf_dir, entry), "bib"))


def parse_bibitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("\\bibitem{"), _key(), F.lit("} "), _field("", "author", ", "), _field("\\emph{", "title", "}, "), F.lit("Some Journal"), _field(" (", "year", ")"), _field(", \\textbf{", "volume", "}"), F.lit("."))
    return _recovered(parse_entries(_planted(spark, sf_dir, entry, "\\begin{thebibliography}{9}", "\\end{thebibliography}"), "bibitem"))


def parse_amsrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = F.coalesce(F.array_join(F.transform(_people(), lambda a: F.concat(F.lit(", author={"), a, F.lit("}"))), ""), F.lit(""))
    date = F.when(F.col("year").rlike(r"^\d{4}$"), _field(", date={", "year", "-01-01}")).otherwise(_field(", date={", "year", "}"))
    entry = F.concat(F.lit("\\bib{"), _key(), F.lit("}{article}{"), authors, _field(", title={", "title", "}"), date, _field(", volume={", "volume", "}"), F.lit("}"))
    return _recovered(parse_entries(_planted(spark, sf_dir, entry), "amsrefs"))


def parse_biblatex(spark: SparkSession, sf_dir: str) -> DataFrame:
    family, given = (lambda a, i=i: F.regexp_extract(a, r"^([^,{}]*[^,{}\s]), ([^,{}\s][^,{}]*)$", i) for i in (1, 2))
    person = lambda a: F.when(family(a) != "", F.concat(F.lit("{{hash=1}{family={"), family(a), F.lit("},given={"), given(a), F.lit("}}}"))).otherwise(F.concat(F.lit("{{hash=1}{family={"), a, F.lit("}}}")))
    names = F.coalesce(F.concat(F.lit("\\name{author}{"), F.size(_people()).cast("string"), F.lit("}{}{"), F.array_join(F.transform(_people(), person), "%\n"), F.lit("}")), F.lit(""))
    date = F.when(F.col("year").rlike(r"^\d{4}$"), _field("\\field{date}{", "year", "-02}")).otherwise(_field("\\field{date}{", "year", "}"))
    entry = F.concat(F.lit("\\entry{"), _key(), F.lit("}{article}{}"), names, _field("\\field{title}{", "title", "}"), date, _field("\\field{volume}{", "volume", "}"), F.lit("\\endentry"))
    return _recovered(parse_entries(_planted(spark, sf_dir, entry), "biblatex"))


_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce({}, ''), '[{{}}]', '', 'g'), '\s+', ' ', 'g'))"


def _truth(year: str = "year", author: str = "author") -> str:
    """Every reference as the parsers give it: text without braces, white space as single spaces, nulls as ''."""
    return f"select concat('r', cast(ref_id as varchar)) as k, {_CLEAN.format(author)} as author, {_CLEAN.format('title')} as title, {_CLEAN.format(year)} as year, {_CLEAN.format('volume')} as volume from ai_citations"


# a free-text item shows authors only before a title, without closing punctuation, and years only as whole numbers; a date's year is its first four characters
_ITEM = _truth(r"regexp_extract(coalesce(year, ''), '\b(1[89]\d\d|20\d\d)\b', 1)", r"case when title is not null then rtrim(trim(regexp_replace(author || ',', '\s+', ' ', 'g')), ',:.') end")
_DATED = _truth("left(year, 4)")


def cited_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of every document, null and empty ones included, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(C.cited_keys(F.col("text"))), " ").alias("keys"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TeX trees of the human papers: a main file that includes a second one with their citations and list."""
    h = table(spark, sf_dir, "human_citations").select(F.col("preprint_folder").alias("paper_id"), F.concat(F.lit("h"), F.col("ref_id").cast("string")).alias("k"), "ref_id")
    one = h.groupBy("paper_id").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    cites = F.array_join(F.transform("ks", lambda k: F.concat(F.lit("\\begin{proof}By Theorem 2 of \\cite["), F.lit("Lemma 3"), F.lit("]{"), k, F.lit("}\\end{proof}\n"))), "")
    items = F.array_join(F.transform("ks", lambda k: F.concat(F.lit("\\bibitem{"), k, F.lit("} A. Author, \\emph{T "), k, F.lit("}, J (2001)\n"))), "")
    main = F.lit("\\documentclass{a}\\begin{document}\\section{Introduction}\\input{part}\\end{document}")
    part = F.concat(cites, F.lit("\\begin{thebibliography}{9}"), items, F.lit("\\end{thebibliography}"))
    return one.select("paper_id", F.explode(F.array(F.struct(F.lit("main.tex").alias("path"), main.alias("content")), F.struct(F.lit("part.tex").alias("path"), part.alias("content")))).alias("f")).select("paper_id", "f.*")


def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_lists(_tree(spark, sf_dir), "printed").select("paper_id", "cite_key", "title", "year", "cited_in_text", "source_format")


def cite_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intext_citations(bodies(_tree(spark, sf_dir))).select("paper_id", "cite_index", "key", "group_size", "postnote", "pinpoint_class", "prose_pinpoint", "section_kind", "in_proof")


QUERIES = {f.__name__: f for f in (parse_bib, parse_bibitems, parse_amsrefs, parse_biblatex, cited_keys, reference_list, cite_tokenizer)}

_HK = "concat('h', cast(ref_id as varchar))"
ORACLES = {
    "cited_keys": r"""with g as (select doc_id, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '(^|[^\\])%[^\n]*', '\1', 'g'), '\\(?:[a-zA-Z]*cite[a-zA-Z]*|nocite)\*?(?:\[[^\]]*\]){0,2}\{([^}]*)\}', 1)) as grp from documents),
k as (select distinct doc_id, regexp_replace(unnest(str_split(grp, ',')), '^\s+|\s+$', '', 'g') as k from g) select d.doc_id, coalesce(string_agg(k, ' ' order by k), '') as keys from documents d left join (select * from k where k <> '') k on k.doc_id = d.doc_id group by d.doc_id""",
    "parse_bib": _truth(), "parse_bibitems": _ITEM, "parse_amsrefs": _DATED, "parse_biblatex": _DATED,
    "reference_list": f"select preprint_folder as paper_id, {_HK} as cite_key, 'T ' || {_HK} as title, '2001' as year, 'yes' as cited_in_text, 'bibitem' as source_format from human_citations",
    "cite_tokenizer": f"select preprint_folder as paper_id, cast(row_number() over (partition by preprint_folder order by {_HK}) as int) as cite_index, {_HK} as key, 1 as group_size, 'Lemma 3' as postnote, 'result' as pinpoint_class, 'yes' as prose_pinpoint, 'intro' as section_kind, 'yes' as in_proof from human_citations",
}
