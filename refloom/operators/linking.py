"""Labels from what is cited, links within the corpus, and cited DOIs against registry records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import columns as C

# How a reference links to a paper of the corpus, and the organisation's name that goes with a bare title.
LINK = r"github\.com/openai/math/(?:blob|tree)/[^/\s]+/preprints/([^/\s}{]+)|\bOAI:([A-Za-z0-9-]+-20\d\d)\b"
LINK_HEAD = "https://github.com/openai/math/blob/main/preprints/"
PUBLISHER = "openai"
FLAGGED = ["title_mismatch", "title_partial", "not_found"]


def modal_label(refs: DataFrame, cache: DataFrame) -> DataFrame:
    """(paper_id, subject, n, subject_share): the commonest category of each paper's references.

    ``refs``: paper_id, item, pos; ``cache``: item, category. Ties go to the
    category that more items of the cache have, then to the one seen first. A paper without
    any category has subject '' and n 0.
    """
    overall = cache.where(F.coalesce("category", F.lit("")) != "").groupBy("category").agg(F.count(F.lit(1)).alias("overall"))
    known = refs.join(cache, "item").where(F.coalesce("category", F.lit("")) != "")
    counted = known.groupBy("paper_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).join(overall, "category")
    best = counted.groupBy("paper_id").agg(F.max_by("category", F.struct("n", "overall", -F.col("pos"))).alias("subject"), F.max("n").alias("most"), F.sum("n").alias("n"))
    out = refs.select("paper_id").distinct().join(best, "paper_id", "left")
    return out.select("paper_id", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.format_string("%.2f", F.bround(F.col("most") / F.col("n"), 2))).otherwise("").alias("subject_share"))


def cross_citations(refs: DataFrame) -> DataFrame:
    """References of the corpus to itself, by link, by title together with the publisher's name, or by that name alone.

    ``refs`` are references of the corpus with ref_id. A title that two papers
    share belongs to the last folder by ref_id; so does a folder's title and date.
    """
    meta = refs.groupBy("preprint_folder").agg(F.max_by(F.struct("preprint_title", "preprint_date"), "ref_id").alias("m"), F.min("ref_id").alias("first")).select("preprint_folder", "m.*", "first")
    titles = meta.withColumn("t", C.norm_text(F.col("preprint_title"))).groupBy("t").agg(F.max_by("preprint_folder", "first").alias("by_title"))
    blob = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("url", "journal_or_venue", "note", "raw_reference", "booktitle")))
    named = F.concat_ws(" ", F.coalesce("author", F.lit("")), F.substring(F.coalesce("raw_reference", F.lit("")), 1, 60)).rlike(rf"(?i)\b{PUBLISHER}\b")
    linked = C.first_filled(F.regexp_extract(blob, LINK, 1), F.regexp_extract(blob, LINK, 2))
    r = refs.withColumn("linked", linked).withColumn("named", named).where("linked <> '' or named").withColumn("t", C.norm_text(F.col("title")))
    r = r.join(titles, "t", "left").join(meta.select(F.col("preprint_folder").alias("linked"), F.lit(True).alias("known")), "linked", "left")
    by_title = F.col("named") & F.col("by_title").isNotNull()
    method = F.when((F.col("linked") != "") & F.col("known"), "repo_link").when(F.col("linked") != "", "repo_link_unknown_folder").when(by_title, "title").otherwise("openai_other")
    target = F.when(F.col("linked") != "", F.col("linked")).when(by_title, F.col("by_title")).otherwise("")
    out = r.withColumn("match_method", method).withColumn("cited_folder", target).join(meta.select(F.col("preprint_folder").alias("cited_folder"), F.col("preprint_title").alias("m_title"), F.col("preprint_date").alias("m_date")), "cited_folder", "left")
    return out.select(F.col("preprint_folder").alias("citing_folder"), F.col("preprint_date").alias("citing_date"), "cite_key", "cited_in_text", "cited_folder", F.coalesce("m_date", F.lit("")).alias("cited_date"), "match_method", F.when(F.col("cited_folder") == F.col("preprint_folder"), "yes").otherwise("no").alias("self_citation"), C.first_filled(F.col("m_title"), F.col("title")).alias("cited_title"), "note")


def internal_summary(cross: DataFrame) -> DataFrame:
    """One row: references within the corpus, papers on both ends, later releases and self-citations."""
    c = cross.where(F.col("match_method").isin("repo_link", "title"))
    return c.agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("citing_folder").alias("citing_papers"), F.countDistinct("cited_folder").alias("cited_papers"), F.count_if(F.col("cited_date") > F.col("citing_date")).alias("cites_later_release"), F.count_if(F.col("self_citation") == "yes").alias("self_citations"))


def doi_check(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """Every reference with a DOI compared with its registry record (doi, registry, type, title, years, first_author, venue); DOIs without a record are left out, as they are not looked up yet."""
    r = refs.where(F.coalesce("doi", F.lit("")) != "").withColumn("k", F.lower(C.normalize_doi(F.col("doi"))))
    g = registry.select(F.lower("doi").alias("k"), F.col("registry"), F.col("type").alias("registered_type"), F.col("title").alias("title_registered"), F.coalesce("years", F.array().cast("array<int>")).alias("years"), F.col("first_author").alias("g_author"), F.col("venue").alias("venue_registered"))
    j = r.join(g, "k").withColumns({"w_raw": C.norm_text(F.col("raw_reference")), "w_title": C.norm_text(F.col("title_registered"))})
    j = j.withColumns({"s": C.title_similarity(F.col("title"), F.col("title_registered")), "c": C.raw_coverage(F.col("w_raw"), F.col("w_title")), "fa_c": C.first_family(F.col("author")), "fa_r": C.norm_text(F.col("g_author"))})
    j = j.withColumn("st", C.doi_status(F.col("registry"), F.col("s"), F.col("c"), F.col("raw_reference")))
    return j.select("preprint_folder", "cite_key", "cited_in_text", "doi", F.col("st.status").alias("status"), F.col("st.score").alias("title_similarity"), F.col("st.method").alias("title_check_method"), F.col("year").alias("year_cited"), F.array_join(F.transform("years", lambda y: y.cast("string")), " ").alias("years_registered"), C.year_match(F.coalesce("year", F.lit("")), F.col("years")).alias("year_match"), F.col("fa_c").alias("first_author_cited"), F.col("fa_r").alias("first_author_registered"), C.author_match(F.col("fa_c"), F.col("fa_r")).alias("first_author_match"), F.col("title").alias("title_cited"), "title_registered", C.first_filled(F.col("journal_or_venue"), F.col("booktitle")).alias("venue_cited"), "venue_registered", "registry", "registered_type")


def flagged_dois(checked: DataFrame, order: str) -> DataFrame:
    """One row per flagged DOI: the fields of its first reference by ``order`` and how many cite it; by status, then DOI."""
    kept = ["doi", "status", "title_similarity", "title_cited", "title_registered", "first_author_cited", "first_author_registered", "year_cited", "years_registered"]
    f = checked.where(F.col("status").isin(*FLAGGED)).withColumn("k", F.lower(C.normalize_doi(F.col("doi"))))
    out = f.groupBy("k").agg(F.min_by(F.struct(*kept, F.col("preprint_folder").alias("example_preprint")), order).alias("r"), F.count(F.lit(1)).alias("n_citing_refs"))
    return out.select("r.*", "n_citing_refs", F.lit("").alias("verdict")).orderBy("status", F.lower("doi"))


def doi_tile(checked: DataFrame) -> DataFrame:
    """One row: references with a checked DOI, those whose title matches, those flagged, and their shares."""
    of = lambda c: F.count_if(c)
    flagged, match = F.col("status").isin(*FLAGGED), F.col("status") == "title_match"
    out = checked.agg(F.count(F.lit(1)).alias("n_checked"), of(match).alias("n_match"), of(flagged).alias("n_flagged"))
    return out.select("*", F.try_divide("n_match", "n_checked").alias("share_match"), F.try_divide("n_flagged", "n_checked").alias("share_flagged"))
