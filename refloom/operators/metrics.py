"""Citation metrics per paper, and their summaries per corpus and subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from refloom.functions.columns import SECTION_KINDS, SPECIFIC, share, year_of
from refloom.session import staged

# Metrics with label and kind.
METRICS = [
    ("n_references", "References per paper", "count"), ("n_cite_commands", "Citation commands per paper", "count"), ("citations_per_reference", "In-text citations per reference", "ratio"),
    ("share_pinpoint_specific", "Citations naming a specific result, section or page", "share"), ("share_pinpoint_result", "Citations naming a specific result (Theorem, Lemma, ...)", "share"),
    ("share_pinpoint_any", "Citations with any pinpoint (including in prose)", "share"), ("share_in_proof", "Citations inside proofs", "share"), ("share_intro_or_front", "Citations in abstract or introduction", "share"),
    ("share_first_quarter", "Citations in the first quarter of the text", "share"), ("mean_group_size", "Works per citation command", "ratio"), ("share_group_3plus", "Citation commands bundling 3+ works", "share"),
    ("share_refs_cited_once", "References cited only once", "share"), ("max_share_one_reference", "Share of citations going to the most-used reference", "share"), ("median_reference_age", "Median age of cited works (years)", "years"),
    ("share_refs_recent_3y", "Cited works at most 3 years old", "share"), ("share_refs_classic_30y", "Cited works at least 30 years old", "share"),
]
#: The metrics that are compared subject by subject.
BY_SUBJECT = ["share_pinpoint_specific", "share_in_proof", "share_intro_or_front", "median_reference_age", "n_references"]


def printed(refs: DataFrame) -> DataFrame:
    """The references a reader sees: of corpus ``ai`` free-text items and cited entries, of others all."""
    return refs.where((F.col("corpus") != "ai") | (F.col("source_format") == "bibitem") | (F.col("cited_in_text") == "yes"))


def commands(cites: DataFrame, order: str = "pos") -> DataFrame:
    """In-text rows reduced to the first of each citation command by ``order``, which is unique within a command."""
    kept = ["pinpoint_class", "prose_pinpoint", "section_kind", "in_proof", "position", "group_size"]
    return cites.groupBy("paper_id", "cite_index").agg(F.min_by(F.struct(*kept), order).alias("first")).select("paper_id", "cite_index", "first.*")


def _part(condition: Column) -> Column:
    """The share of rows for which the condition holds; null rows count as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def command_metrics(cites: DataFrame, order: str = "pos") -> DataFrame:
    """Per paper: commands, their pinpoints, places and sizes, each command by its first row (see :func:`commands`).

    What is asked of a row is one number of bits, so that the first rows are
    found by a hash aggregate over numbers, without sorting.
    """
    specific, kind = F.col("pinpoint_class").isin(*SPECIFIC), F.col("section_kind")
    asked = {
        "share_pinpoint_specific": specific, "share_pinpoint_result": F.col("pinpoint_class") == "result", "share_pinpoint_any": specific | (F.col("prose_pinpoint") == "yes"), "share_in_proof": F.col("in_proof") == "yes",
        "share_intro_or_front": kind.isin("abstract", "front", "intro"), "share_first_quarter": F.col("position") < 0.25, "share_group_3plus": F.col("group_size") >= 3, **{f"share_section_{k}": kind == k for k in SECTION_KINDS},
    }
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(asked.values())), F.lit(0).cast("long"))
    rows = cites.select("paper_id", "cite_index", F.col(order).cast("long").alias("pos"), bits.alias("bits"), F.col("group_size").cast("long").alias("size"))
    first = rows.groupBy("paper_id", "cite_index").agg(F.min_by("bits", "pos").alias("bits"), F.min_by("size", "pos").alias("size"), F.count(F.lit(1)).alias("rows"))
    shares = (F.avg(F.getbit("bits", F.lit(i)).cast("int")).alias(n) for i, n in enumerate(asked))
    return first.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_cite_commands"), F.sum("rows").alias("n_cites"), F.avg("size").alias("mean_group_size"), *shares)


def ages(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, age) of printed references whose year is known and at most one year after the paper's."""
    aged = printed(refs).select("paper_id", year_of(F.col("year")).alias("cited")).where("cited is not null").join(papers.select("paper_id", "citing_year"), "paper_id")
    return aged.where("cited <= citing_year + 1").select("paper_id", (F.col("citing_year") - F.col("cited")).alias("age"))


def reference_metrics(papers: DataFrame, refs: DataFrame, cites: DataFrame | None = None) -> DataFrame:
    """Per paper: printed references, their ages and identifiers, and with ``cites`` how they are used. Shares of aged or used references are null where there are none.

    References are counted by paper and age first; ages are a few hundred at
    most, so the median comes from running counts of a short list, and a paper
    with very many references is no large group.
    """
    y = year_of(F.col("year"))
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(f"n_{c}")
    listed = printed(refs)
    if cites is not None:
        uses = cites.where(F.coalesce("cite_key", F.lit("")) != "").groupBy("paper_id", "cite_key").agg(F.count(F.lit(1)).alias("uses"))
        listed = listed.join(uses, ["paper_id", "cite_key"], "left")
    else:
        listed = listed.withColumn("uses", F.lit(None).cast("long"))
    listed = listed.join(papers.select("paper_id", "citing_year"), "paper_id").withColumn("age", F.when(y <= F.col("citing_year") + 1, F.col("citing_year") - y))
    used = (F.count("uses").alias("n_used"), F.count_if(F.col("uses") == 1).alias("n_once"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))
    counted = listed.groupBy("paper_id", "age").agg(F.count(F.lit(1)).alias("n"), filled("arxiv_id"), filled("doi"), *used)
    w = W.partitionBy("paper_id").orderBy("age")
    aged = F.when(F.col("age").isNotNull(), F.col("n")).otherwise(0)
    ranked = counted.withColumns({"upto": F.sum(aged).over(w), "n_aged": F.sum(aged).over(W.partitionBy("paper_id"))})
    # the two middle places, counted from 1; they are one where the number is odd
    middle = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - aged < place) & F.col("age").isNotNull(), F.col("age")))
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = ranked.groupBy("paper_id").agg(
        F.sum("n").alias("n_references"), F.max("n_aged").alias("n_aged"), middle(F.floor((F.col("n_aged") + 1) / 2)).alias("low"), middle(F.floor(F.col("n_aged") / 2) + 1).alias("high"),
        part(F.col("age") <= 3).alias("recent"), part(F.col("age") >= 30).alias("classic"), *(F.sum(c).alias(c) for c in ("n_arxiv_id", "n_doi", "n_used", "n_once", "n_uses")), F.max("most_uses").alias("most_uses"),
    )
    of = lambda a, b: share(F.col(a), F.col(b))
    names = {
        "median_reference_age": (F.col("low") + F.col("high")) / 2, "share_refs_recent_3y": of("recent", "n_aged"), "share_refs_classic_30y": of("classic", "n_aged"), "share_refs_arxiv": of("n_arxiv_id", "n_references"),
        "share_refs_doi": of("n_doi", "n_references"), "share_refs_with_year": F.when(F.col("n_aged") > 0, of("n_aged", "n_references")),
    }
    if cites is not None:
        names |= {"share_refs_cited_once": of("n_once", "n_used"), "max_share_one_reference": of("most_uses", "n_uses")}
    return out.select("paper_id", "n_references", *(c.alias(n) for n, c in names.items()))


_FROM_USES = {"share_refs_cited_once", "max_share_one_reference"}
_FROM_REFS = {"n_references", "citations_per_reference", "median_reference_age", "share_refs_recent_3y", "share_refs_classic_30y", "share_refs_arxiv", "share_refs_doi", "share_refs_with_year"}
#: All metrics of a paper, in order.
ALL_METRICS = [k for k, *_ in METRICS] + [f"share_section_{k}" for k in SECTION_KINDS] + ["share_refs_with_year", "share_refs_arxiv", "share_refs_doi"]


def paper_metrics(papers: DataFrame, refs: DataFrame, cites: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per paper (corpus, paper_id, subject, citing_year) with all metrics, or those in ``names``.

    Every part is aggregated to the paper before the parts are joined, so no
    join fans out; parts of which no metric is asked for are not computed. A
    paper without references or citations stays, with 0 references and commands
    and null shares. Papers must be unique; ``cites`` has pos, the order of its rows.
    """
    names = names or ALL_METRICS
    out = papers
    if (_FROM_REFS | _FROM_USES) & set(names):
        out = out.join(reference_metrics(papers, refs, cites if _FROM_USES & set(names) else None), "paper_id", "left")
    if set(names) - _FROM_REFS - _FROM_USES or "citations_per_reference" in names:
        out = out.join(command_metrics(cites), "paper_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    made = {"n_references": zero, "n_cite_commands": zero, "citations_per_reference": lambda _: share(zero("n_cites").cast("double"), zero("n_references"))}
    return out.select("corpus", "paper_id", "subject", F.col("citing_year").alias("year"), *(made.get(n, F.col)(n).alias(n) for n in names))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for files and comparisons."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def groups(metrics: DataFrame) -> DataFrame:
    """The rows of each group that is summarised: ai_all, ai (with a subject) and human. A row is read once and repeated for its groups."""
    with_subject = F.coalesce("subject", F.lit("")) != ""
    mine = F.when(F.col("corpus") == "human", F.array(F.lit("human"))).when(F.col("corpus") == "ai", F.when(with_subject, F.array(F.lit("ai_all"), F.lit("ai"))).otherwise(F.array(F.lit("ai_all"))))
    return metrics.withColumn("grp", F.explode(mine))


def long_metrics(metrics: DataFrame) -> DataFrame:
    """(grp, paper_id, subject, metric, value) without nulls, for the metrics that are columns."""
    names = [k for k, *_ in METRICS if k in metrics.columns]
    grouped = groups(metrics).select("grp", "paper_id", "subject", *(F.col(k).cast("double").alias(k) for k in names))
    return grouped.unpivot(["grp", "paper_id", "subject"], names, "metric", "value").where("value is not null")


def exact_medians(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, median) of ``counted`` (*keys, value, n): each value with how often it occurs.

    Only the thousandths of the value range in which the middle places lie are
    ranked: their totals come first, so a group of any size is never sorted in
    one task.
    """
    bucket = F.floor(F.col("value") * 1000)
    totals = counted.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("n").alias("m"))
    w = W.partitionBy(*keys)
    places = totals.withColumns({"upto": F.sum("m").over(w.orderBy("bucket")), "total": F.sum("m").over(w)})
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = places.where(((F.col("upto") >= low) & (F.col("upto") - F.col("m") < low)) | ((F.col("upto") >= high) & (F.col("upto") - F.col("m") < high))).select(*keys, "bucket", (F.col("upto") - F.col("m")).alias("before"), low.alias("low"), high.alias("high"))
    near = counted.withColumn("bucket", bucket).join(middle, [*keys, "bucket"])
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*keys, "bucket").orderBy("value")))
    at = lambda place: F.max(F.when((F.col("upto") >= F.col(place)) & (F.col("upto") - F.col("n") < F.col(place)), F.col("value")))
    return near.groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"))


def corpus_summary(metrics: DataFrame) -> DataFrame:
    """(metric, grp, n, mean, median). The papers' metrics are computed once, into counts of each value."""
    counted = staged(long_metrics(metrics).groupBy("metric", "grp", "value").agg(F.count(F.lit(1)).alias("n")), "counted")
    means = counted.groupBy("metric", "grp").agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return means.join(exact_medians(counted, ["metric", "grp"]), ["metric", "grp"])


def difference_of_means(metrics: DataFrame) -> DataFrame:
    """(metric, diff_mean): mean of ai papers with a subject minus mean of human papers, where both exist."""
    means = long_metrics(metrics).where("grp <> 'ai_all'").groupBy("metric").agg(*(F.avg(F.when(F.col("grp") == g, F.col("value"))).alias(g) for g in ("ai", "human")))
    return means.where("ai is not null and human is not null").select("metric", (F.col("ai") - F.col("human")).alias("diff_mean"))


def by_subject(metrics: DataFrame) -> DataFrame:
    """Means per subject of both corpora, for the subjects of the ai corpus; most ai papers first."""
    m = metrics.where("(corpus = 'human' or coalesce(subject, '') <> '')")
    is_ai = F.col("corpus") == "ai"
    pairs = [(k, c) for k in BY_SUBJECT for c in ("ai", "human")]
    out = m.groupBy("subject").agg(F.count_if(is_ai).alias("n_ai"), F.count_if(~is_ai).alias("n_human"), *(F.avg(F.when(F.col("corpus") == c, F.col(k))).alias(f"{k}_{c}") for k, c in pairs))
    return out.where("n_ai > 0").orderBy(F.desc("n_ai"), "subject")


def age_histogram(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(corpus, age, n) over references of matched papers, ages above 100 as 100, negative ones left out."""
    matched = papers.where("corpus = 'human' or coalesce(subject, '') <> ''")
    return ages(matched, refs).where("age >= 0").join(matched.select("paper_id", "corpus"), "paper_id").groupBy("corpus", F.least("age", F.lit(100)).alias("age")).agg(F.count(F.lit(1)).alias("n"))


def age_bands(histogram: DataFrame) -> DataFrame:
    """(corpus, band, part): shares of age bands."""
    band = F.when(F.col("age") <= 3, "0-3").when(F.col("age") <= 10, "4-10").when(F.col("age") <= 20, "11-20").when(F.col("age") <= 30, "21-30").when(F.col("age") <= 50, "31-50").otherwise("51+")
    out = histogram.groupBy("corpus", band.alias("band")).agg(F.sum("n").alias("n"))
    return out.select("corpus", "band", (F.col("n") / F.sum("n").over(W.partitionBy("corpus"))).alias("part"))


def _matched_commands(papers: DataFrame, cites: DataFrame) -> DataFrame:
    matched = papers.where("corpus = 'human' or coalesce(subject, '') <> ''").select("paper_id", "corpus")
    return commands(cites).join(matched, "paper_id")


def pinpoint_mix(papers: DataFrame, cites: DataFrame) -> DataFrame:
    """(corpus, pinpoint_class, n) over commands of matched papers."""
    return _matched_commands(papers, cites).groupBy("corpus", "pinpoint_class").agg(F.count(F.lit(1)).alias("n"))


def pinpoint_shares_shown(mix: DataFrame) -> DataFrame:
    """(corpus, pinpoint_class, part) as charted: bare numbers count with the other notes."""
    shown = F.when(F.col("pinpoint_class") == "numbered", "other").otherwise(F.col("pinpoint_class"))
    out = mix.groupBy("corpus", shown.alias("pinpoint_class")).agg(F.sum("n").alias("n"))
    return out.select("corpus", "pinpoint_class", (F.col("n") / F.sum("n").over(W.partitionBy("corpus"))).alias("part"))


def position_histogram(papers: DataFrame, cites: DataFrame) -> DataFrame:
    """(corpus, bin, n, part) in 20 bins closed at the left; empty bins are kept."""
    counted = _matched_commands(papers, cites).groupBy("corpus", F.least(F.floor(F.col("position") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dense = counted.select("corpus").distinct().select("corpus", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("bin")).join(counted, ["corpus", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.select("corpus", "bin", "n", (F.col("n") / F.sum("n").over(W.partitionBy("corpus"))).alias("part"))


def pinpoint_paper_histogram(metrics: DataFrame) -> DataFrame:
    """(corpus, bin, n): matched papers by share of pinpointed citations: 0, then fifths closed at the right."""
    v = F.col("share_pinpoint_specific")
    bins = F.when(v == 0, 0).otherwise(F.least(F.lit(5), 1 + F.floor(v * 5 - 1e-9)))
    return metrics.where("(corpus = 'human' or coalesce(subject, '') <> '') and share_pinpoint_specific is not null").groupBy("corpus", bins.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def with_subjects(papers: DataFrame, subjects: DataFrame) -> DataFrame:
    """``papers`` (paper_id, ...) with the subject that ``subjects`` (preprint_folder, subject) gives them, '' for those it lacks. Subjects must be unique by folder."""
    known = subjects.select(F.col("preprint_folder").alias("paper_id"), F.col("subject").alias("__subject"))
    return papers.drop("subject").join(known, "paper_id", "left").withColumn("subject", F.coalesce("__subject", F.lit(""))).drop("__subject")


def subject_gaps(subjects: DataFrame, metric: str, least: int = 10) -> DataFrame:
    """(subject, n_ai, n_human, ai, human, gap) of :func:`by_subject`, for subjects with ``least`` papers on both sides, the largest gap first."""
    ai, human = F.col(f"{metric}_ai"), F.col(f"{metric}_human")
    shown = subjects.where((F.col("n_ai") >= least) & (F.col("n_human") >= least))
    return shown.select("subject", "n_ai", "n_human", ai.alias("ai"), human.alias("human"), (ai - human).alias("gap")).orderBy(F.desc_nulls_last("gap"), "subject")


def metric_gaps(differences: DataFrame, kind: str = "share") -> DataFrame:
    """(metric, diff_mean) of one kind of metric, the largest difference in either direction first."""
    of_kind = [k for k, _, kd in METRICS if kd == kind]
    return differences.where(F.col("metric").isin(*of_kind)).orderBy(F.desc_nulls_last(F.abs("diff_mean")), "metric")
