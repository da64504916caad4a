import gzip
import io
import json
import tarfile
import urllib.parse

import pytest
from pyspark.sql import functions as F

from refloom.functions import columns as C
from refloom.functions import latex as L
from refloom.operators import bootstrap, dedupe, extract, linking, metrics, report, sampling
from refloom.operators.context import intext_citations, with_clamped_depth
from refloom.sources import archives, files, services
from refloom.streaming import ingest


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_years_shares_notes(spark):
    assert column(spark, ["", "n.d.", "1599", "2031", "2020a", " 1999 ", None], C.year_of) == [None, None, None, None, 2020, 1999, None]
    notes = {"explicit": "result", "second edition": "location", "12": "page", "4.2": "numbered", "II.2.1": "numbered", "see it": "other", "": "none", None: "none", "Théorème 2": "result", "p. 3": "page", "pp. 3--4": "page", "§ 2": "location"}
    assert column(spark, list(notes), C.classify_postnote) == list(notes.values())
    assert column(spark, [0.0, None], lambda v: C.share(v, F.lit(0)), "double") == [None, None]
    assert column(spark, [0.0], lambda v: C.share(v, F.lit(3)), "double") == [0.0]


def test_identifiers(spark):
    assert column(spark, ["see 10.1000/ab\\_c.)", "none", None], C.find_doi) == ["10.1000/ab_c", "", ""]
    assert column(spark, ["arXiv:2001.12345v2", "arxiv.org/abs/math.AG/0101001", "x"], C.find_arxiv) == ["2001.12345", "math.AG/0101001", ""]
    assert column(spark, ["https://dx.doi.org/10.1/a%2Bb+c.pdf", " 10.1/x.,; ", "10.1/5%", "10.1/a\\_b"], C.normalize_doi) == ["10.1/a+b+c", "10.1/x", "10.1/5%", "10.1/a_b"]
    assert column(spark, ["Title-of-it-March-7-2026", "plain"], C.folder_date) == ["2026-03-07", ""]
    assert column(spark, ["Title-of-it-March-7-2026", "plain"], C.folder_title) == ["Title of it", "plain"]
    assert column(spark, ["\\cite{a, b} % \\cite{c}\n\\nocite{*} \\citep[x][y]{a}"], C.cited_keys) == [["a", "b", "*"]]


def test_titles_and_statuses(spark):
    assert column(spark, ["<i>Été</i> \\emph{of} L²"], C.norm_text) == ["ete of l2"]
    assert C.likeness("", "a") is None
    assert C.likeness("a long enough title here", "a long enough title here and more") == 1.0
    df = spark.createDataFrame([("crossref", 0.95, None, ""), ("crossref", 0.5, 0.95, "raw"), ("crossref", 0.5, 0.95, ""), ("crossref", 0.7, None, None), ("crossref", None, None, ""), ("other", None, None, ""), ("not_found", None, None, "")], "g string, s double, c double, r string")
    got = [r[0] for r in df.select(C.doi_status(F.col("g"), F.col("s"), F.col("c"), F.col("r"))["status"]).collect()]
    assert got == ["title_match", "title_match", "title_mismatch", "title_partial", "exists_no_title_to_compare", "exists_no_metadata", "not_found"]
    assert column(spark, ["Doe, John and Roe, R", "John Doe; R Roe", ""], C.first_family) == ["doe", "doe", ""]


def test_bibtex():
    text = '@string{jm = "J. M"}\n@comment{x}\n@article{k1, title = {A {N}est}, journal = jm # " B", year = 2001, year = 2002, author = "A {"}q{"} B"}\n@misc(k2, note={@x{k3, title={In}}})'
    entries = {k: (t, f) for t, k, f in L.parse_bib(text)}
    assert entries["k1"] == ("article", {"title": "A {N}est", "journal": "J. M B", "year": "2002", "author": 'A {"}q{"} B'})
    assert entries["k3"][1]["title"] == "In"
    row = L.bib_row(*L.parse_bib("@article{a, title={X}, doi={10.1000/Z}, eprint={arXiv:2001.00001v3}, archivePrefix={arXiv}, pages={1--2}, date={1999-01}}")[0])
    assert (row["doi"], row["arxiv_id"], row["pages"], row["year"], row["normalized_id"]) == ("10.1000/Z", "2001.00001", "1-2", "1999", "doi:10.1000/z")


def test_other_bibliographies():
    items = L.parse_bibitems("\\begin{thebibliography}{9}\\bibitem[A{]}b]{k} A. One,\n%x\n \\emph{T {N}}, J. V. \\textbf{12} (1999), 1--9.\\bibitem{} no\\end{thebibliography}")
    assert [i[:2] for i in items] == [("k", "A{]}b")]
    row = L.bibitem_row("k", items[0][2])
    assert (row["author"], row["title"], row["journal_or_venue"], row["volume"], row["year"], row["pages"]) == ("A. One", "T N", "J. V", "12", "1999", "1--9")
    bbl = L.bbl_row("k", "A. One. \\newblock A title. \\newblock {\\em J. X}, 3, 2001.")
    assert (bbl["author"], bbl["title"], bbl["journal_or_venue"]) == ("A. One", "A title", "J. X")
    assert L.bbl_row("k", "\\bibinfo{author}{A. One} \\bibinfo{title}{T} \\bibinfo{year}{1990}")["year"] == "1990"
    assert L.parse_amsrefs("\\bib{k}{article}{author={A},author={B},title={T},date={1990-01}}")[0][2] == {"title": "T", "year": "1990", "author": "A and B"}
    name = "\\entry{k}{book}{}\\name{author}{2}{}{{{hash=1}{family={Doe},given={J.}}}%\n{{hash=2}{family={Roe}}}}\\field{title}{T}\\endentry"
    assert L.parse_biblatex(name)[0][2]["author"] == "Doe, J. and Roe"
    assert L.clean('G\\"odel \\v{S}a {\\L} $\\mathbb{Z}$ a--b~c \\href{u}{t}') == "Gödel Ša Ł $\\mathbbZ$ a–b c t"


def test_context_of_citations(spark):
    body = "\\begin{abstract}\\cite{a}\\end{abstract}\\section{Introduction}\\cite[Theorem 2]{a,b}\\end{proof}\\begin{proof}\\cite[a][b]{c}\\end{proof}\\cite{}\\section{Odd}\\cite{d}*{Lemma 1}\\appendix\\section{More} Theorem 2.3 of \\cite{e}\\nocite{z}"
    got = intext_citations(spark.createDataFrame([("p", body), ("q", ""), ("r", None)], "paper_id string, body string")).orderBy("cite_index", "key").collect()
    assert [(r.cite_index, r.key, r.group_size, r.section_kind, r.in_proof, r.pinpoint_class) for r in got] == [(1, "a", 1, "abstract", "no", "none"), (2, "a", 2, "intro", "no", "result"), (2, "b", 2, "intro", "no", "result"), (3, "c", 1, "intro", "yes", "other"), (5, "d", 1, "main", "no", "result"), (6, "e", 1, "appendix", "no", "none")]
    assert got[-1].prose_pinpoint == "yes"
    assert got[-1].section_number == 3


def test_clamped_depth(spark):
    deltas = [-1, -1, 1, 1, -1, -1, -1, 1]
    df = with_clamped_depth(spark.createDataFrame(list(enumerate(deltas)), "i int, d int").withColumn("p", F.lit(1)), F.col("d"), ["p"], ["i"], "depth")
    depth, want = 0, []
    for d in deltas:
        depth = max(0, depth + d)
        want.append(depth)
    assert [r.depth for r in df.orderBy("i").collect()] == want


TREE = [("bare", "x.tex", "no document"), ("p", "main.tex", "\\begin{document}\\cite{k1}\\input{two}\\end{document}"), ("p", "two.tex", "\\cite{k2}\\begin{thebibliography}{9}\\bibitem{k1} A, \\emph{T1}\\bibitem{k2} B, \\emph{T2}\\end{thebibliography}"), ("p", "r.bib", "@book{k1, title={From bib}}@book{k3, title={Unused}}")]


def test_precedence_of_sources(spark):
    trees = spark.createDataFrame(TREE, "paper_id string, path string, content string")
    ai = {r.cite_key: (r.title, r.cited_in_text) for r in extract.reference_lists(trees, "structured").collect()}
    human = {r.cite_key: (r.title, r.source_format) for r in extract.reference_lists(trees, "printed").collect()}
    assert ai == {"k1": ("From bib", "yes"), "k3": ("Unused", "no")}
    assert human == {"k1": ("From bib", "bibtex"), "k2": ("T2", "bibitem")}
    assert "\\cite{k2}" in extract.bodies(trees).where("paper_id = 'p'").first().body


def test_metrics_of_bare_papers(spark):
    papers = spark.createDataFrame([(1, "ai", "", 2026), (2, "ai", "s", 2026)], "paper_id int, corpus string, subject string, citing_year int")
    refs = spark.createDataFrame([(1, "ai", "bibtex", "no", "a", "2000", "", ""), (2, "ai", "bibitem", "no", "a", "2027", "", "x"), (2, "ai", "bibtex", "yes", "b", "2000", "1", "")], "paper_id int, corpus string, source_format string, cited_in_text string, cite_key string, year string, doi string, arxiv_id string")
    cites = spark.createDataFrame([(2, 1, "a", "result", "no", "intro", "no", 0.1, 2), (2, 1, "zz", "result", "no", "intro", "no", 0.1, 2), (2, 2, "a", "none", "yes", "main", "yes", 0.25, 1)], "paper_id int, cite_index int, cite_key string, pinpoint_class string, prose_pinpoint string, section_kind string, in_proof string, position double, group_size int")
    cites = cites.withColumn("pos", F.monotonically_increasing_id())
    m = {r.paper_id: r for r in metrics.paper_metrics(papers, refs, cites).collect()}
    assert (m[1].n_references, m[1].n_cite_commands, m[1].citations_per_reference, m[1].median_reference_age) == (0, 0, None, None)
    assert (m[2].n_references, m[2].n_cite_commands, m[2].citations_per_reference, m[2].median_reference_age, m[2].share_first_quarter, m[2].share_pinpoint_any, m[2].share_refs_cited_once, m[2].max_share_one_reference) == (2, 2, 1.5, 12.5, 0.5, 1.0, 0.0, 1.0)
    assert sum(m[2][f"share_section_{k}"] for k in C.SECTION_KINDS) == pytest.approx(1)
    long = metrics.long_metrics(metrics.paper_metrics(papers, refs, cites))
    assert bootstrap.interval_exact(long).count() == 0  # no human papers
    table = report.summary_table(metrics.corpus_summary(metrics.paper_metrics(papers, refs, cites)), metrics.difference_of_means(metrics.paper_metrics(papers, refs, cites)), bootstrap.interval(long, 40))
    assert report.markdown(table, {"ai_all": 2, "ai": 1, "human": 0}).count("\n| ") == 17
    assert json.loads(report.summary_json(table, {}).first().json)["metrics"][0]["metric"] == "n_references"


def test_bootstrap_interval_holds_the_difference(spark):
    rows = [(g, i, "", "m", float(i % 7 + (3 if g == "ai" else 0))) for g in ("ai", "human") for i in range(200)]
    long = spark.createDataFrame(rows, "grp string, paper_id int, subject string, metric string, value double")
    for ci in (bootstrap.interval(long, 200).first(), bootstrap.interval_exact(long, 200).first()):
        assert ci.low < 3 < ci.high and ci.high - ci.low < 2


def test_labels_quota_and_repair(spark):
    refs = spark.createDataFrame([("p", "1", 1), ("p", "2", 2), ("p", "9", 3), ("q", "9", 4)], "paper_id string, item string, pos int")
    cache = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y"), ("9", "")], "item string, category string")
    assert {r.paper_id: (r.subject, r.n, r.subject_share) for r in linking.modal_label(refs, cache).collect()} == {"p": ("y", 2, "0.50"), "q": ("", 0, "")}
    log = spark.createDataFrame([("s", i, i != 1, 2) for i in range(5)], "stratum string, rank int, ok boolean, target int")
    assert [r.selected for r in sampling.select_quota(log, "stratum", "rank", "ok", "target").orderBy("rank").collect()] == ["yes", "no", "yes", "no", "no"]
    cand = spark.createDataFrame([("s", i, f"i{i}") for i in range(5)], "stratum string, rank int, id string")
    got = sampling.repair_log(cand, cand.where("rank = 1"), spark.createDataFrame([("i3", 0), ("i2", 4)], "id string, n_references int")).collect()
    assert {r.id: r.status for r in got} == {"i0": "failed_unrecorded", "i2": "included", "i3": "no_bibliography"}
    assert "cond-mat.soft" in sampling.listing_query("cond-mat")
    assert dedupe.first_wins(log, ["stratum"], ["rank"]).first().rank == 0 and dedupe.last_wins(log, ["stratum"], ["rank"]).first().rank == 4


def test_links_within_the_corpus(spark):
    cols = "ref_id long, preprint_folder string, preprint_title string, preprint_date string, cite_key string, cited_in_text string, author string, title string, url string, journal_or_venue string, note string, raw_reference string, booktitle string"
    rows = [(1, "A-2026", "First one", "2026-01-02", "k", "yes", "OpenAI", "First One", "", "", "", "", ""), (2, "B-2026", "Second", "2026-01-01", "l", "no", "X", "t", "https://github.com/openai/math/tree/main/preprints/A-2026", "", "", "", ""), (3, "B-2026", "Second", "2026-01-01", "m", "no", "X", "t", "OAI:C-2026", "", "", "", ""), (4, "B-2026", "Second", "2026-01-01", "n", "no", "openai", "else", "", "", "", "", ""), (5, "B-2026", "Second", "2026-01-01", "o", "no", "X", "First one", None, None, None, None, None)]
    got = {r.cite_key: (r.cited_folder, r.match_method, r.self_citation) for r in linking.cross_citations(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"k": ("A-2026", "title", "yes"), "l": ("A-2026", "repo_link", "no"), "m": ("C-2026", "repo_link_unknown_folder", "no"), "n": ("", "openai_other", "no")}


def test_files_and_archives(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", None), ("", "2")], "x string, y string")
    files.write_csv(df, f"file://{tmp_path}/t.csv", ["x", "y"])
    assert {tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/t.csv", ["x", "y"]).collect()} == {('a,"b"\nc', None), (None, "2")}
    assert files.read_csv(spark, f"file://{tmp_path}/none.csv", ["x"], missing_ok=True).count() == 0
    (tmp_path / "cache.jsonl").write_text('{"doi":"10.1/A","registry":"crossref","title":"old"}\n{"doi":"10.1/a","registry":"other"}\n{"doi":"10.2/b","registry":"error"}\n')
    assert [(r.key, r.registry) for r in files.read_cache(spark, f"file://{tmp_path}/cache.jsonl").collect()] == [("10.1/a", "other")]
    (tmp_path / "tree/p1/src").mkdir(parents=True)
    (tmp_path / "tree/p1/src/m.tex").write_bytes(b"caf\xe9 \\cite{a}")
    tree = files.read_trees(spark, f"file://{tmp_path}/tree").first()
    assert (tree.paper_id, tree.path) == ("p1", "src/m.tex") and tree.content.startswith("caf�")
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tar:
        for name in ("a.tex", "../evil.tex", "/abs.tex"):
            info = tarfile.TarInfo(name)
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    blobs = [("t", gzip.compress(buf.getvalue())), ("p", b"%PDF-1"), ("s", b"\\documentclass{a}"), ("n", b"zzz"), ("e", None)]
    got = {(r.id, r.status, r.path) for r in archives.unpack(spark.createDataFrame(blobs, "id string, content binary")).collect()}
    assert got == {("t", "ok", "a.tex"), ("p", "pdf_only", None), ("s", "ok", "main.tex"), ("n", "not_latex", None), ("e", "not_latex", None)}


def _page(total: int, ids: list[str]) -> str:
    entries = "".join(f'<entry><id>http://arxiv.org/abs/{i}</id><title>A\n b</title><published>2020-01-02T00</published><updated>2021-01-02T00</updated><x:primary_category term="math.AG"/><category term="math.AG"/><category term="cs.X"/><author/><author/></entry>' for i in ids)
    return f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>{total}</o:totalResults>{entries}</feed>'


def test_services_replayed(spark):
    asked = []

    def get(url):
        asked.append(url)
        return 200, _page(3, ["2001.00001v2", "math/0101001v1"] if "start=0" in url else ["2001.00003v1"] if len(asked) > 2 else []).encode()

    assert [e["id"] for e in services.list_pages(get, "cat:math.AG", 2)] == ["2001.00001", "math/0101001", "2001.00003"]
    spark.dataSource.register(services.ListingSource)
    url = f"{services.LISTING_URL}?search_query=q&start=0&max_results=2000&sortBy=submittedDate&sortOrder=ascending"
    rows = spark.read.format("listing").option("searches", json.dumps(["q"])).option("answers", json.dumps({url: _page(1, ["2001.00001v2"])})).load().collect()
    assert [(r.id, r.title, r.categories, r.n_authors) for r in rows] == [("2001.00001", "A b", "math.AG cs.X", "2")]
    answers = {
        f"{services.WORKS_URL}?filter=doi%3A10.1%2Fa%2Cdoi%3A10.1%2Fb&rows=2&select={urllib.parse.quote(services.WORKS_FIELDS)}": json.dumps({"message": {"items": [{"DOI": "10.1/A", "title": ["T"], "subtitle": ["S"], "issued": {"date-parts": [[2001]]}, "published": {"date-parts": [[2000]]}, "editor": [{"name": "Ed"}]}]}}),
        f"{services.HANDLE_URL}10.1/b": json.dumps({"responseCode": 1}),
    }
    got = services.registry_records(spark.createDataFrame([("10.1/a",), ("10.1/b",)], "doi string"), answers).collect()
    assert [(r.doi, r.registry, r.title, r.years, r.first_author) for r in got] == [("10.1/a", "crossref", "T: S", [2000, 2001], "Ed"), ("10.1/b", "other", None, None, None)]
    waits = []
    calls = iter([(429, b"7"), (0, b""), (200, b"x")])
    assert services.patient(lambda u: next(calls), 5, 1, waits.append)("u") == (200, b"x") and waits == [1, 7.0, 1, 120, 1]


def test_ingest_once(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    for n in (1, 2):
        spark.range(3).write.mode("append").parquet(src)
        ingest.ingest_new(spark, src, "id long", lambda d: d, out, f"file://{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(out).count() == 3 * n
    done = []
    for _ in range(2):
        ingest.resume(spark.range(4), f"file://{tmp_path}/log", "id", lambda d: done.append(d.count()) or d)
    assert done == [4, 0]


def test_listing_of_whole_windows_and_of_days():
    entry = lambda i, day, cat: f'<entry><id>http://x/abs/{i}v1</id><title>T</title><published>{day}T00:00:00Z</published><updated>{day}T00:00:00Z</updated><category term="{cat}"/><a:primary_category xmlns:a="http://arxiv.org/schemas/atom" term="{cat}"/></entry>'
    feed = lambda total, entries: f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>{total}</o:totalResults>{"".join(entries)}</feed>'.encode()
    asked = []

    def get(url):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)
        search = q["search_query"][0]
        asked.append(search)
        a, b = (search.split("[")[1][:8], search.split(" TO ")[1][:8])
        days = [d for d in range(20200101, 20200111) if int(a) <= d <= int(b)]
        found = [entry(f"{d}.{n}", f"{d}"[:4] + "-" + f"{d}"[4:6] + "-" + f"{d}"[6:], "math.AG" if n else "math.NT") for d in days for n in range(3)]
        return 200, feed(len(found), found if q["max_results"][0] != "1" else found[:1])

    whole = list(services.list_category(get, "math.AG", "2020-01-01", "2020-01-10"))
    assert len(whole) == 20
    asked.clear()
    some = list(services.list_category(get, "math.AG", "2020-01-01", "2020-01-10", most=5, enough=5))
    assert len(some) == 6
    assert len(asked) == 4  # the count, then three days
    assert list(services.list_category(get, "math.AG", "2020-01-01", "2020-01-10", most=5, enough=5)) == some


def test_blocks_and_tiles(spark):
    papers = spark.createDataFrame([(1,), (2,)], "paper_id int")
    subjects = spark.createDataFrame([(1, "math.AG"), (3, "x")], "preprint_folder int, subject string")
    assert {tuple(r) for r in metrics.with_subjects(papers, subjects).collect()} == {(1, "math.AG"), (2, "")}
    checked = spark.createDataFrame([("title_match",), ("title_match",), ("not_found",), ("error",)], "status string")
    assert linking.doi_tile(checked).first().asDict() == {"n_checked": 4, "n_match": 2, "n_flagged": 1, "share_match": 0.5, "share_flagged": 0.25}
    counts = report.paper_counts(spark.createDataFrame([("ai", ""), ("ai", "s"), ("human", "s")], "corpus string, subject string"))
    table = spark.createDataFrame([(0, "m", "l", "k", 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)], "place int, metric string, label string, kind string, ai_all double, ai double, human double, diff_mean double, low double, high double")
    doc = json.loads(report.summary_json(table, {}, {"n_papers": counts}, checked.groupBy("status").count().withColumnRenamed("count", "n")).first().json)
    assert doc["n_papers"] == {"ai_all": 2, "ai_matched": 1, "human": 1}
    assert doc["ai_doi_check"] == {"error": 1, "not_found": 1, "title_match": 2}


def test_a_broken_log_is_no_missing_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest.resume(spark.range(4), f"file://{tmp_path}/log", "id", lambda d: d)


def test_registries_are_asked_again_by_their_own_schedule():
    waits, answers = [], iter([(500, b""), (429, b""), (0, b"")])
    assert services.patient(lambda u: next(answers), 3, 0.25, waits.append, services.works_wait)("u") == (0, b"")
    assert waits == [0.25, 5, 0.25, 60, 0.25]
