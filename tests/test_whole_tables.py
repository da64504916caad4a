"""Queries read every row of their tables; the expected values are worked out by hand or in plain Python."""

import hashlib
import inspect
import math
import random
import statistics

from refloom.operators import bootstrap, metrics
from refloom.plans import citations, texts


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


def test_every_note_is_classified(spark, tmp_path):
    notes = {None: "none", "": "none", " ": "none", "Theorem 2": "result", "particular": "location", "Lemma 3, p. 4": "result", "§ 2": "location", "p. 3": "page", "12": "page", "12--14": "page", "4.2": "numbered", "II.2.1": "numbered", "see it": "other"}
    sf = put(spark, tmp_path, "ai_intext_citations", [(i, n, f"given {i}") for i, n in enumerate(notes)], "cit_id long, postnote string, pinpoint_class string")
    got = {r.cit_id: (r.given, r.found) for r in citations.QUERIES["classify_postnote"](spark, sf).collect()}
    assert got == {i: (f"given {i}", c) for i, c in enumerate(notes.values())}


# title, author, year, volume as planted; then author, title, year, volume as parsed from .bib; white space behind a symbol command goes, as in the reference
HARD = [
    ("{H}ow {{A}}: $L^2$ \"bounds\"\n of\tthis,", "Doe, John T. and {Working Group on X and Y at Z}", "2025a", "", "Doe, John T. and Working Group on X and Y at Z", "How A: $L^2$ \"bounds\" of this,", "2025a", ""),
    ("Sur l\\'{e}tat de \\v{S}a et \\emph{G\\\"odel} \\& {\\L}", "Erd\\H{o}s, P.; {\\\"O}z, Q", "n.d.", "12", "Erdős, P.; Öz, Q", "Sur létat de Ša et Gödel &Ł", "n.d.", "12"),
    ("``Été'' – “ï”", "A. One | \"B. Two\" et al.", None, "7", "A. One | \"B. Two\" et al.", "``Été'' – “ï”", "", "7"),
    (None, "C. Three", "in press", "", "C. Three", "", "in press", ""),
    ("plain", None, "1999", None, "", "plain", "1999", ""),
    (" { \"ends in a dot.\"\n} ", "Four, D.,", "", "3", "Four, D.,", "\"ends in a dot.\"", "", "3"),
]


def test_every_reference_is_planted_and_parsed(spark, tmp_path):
    schema = "ref_id long, preprint_folder string, title string, author string, year string, volume string"
    sf = put(spark, tmp_path, "ai_citations", [(i, "p", *row[:4]) for i, row in enumerate(HARD)] + [(64, "p", "next", "E", "2000", "1"), (65, None, "none", "F", "2001", "2")], schema)
    rest = {"r64": ("E", "next", "2000", "1"), "r65": ("F", "none", "2001", "2")}
    bib = {f"r{i}": row[4:] for i, row in enumerate(HARD)} | rest
    dated = {k: (a, t, y[:4], v) for k, (a, t, y, v) in bib.items()}
    # free text: no authors without a title, no closing punctuation of authors, whole years only
    items = {k: ("" if not t else a.rstrip(",.:"), t, y if y.isdigit() else "", v) for k, (a, t, y, v) in bib.items()}
    for name, want in {"parse_bib": bib, "parse_bibitems": items, "parse_amsrefs": dated, "parse_biblatex": dated}.items():
        rows = texts.QUERIES[name](spark, sf).collect()
        assert {r.k: (r.author, r.title, r.year, r.volume) for r in rows} == want, name
        assert len(rows) == len(want)
    assert texts._planted(spark, sf, texts._key()).count() == 3  # files of several entries


def test_intervals_of_every_metric_from_2000_replicates(spark, monkeypatch):
    rows = [(g, i, "", m, float(i * 7 % 11) / (3 if g == "ai" else 7)) for m, n in (("n_references", 5), ("mean_group_size", 8)) for g in ("ai", "human") for i in range(n + (g == "ai"))]
    long = spark.createDataFrame(rows, "grp string, paper_id int, subject string, metric string, value double")
    monkeypatch.setattr(citations, "_metrics", lambda *_: None)
    monkeypatch.setattr(metrics, "long_metrics", lambda m: long)
    want = {}
    for m in ("n_references", "mean_group_size"):
        a, b = ([v for g, _, _, k, v in rows if (g, k) == (side, m)] for side in ("ai", "human"))
        draw = random.Random(bootstrap.SEED).randrange
        diffs = sorted(statistics.fmean([a[draw(len(a))] for _ in a]) - statistics.fmean([b[draw(len(b))] for _ in b]) for _ in range(2000))
        want[m] = (diffs[50], diffs[1949])
    assert {r.metric: (r.low, r.high) for r in citations.QUERIES["bootstrap_ci_exact"](spark, "").collect()} == want

    def poisson(text):
        u, k, p, total = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32, 0, math.exp(-1), math.exp(-1)
        while u >= total and k < 7:
            k += 1
            p /= k
            total += p
        return k

    for m in want:
        diffs = []
        for rep in range(2000):
            sides = [[(poisson(f"{bootstrap.SEED}:{m}:{i}:{rep}"), v) for g, i, _, k, v in rows if (g, k) == (side, m)] for side in ("ai", "human")]
            if all(sum(w for w, _ in s) for s in sides):
                diffs.append(sum(w * v for w, v in sides[0]) / sum(w for w, _ in sides[0]) - sum(w * v for w, v in sides[1]) / sum(w for w, _ in sides[1]))
        want[m] = tuple(round(sorted(diffs)[i], 6) for i in (50, 1949))
    assert {r.metric: (r.low, r.high) for r in citations.QUERIES["bootstrap_ci"](spark, "").collect()} == want
    assert inspect.signature(bootstrap.interval).parameters["reps"].default == 2000


def test_log_repair_grows_with_the_stratum(spark, tmp_path):
    sf = put(spark, tmp_path, "customer", [(i, "s") for i in range(600)], "c_custkey long, c_mktsegment string")
    rank = {r.id: r.rank for r in citations.QUERIES["seeded_rank"](spark, sf).collect()}
    logged = {i for i in rank if i % 5 == 0 and rank[i] <= 400}
    sources = {i: i % 4 for i in rank if i % 3 == 0 and rank[i] <= 540}
    last = max(rank[i] for i in logged | set(sources))
    want = {i: ("failed_unrecorded" if i not in sources else "included" if sources[i] else "no_bibliography", sources.get(i, 0)) for i in rank if rank[i] <= last and i not in logged}
    assert {r.id: (r.status, r.n_references) for r in citations.QUERIES["log_gap_repair"](spark, sf).collect()} == want
    assert len(want) > 400
