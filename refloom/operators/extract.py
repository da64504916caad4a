"""From TeX trees to reference lists: parse every file once, then choose sources and deduplicate by columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import latex as L

#: Columns of an extracted reference list.
OUT = "paper_id string, source_file string, cited_in_text string, " + ", ".join(f"{c} string" for c in L.REFERENCE)
_PARSED = "path string, pos long, " + ", ".join(f"{c} string" for c in L.REFERENCE)


def parse_entries(texts: DataFrame, form: str) -> DataFrame:
    """The entries of ``texts`` (path, content) as reference rows with their position; ``form`` is bib, bibitem, bbl, biblatex or amsrefs."""
    read = {
        "bib": lambda t: [L.bib_row(*e) for e in L.parse_bib(t)], "bibitem": lambda t: [L.bibitem_row(k, raw) for k, _, raw in L.parse_bibitems(t)], "bbl": lambda t: [L.bbl_row(k, raw) | {"source_format": "bbl"} for k, _, raw in L.parse_bibitems(t)],
        "biblatex": lambda t: [L.bib_row(*e) | {"source_format": "biblatex_bbl"} for e in L.parse_biblatex(t)], "amsrefs": lambda t: [L.bib_row(*e) | {"source_format": "amsrefs"} for e in L.parse_amsrefs(t)],
    }[form]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [{"path": p, "pos": i, **r} for p, t in zip(pdf["path"], pdf["content"]) if t for i, r in enumerate(read(t))]
            yield pd.DataFrame(rows, columns=["path", "pos", *L.REFERENCE])

    return texts.select("path", "content").mapInPandas(run, _PARSED)


def _first_keys(rows: list[tuple[str, dict]], cited: set[str]) -> list[dict]:
    out: dict[str, dict] = {}
    for path, row in rows:
        out.setdefault(row["cite_key"], row | {"source_file": path, "cited_in_text": "yes" if row["cite_key"] in cited else "no"})
    return list(out.values())


def _structured_first(files: dict[str, str]) -> list[dict]:
    """Every .bib entry if there is a .bib file, else the items of the .tex files."""
    tex = {p: t for p, t in sorted(files.items()) if p.endswith(".tex")}
    bibs = [p for p in sorted(files) if p.endswith(".bib")]
    rows = [(p, L.bib_row(*e)) for p in bibs for e in L.parse_bib(files[p])]
    if not bibs:
        for p, t in tex.items():
            whole = L.inline(t, files, [L._folder(p), ""]) if "thebibliography" in t else t
            rows += [(p, L.bibitem_row(k, raw)) for k, _, raw in L.parse_bibitems(whole)]
    return _first_keys(rows, L.cited_keys(list(tex.values())))


def _printed_first(files: dict[str, str]) -> list[dict]:
    """Compiled lists, else lists in the text, else the cited .bib entries; a .bib entry of the same key gives the fields."""
    by = lambda end: {p: t for p, t in sorted(files.items()) if p.lower().endswith(end)}
    tex, entries = by(".tex"), {}
    for t in by(".bib").values():
        for kind, key, f in L.parse_bib(t):
            entries.setdefault(key, (kind, f))
    cited = L.cited_keys(list(tex.values()))
    tagged = lambda rows, form: [r | {"source_format": form} for r in rows]
    rows: list[tuple[str, dict]] = []
    for p, t in by(".bbl").items():
        if "\\bib{" in t or "\\begin{biblist}" in t:
            found = tagged((L.bib_row(*e) for e in L.parse_amsrefs(t)), "amsrefs")
        elif "\\entry{" in t:
            found = tagged((L.bib_row(*e) for e in L.parse_biblatex(t)), "biblatex_bbl")
        else:
            found = tagged((L.bbl_row(k, raw) for k, _, raw in L.parse_bibitems(t)), "bbl")
        rows += [(p, r) for r in found]
    if not rows:
        for p, t in tex.items():
            if "\\begin{biblist}" in t:
                rows += [(p, r) for r in tagged((L.bib_row(*e) for e in L.parse_amsrefs(t)), "amsrefs")]
            elif "thebibliography" in t:
                rows += [(p, L.bbl_row(k, raw)) for k, _, raw in L.parse_bibitems(L.inline(t, files, [L._folder(p), ""]))]
    if not rows:
        first = next(iter(by(".bib")), "")
        rows = [(first, L.bib_row(entries[k][0], k, entries[k][1])) for k in sorted(cited) if k in entries]
    else:
        rows = [(p, L.bib_row(entries[r["cite_key"]][0], r["cite_key"], entries[r["cite_key"]][1]) if r["cite_key"] in entries else r) for p, r in rows]
    return _first_keys(rows, cited)


def reference_lists(trees: DataFrame, order: str) -> DataFrame:
    """The reference list of each paper in ``trees`` (paper_id, path, content); the first of equal keys wins, files in the order of their paths.

    ``order`` is ``structured`` (.bib before printed lists) or ``printed`` (the
    other way round). The files of one paper are one group. A paper without
    references gives no rows.
    """
    read = {"structured": _structured_first, "printed": _printed_first}[order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = read(dict(zip(pdf["path"], pdf["content"].fillna(""))))
        return pd.DataFrame(rows, columns=["source_file", "cited_in_text", *L.REFERENCE]).assign(paper_id=pdf["paper_id"].iat[0])[[c.split()[0] for c in OUT.split(", ")]].astype(object)

    return trees.select("paper_id", "path", "content").groupBy("paper_id").applyInPandas(run, OUT)


def bodies(trees: DataFrame) -> DataFrame:
    """(paper_id, body) of each paper's main document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"paper_id": [pdf["paper_id"].iat[0]], "body": [L.document_body(dict(zip(pdf["path"], pdf["content"].fillna(""))))]})

    tex = trees.where(F.lower("path").endswith(".tex")).select("paper_id", "path", "content")
    return tex.groupBy("paper_id").applyInPandas(run, "paper_id string, body string")
