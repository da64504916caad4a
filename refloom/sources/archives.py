"""Downloaded source archives: what they are, and their files."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from refloom.sources.files import UNPACKED


def sniff(blob: bytes) -> tuple[str, dict[str, bytes]]:
    """(ok, pdf_only or not_latex; path -> content): a PDF, a tar or gzipped tar, or a single TeX file. Absolute paths and ``..`` are left out."""
    if blob[:4] == b"%PDF":
        return "pdf_only", {}
    if blob[:2] == b"\x1f\x8b":
        try:
            blob = gzip.decompress(blob)
        except (OSError, EOFError):
            return "not_latex", {}
    try:
        with tarfile.open(fileobj=io.BytesIO(blob)) as tar:
            safe = [m for m in tar.getmembers() if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/")]
            return "ok", {m.name: tar.extractfile(m).read() for m in safe}
    except tarfile.TarError:
        pass
    if blob[:4] == b"%PDF":
        return "pdf_only", {}
    start = blob[:20_000]
    if b"\\documentclass" in start or b"\\input" in start or b"\\begin{document}" in blob:
        return "ok", {"main.tex": blob}
    return "not_latex", {}


def unpack(archives: DataFrame) -> DataFrame:
    """(id, status, path, content) of ``archives`` (id, content binary): a row per file, or one without path for an archive that has none."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i, blob in zip(pdf["id"], pdf["content"]):
                status, files = sniff(bytes(blob or b""))
                rows = [(i, status, p, c.decode("utf-8", "replace")) for p, c in files.items()] or [(i, status, None, None)]
                yield pd.DataFrame(rows, columns=UNPACKED.names)

    return archives.select("id", "content").mapInPandas(run, UNPACKED)
