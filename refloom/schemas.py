"""Column lists of the relations; at the edge every column is text."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the files.
REFERENCES = "preprint_folder preprint_title preprint_date source_format source_file cite_key cited_in_text entry_type author title year journal_or_venue booktitle publisher volume number pages doi arxiv_id url note normalized_id raw_reference".split()
HUMAN_REFERENCES = [*REFERENCES[:3], "primary_category", "n_authors", *REFERENCES[3:]]
INTEXT = "paper_id cite_index command key group_size postnote pinpoint_class prose_pinpoint section_number section_title section_kind in_proof position".split()
SUBJECTS = "preprint_folder preprint_title subject n_arxiv_refs_with_category subject_share".split()
LISTING = "id version title published updated primary_category categories n_authors".split()
CANDIDATES = ["stratum", "rank", "n_ai_in_stratum", *LISTING]
SAMPLE_LOG = "stratum rank id status n_references".split()
SAMPLE = "stratum rank id status selected n_references".split()

REGISTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("doi", "registry", "type", "title")] + [T.StructField("years", T.ArrayType(T.IntegerType()))] + [T.StructField(n, T.StringType()) for n in ("first_author", "venue", "volume", "page")])


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
