"""CSV tables, JSON caches and TeX trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from refloom.functions.columns import folder_date, folder_title, readme_title
from refloom.schemas import REGISTRY, text_schema


def read_csv(spark: SparkSession, path: str, columns: list[str], missing_ok: bool = False) -> DataFrame:
    """A CSV table with header, every column text, quoted line breaks kept; a missing file gives no rows if allowed."""
    schema = text_schema(columns)
    try:
        return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', quote='"', enforceSchema=False)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, places: int | None = None, mode: str = "overwrite") -> None:
    """A CSV table with a fixed header; nulls as empty text, other columns left out, doubles rounded if asked. ``mode`` append resumes a log."""
    kinds = dict(df.dtypes)
    picked = [F.round(c, places).alias(c) if places is not None and kinds[c] == "double" else F.col(c) for c in columns or df.columns]
    df.select(*picked).write.csv(path, header=True, escape='"', quote='"', nullValue="", emptyValue="", mode=mode)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines cache of registry records: the last record per DOI in lower case, errors left out, so that they are looked up again.

    Later lines win; the order is file, then place in the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    records = raw.select(F.from_json("value", REGISTRY).alias("r"), "file", "block", "line").where("r.registry is not null and r.registry <> 'error' and r.doi is not null")
    return records.groupBy(F.lower("r.doi").alias("key")).agg(F.max_by("r", F.struct("file", "block", "line")).alias("r")).select("key", "r.*")


def append_cache(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_trees(spark: SparkSession, root: str, paper: str = r"/([^/]+)/", pattern: str = "*.{tex,bib,bbl,TEX,BIB,BBL}") -> DataFrame:
    """(paper_id, path, content): the TeX files below ``root``, malformed UTF-8 made valid; the folder below the root is the paper."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inside = F.regexp_extract("path", r"^(?:[a-z]+:)?/*(.*)$", 1)
    base = root.split(":", 1)[-1].strip("/")
    below = F.substring(inside, len(base) + 2, 1 << 20)
    return files.select(F.get(F.split(below, "/"), F.lit(0)).alias("paper_id"), F.regexp_replace(below, "^[^/]+/", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def paper_titles(folders: DataFrame, readmes: DataFrame) -> DataFrame:
    """(paper_id, title, date): from the folder's name, the title from the README (paper_id, content) where it has one."""
    r = readmes.select("paper_id", readme_title(F.col("content")).alias("named"))
    return folders.join(r, "paper_id", "left").select("paper_id", F.coalesce("named", folder_title(F.col("paper_id"))).alias("title"), folder_date(F.col("paper_id")).alias("date"))


UNPACKED = T.StructType([T.StructField("id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
