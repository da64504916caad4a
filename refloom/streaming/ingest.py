"""Resumable ingestion of new papers: what was done is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from refloom.operators.dedupe import not_done


def resume(todo: DataFrame, log_path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Do ``work`` for the rows of ``todo`` that the Parquet log at ``log_path`` lacks, and append its result there."""
    spark = todo.sparkSession
    try:
        left = not_done(todo, spark.read.parquet(log_path), [key])
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no log yet, or an empty one
            raise
        left = todo
    work(left).write.mode("append").parquet(log_path)


def ingest_new(spark: SparkSession, root: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Every Parquet file that is new below ``root`` once through ``work`` into ``out``.

    The checkpoint remembers files; a batch that is repeated after a failure
    replaces its own part, so the result holds each file once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(root)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
