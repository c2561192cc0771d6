"""Pages as a stream: each micro-batch is parsed and its row-local issues are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations, technical

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, schema: str = PAGES, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, a bounded number in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def audit_stream(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes technical issues of arriving pages; site-wide rules run over the stored pages in batch."""

    def store(batch: DataFrame, number: int) -> None:
        technical.page_issues(relations.parse_pages(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
