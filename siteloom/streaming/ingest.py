"""Pages that keep arriving: parsed once, as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siteloom.operators.parse import parse_pages

PAGES = "page_id bigint, url string, html string"


def stream_docs(spark: SparkSession, pages: str, docs: str, state: str, files_per_batch: int = 1000) -> StreamingQuery:
    """New Parquet files of pages become document rows in ``docs``, each file exactly once.

    ``state`` is the query's checkpoint folder. The query takes what is there and ends; start it
    again (or on a schedule) for what has come since.
    """
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(pages)
    return (
        parse_pages(source)
        .writeStream.format("parquet")
        .option("path", docs)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def stream_batches(
    spark: SparkSession, pages: str, state: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 1000
) -> StreamingQuery:
    """Calls ``handle(docs, batch_id)`` for each batch of new pages, for example to scrape them."""
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(pages)
    return (
        source.writeStream.foreachBatch(lambda batch, number: handle(parse_pages(batch), number))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
