"""Items of pages as a stream: captures come in any order, late and more than once; the table ends up as if all had come at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.functions.urls import normalized
from siteloom.operators.extract import compile_levels, extract_items, split_tasks, with_levels
from siteloom.operators.parse import parse_pages, spread_pages
from siteloom.operators.select import steps_sizes
from siteloom.session import keep

CAPTURES = "page_id bigint, url string, html string, captured_at timestamp"


def stream_items(
    spark: SparkSession, levels: DataFrame, captures: str, items: str, state: str, late: str = "1 day", files_per_batch: int = 1000
) -> StreamingQuery:
    """New Parquet files of captures (``page_id, url, html, captured_at``) become item rows in the folder ``items``.

    ``levels`` are level plans whose ``sample_url`` is the page they are about. A capture of a page with contents that came
    before, within ``late`` of event time, is dropped by the stream's own state. What a batch makes is written to a folder named
    by the batch, in place of what an earlier try of it may have left, so each batch counts once however often the query is
    stopped and started again. The query takes what is there and ends.
    """
    keyed = levels.withColumn("page_key", normalized("sample_url"))
    compiled = keep(compile_levels(keyed).withColumn("page_key", normalized("sample_url")).withColumn("plan_id", F.to_json(F.struct("plan_id", "level"))))
    sizes = steps_sizes(compiled)
    source = spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", files_per_batch).parquet(captures)
    fresh = source.withColumn("digest", F.md5("html")).withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["page_id", "digest"])

    def write(batch: DataFrame, number: int) -> None:
        # of several captures in the batch each is a page of its own
        pages = keep(batch.withColumn("capture", F.xxhash64("page_id", "digest")))
        docs = parse_pages(spread_pages(pages.select(F.col("capture").alias("page_id"), "url", "html")))
        tasks = pages.select(F.col("capture").alias("page_id"), "url", normalized("url").alias("page_key"))
        wanted = tasks.join(compiled.select("page_key", "plan_id"), "page_key").drop("page_key")
        joined = with_levels(keep(split_tasks(wanted)), compiled.drop("level", "sample_url", "page_key", "definition"))
        made = extract_items(joined, keep(docs), sizes).withColumnRenamed("page_id", "capture").drop("url")
        # a page that no longer shows items takes its earlier ones away
        rows = wanted.withColumnRenamed("page_id", "capture").join(made, ["capture", "plan_id"], "left")
        when = pages.select("capture", "page_id", "captured_at")
        rows.join(when, "capture").write.mode("overwrite").parquet(f"{items.rstrip('/')}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def current_items(spark: SparkSession, items: str) -> DataFrame:
    """``plan_id, level, url, page_id, item, fields, drill_url`` of the latest capture of each plan's page; the larger page id at a tie."""
    rows = spark.read.option("basePath", items).parquet(f"{items.rstrip('/')}/batch=*")
    order = Window.partitionBy("plan_id").orderBy(F.desc("captured_at"), F.desc("page_id"), "capture")
    latest = rows.withColumn("place", F.dense_rank().over(order)).where("place = 1 and item is not null")
    key = F.from_json("plan_id", "plan_id string, level int")
    return latest.select(key["plan_id"].alias("plan_id"), key["level"].alias("level"), "url", "page_id", "item", "fields", "drill_url")
