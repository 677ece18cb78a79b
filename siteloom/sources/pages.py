"""Captured pages as a source, and the lookup that stands for a download."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.urls import normalized


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``pages(page_id, url, html)`` from Parquet; no other column is read."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def page_index(pages: DataFrame) -> DataFrame:
    """``url_key, page_id``: one page per normalized URL, the latest capture where there are several.

    Only the URL column moves; the aggregation combines before its shuffle, so a URL captured
    very often costs no more than one row per task.
    """
    return pages.groupBy(normalized("url").alias("url_key")).agg(F.max("page_id").alias("page_id"))


def lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requests (with ``url``) that have a page, with its ``page_id``."""
    keyed = requests.withColumn("url_key", normalized("url"))
    return keyed.join(index, "url_key").drop("url_key")


def missing(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requests without a page; they yield no rows and stop nothing."""
    keyed = requests.withColumn("url_key", normalized("url"))
    return keyed.join(index, "url_key", "left_anti").drop("url_key").withColumn("error", F.lit("missing page"))


def fetch_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests with the HTML of their page."""
    return lookup(requests, page_index(pages)).join(pages.select("page_id", "html"), "page_id")
