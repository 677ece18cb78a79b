"""Stored plans as a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.urls import normalized
from siteloom.plans.model import PLAN, fill_defaults, struct_type


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plan files (one JSON object each). A file that is not valid JSON gives no plan."""
    raw = (
        spark.read.schema(PLAN + ", _corrupt_record string")
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .json(path)
    )
    return fill_defaults(raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))


def parse_plans(json: DataFrame, column: str = "json") -> DataFrame:
    """Plans held as JSON strings; invalid strings give no plan."""
    parsed = json.withColumn(
        "_plan", F.from_json(F.col(column), struct_type(PLAN + ", _corrupt_record string").simpleString(),
                             {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    good = parsed.where(F.col("_plan").isNotNull() & F.col("_plan._corrupt_record").isNull())
    return fill_defaults(good.select("_plan.*").drop("_corrupt_record"))


def field_count(chain: Column) -> Column:
    return F.aggregate(chain, F.lit(0), lambda n, level: n + F.size(level["fields"]))


def list_plans(plans: DataFrame) -> DataFrame:
    """Summary of each plan; fields are counted over all levels."""
    return plans.select(
        "id", "root_url", "item_name", "nesting_depth",
        field_count(F.col("schema_chain")).alias("field_count"), "created_at", "updated_at",
    )


def find_plans(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans for requested URLs, in whatever spelling; null columns where there is none."""
    keyed = plans.withColumn("url_key", normalized("root_url"))
    return requests.withColumn("url_key", normalized("url")).join(keyed, "url_key", "left")


def reusable(plans: DataFrame) -> DataFrame:
    """Plans with at least one level; an empty plan needs discovery."""
    return plans.where(F.size("schema_chain") > 0)


def reuse_offers(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """For each requested URL: offer to reuse the plan, or go to discovery."""
    found = find_plans(requests, reusable(plans))
    return found.select(
        "url",
        "url_key",
        F.when(F.col("id").isNotNull(), F.array(F.lit("reuse"), F.lit("rediscover")))
        .otherwise(F.array(F.lit("discover")))
        .alias("options"),
    )
