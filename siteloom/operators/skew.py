"""Joins that hold when one key owns a large part of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The keys that own the most rows are spread, whether there are few rows or many: so many of them, whatever the data, so
# their list may be broadcast.
HOT_KEYS = 1000
SALTS = 64
# As many pages may be named in a broadcast; more are found by a join.
NAMED_PAGES = 1_000_000
# Pages whose matches one task handles. The bytes of a shuffle do not tell: pages of one site are alike and pack well.
PAGES_PER_TASK = 50


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The ``HOT_KEYS`` keys that hold the most rows, with a column ``hot``."""
    counts = rows.groupBy(*on).count().where("count > 1")
    return counts.orderBy(F.desc("count"), *on).limit(HOT_KEYS).select(*on, F.lit(True).alias("hot"))


def salted_join(
    many: DataFrame, one: DataFrame, on: list[str], how: str = "inner", idle: Column | None = None
) -> DataFrame:
    """Equi-join in which the most frequent keys of ``many`` are spread and their partners in ``one`` copied.

    Rows of ``many`` for which ``idle`` holds take no partner (left join) and are spread as well.
    ``many`` is read twice, so it should be a saved table or cheap to compute.
    """
    plain = [name for name, kind in many.dtypes if "map<" not in kind]
    spread = F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")
    hot = F.broadcast(hot_keys(many if idle is None else many.where(~idle), on))
    salt = F.when(F.col("hot"), spread).otherwise(0)
    if idle is not None:
        salt = F.when(idle, -1 - spread).otherwise(salt)
    left = many.join(hot, on, "left").withColumn("salt", salt).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, on, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return left.join(right, [*on, "salt"], how).drop("salt")


def spread_join(many: DataFrame, small: DataFrame, on: str, copies: int = 16, shuffled: bool = False) -> DataFrame:
    """Join to a table with one small row per key; each row is copied a fixed number of times.

    With ``shuffled`` no side goes through the driver. It is for tables that grow with the input: Spark judges ``small`` by its
    files, where rows that are alike take next to no room, does not count the copies, and would broadcast them.
    """
    salted = many.withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.lit(copies)).cast("int"))
    copied = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(copied.hint("merge") if shuffled else copied, [on, "salt"]).drop("salt")


def parts_of(rows: DataFrame, key: str, size: int, spread: list[str]) -> DataFrame:
    """Adds ``part``: the rows of one ``key`` in groups of about ``size``, chosen by hash."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("_parts")).where("_parts > 1")
    part = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    return rows.join(many, key, "left").withColumn("part", part).drop("_parts")


def tasks_for(pages: int, spark: SparkSession) -> int:
    """How many tasks so many pages need: more pages make more tasks and not larger ones."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(pages / PAGES_PER_TASK))


def with_pages(asked: DataFrame, docs: DataFrame, n: int | None = None) -> DataFrame:
    """The documents that ``asked`` (distinct, saved, with ``page_id``) names, once per row of it; no other one is moved."""
    few = (asked.count() if n is None else n) <= NAMED_PAGES
    return docs.join(F.broadcast(asked) if few else asked, "page_id")
