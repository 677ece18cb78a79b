"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Every document gets an exponential key, divided by its quality weight. Within a source, documents in key order
are a weighted random order; a running sum of their sizes cuts it at the source's budget. Whole epochs come first:
a target of 1.4 times a source takes each document once and then spends the rest on documents in key order.

Cases: a null text has size 0; a null source is a source of its own and comes last; a source without words has target 0;
repeated rows are separate documents (equal rows are interchangeable); an empty table gives an empty mix. Columns
other than those named play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siteloom.llm.common import lookup, save, unused

WORDS = r"[^\x20\x09-\x0D]+"
#: Key ranges per source. Running sums are made inside a range and over the ranges' totals, so no task holds a source.
RANGES = 4096


def quality_weight(text: Column) -> Column:
    """In (0, 1]: the share of lines that are no repeats, lowered by the share of markup characters."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    marks = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), fresh * (1 - marks))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the exponential key of every document; no text."""
    draw = (F.pmod(F.xxhash64("doc_id", "text", "source"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        (-F.log(draw) / quality_weight(F.col("text"))).alias("key"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, number, source_size, target: what each source gives.

    The level (words per unit of weight) rises until the capped sources and the rest use up the whole; each round is one
    aggregate of the table of sources and needs three numbers on the driver.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # an exact rank of any number of sources: sorted by ranges, numbered by the partitions' counts
    ordered = sums.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    kinds = T.StructType([sums.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("number", T.LongType())])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = save(
        spark.createDataFrame(ordered, kinds)
        .withColumn("weight", F.element_at(cycle, (F.pmod("number", F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", most * F.col("source_size")),
        "sources",
    )
    total, level = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.lit(0.0)).first()
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        spent, left = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if not left or (total - spent) / left <= level:
            break
        level = (total - spent) / left
    return sources.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap", "weight")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and epochs (whole passes) of every document.

    Documents are taken whole but for the one at which a source's budget ends, of which the rest of the budget is taken.
    """
    sizes = save(sized(docs), "sizes")
    goal = F.round("target").cast("long")
    words = F.greatest("source_size", F.lit(1))
    plans = targets(sizes, weights, share, most).withColumns(
        {"epochs": F.floor(goal / words).cast("long"), "budget": F.pmod(goal, words)}
    )
    part = F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int")
    drawn = lookup(sizes.withColumn("part", part), plans, ["source"], spread=F.xxhash64("key"))
    sums = lookup(sizes.withColumn("part", part).groupBy("source", "part").agg(F.sum("size").alias("words")), plans.select("source", "number"), ["source"])
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("number").alias("_number"), F.col("part").alias("_part"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("number", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, (F.col("number") == F.col("_number")) & (F.col("part") == F.col("_part"))
    )
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("start") - F.col("inside")))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"), "epochs"
    )


def repeats(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; of a cut document it comes if half of it or more is taken.

    A document without words is taken as often as its source's whole passes. Rows that share an id are dealt out alike: the
    count is that of the id's rows together, spread evenly.
    """
    own, copy = unused("_times", docs), unused("_copy", docs)
    counts = mix(docs, **settings).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max("epochs").alias("epochs"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.col("epochs")).cast("int")
    counts = counts.select("doc_id", times.alias(own)).where(F.col(own) > 0)
    rows = lookup(docs, counts, ["doc_id"], salts=8, spread=F.xxhash64("text")).where(F.col(own) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*docs.columns)
