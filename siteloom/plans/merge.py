"""One schema out of all levels of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import blank_to_null, level_slug
from siteloom.plans.extraction import build_levels


def merged_fields(plans: DataFrame) -> DataFrame:
    """Merged fields of each plan, computed in the plan's row.

    A name that stands on several levels keeps only its last (deepest) definition and takes a
    prefix: the level's name, or ``level_<n>`` if levels of the same type hold it. Result: ``plan_id,
    pos, name, original_name, source_level, source_level_num, field``.
    """
    level_name = lambda s: F.coalesce(blank_to_null(s["catalog_type"]), F.concat(F.lit("level_"), s["level"]))
    entries = F.flatten(
        F.transform(
            "schema_chain",
            lambda s: F.transform(
                s["fields"],
                lambda f: F.struct(f.alias("f"), s["level"].alias("num"), level_name(s).alias("level_name")),
            ),
        )
    )
    later = lambda i: F.slice("_all", i + 2, F.greatest(F.size("_all") - i - 1, F.lit(0)))
    last = F.filter("_all", lambda e, i: ~F.exists(later(i), lambda g: g["f"]["name"] == e["f"]["name"]))
    places = lambda e: F.array_distinct(
        F.transform(
            F.filter("_all", lambda g: g["f"]["name"] == e["f"]["name"]),
            lambda g: F.struct(g["num"].alias("num"), g["level_name"].alias("level_name")),
        )
    )
    merged = F.transform(
        "_last",
        lambda e: F.struct(
            F.size(places(e)).alias("levels"),
            F.size(F.array_distinct(F.transform(places(e), lambda p: p["level_name"]))).alias("types"),
            e.alias("e"),
        ),
    )
    rows = (
        plans.select(F.col("id").alias("plan_id"), "schema_chain")
        .withColumn("_all", entries)
        .withColumn("_last", last)
        .select("plan_id", F.posexplode(merged).alias("pos", "m"))
    )
    name, num = F.col("m.e.f.name"), F.col("m.e.num")
    prefix = F.when(F.col("m.types") < F.col("m.levels"), F.concat(F.lit("level_"), num)).otherwise(
        level_slug(F.col("m.e.level_name"))
    )
    return rows.select(
        "plan_id",
        "pos",
        F.when(F.col("m.levels") > 1, F.concat_ws("_", prefix, name)).otherwise(name).alias("name"),
        name.alias("original_name"),
        F.col("m.e.level_name").alias("source_level"),
        num.alias("source_level_num"),
        F.col("m.e.f").alias("field"),
    )


def merged_levels(plans: DataFrame) -> DataFrame:
    """Level plans whose fields carry their merged names, ready for ``scrape``.

    The nesting analysis, where there is one, decides whether a level is final.
    """
    final = plans.select(
        F.col("id").alias("plan_id"),
        F.inline(
            F.transform(
                "schema_chain",
                lambda s: F.struct(s["level"].alias("level"), s["nesting_analysis"]["is_final_level"].alias("says_final")),
            )
        ),
    )
    names = (
        merged_fields(plans)
        .groupBy("plan_id")
        .agg(
            F.map_from_entries(
                F.array_distinct(
                    F.collect_list(
                        F.struct(F.concat_ws(":", "source_level", "original_name").alias("k"), F.col("name").alias("v"))
                    )
                )
            ).alias("mapping")
        )
    )
    levels = build_levels(plans).join(final, ["plan_id", "level"], "left").join(names, "plan_id", "left")
    renamed = F.transform(
        "fields",
        lambda f: f.withField(
            "name",
            F.coalesce(F.try_element_at(F.col("mapping"), F.concat_ws(":", F.col("level_name"), f["name"])), f["name"]),
        ),
    )
    return levels.withColumn("is_final_level", F.coalesce("says_final", "is_final_level")).withColumn(
        "fields", renamed
    ).drop("says_final", "mapping")


def final_names(plans: DataFrame, target_level: int | None = None) -> DataFrame:
    """Merged names of levels down to the target: ``plan_id, pos, name``."""
    names = merged_fields(plans)
    if target_level is not None:
        reached = merged_levels(plans).where(F.col("level") <= target_level)
        used = reached.select("plan_id", F.explode("fields").alias("f")).select("plan_id", F.col("f.name").alias("name"))
        names = names.join(used.distinct(), ["plan_id", "name"], "left_semi")
    return names.select("plan_id", "pos", "name")


def project_final(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Scraped rows with only the merged names."""
    per_plan = names.groupBy("plan_id").agg(F.collect_set("name").alias("names"))
    kept = F.map_filter("fields", lambda k, v: F.array_contains(F.col("names"), k))
    return rows.join(per_plan, "plan_id").withColumn("fields", kept).drop("names")
