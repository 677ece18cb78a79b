"""From discovered plans to extraction plans, and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import blank_to_null
from siteloom.operators.quality import field_names, fix_decisions
from siteloom.operators.scrape import sample
from siteloom.operators.search import find_values
from siteloom.operators.summary import SHORT, summarize
from siteloom.plans.model import FIELD, make_field
from siteloom.sources.pages import lookup


def build_levels(plans: DataFrame) -> DataFrame:
    """Level plans of each plan, in the plan's row (no shuffle)."""
    level = lambda s: F.struct(
        s["level"].alias("level"),
        F.coalesce(blank_to_null(s["catalog_type"]), F.concat(F.lit("level_"), s["level"])).alias("level_name"),
        s["url"].alias("sample_url"),
        s["catalog_type"].alias("catalog_type"),
        s["item_name"].alias("item_name"),
        s["item_container_selector"].alias("item_container_selector"),
        (s["level"] == F.size("schema_chain")).alias("is_final_level"),
        s["nesting_analysis"]["drill_down_link_selector"].alias("drill_down_link_selector"),
        F.transform(
            s["fields"],
            lambda f: make_field(
                name=f["name"],
                type=f["type"],
                container_selector=f["container_selector"],
                selector=f["selector"],
                attribute=f["attribute"],
            ),
        ).alias("fields"),
    )
    return plans.select(F.col("id").alias("plan_id"), F.inline(F.transform("schema_chain", level)))


def plan_summaries(plans: DataFrame) -> DataFrame:
    """Path, depth, number of fields and item name of each extraction plan."""
    name = lambda s: F.coalesce(blank_to_null(s["catalog_type"]), F.concat(F.lit("Level "), s["level"]))
    return plans.select(
        F.col("id").alias("plan_id"),
        "root_url",
        F.array_join(F.transform("schema_chain", name), " -> ").alias("path"),
        F.size("schema_chain").alias("depth"),
        F.aggregate("schema_chain", F.lit(0), lambda n, s: n + F.size(s["fields"])).alias("total_fields"),
        "item_name",
    )


def check_sample(levels: DataFrame, target_level: int | None = None) -> DataFrame:
    """Reasons why a plan cannot be sampled: ``plan_id, pos, error``; no rows means it can."""
    named = F.coalesce(blank_to_null(F.col("catalog_type")), F.concat(F.lit("Level "), F.col("level")))
    target = F.coalesce(F.lit(target_level).cast("int"), F.col("max_level"))
    lacks = F.coalesce(F.col("item_container_selector"), F.lit("")) == ""
    per_plan = (
        levels.join(levels.groupBy("plan_id").agg(F.max("level").alias("max_level")), "plan_id")
        .groupBy("plan_id", "max_level")
        .agg(
            F.array_sort(
                F.collect_list(F.when(lacks & (F.col("level") <= target), F.struct("level", named.alias("name"))))
            ).alias("lacking")
        )
    )
    invalid = F.concat(F.lit("Invalid target level "), target, F.lit(". Valid range: 1-"), F.col("max_level"))
    names = F.array_join(F.transform("lacking", lambda x: x["name"]), ", ")
    errors = (
        F.when((target < 1) | (target > F.col("max_level")), F.array(invalid))
        .when(
            F.size("lacking") > 0,
            F.array(
                F.concat(F.lit("Missing item_container_selector for: "), names),
                F.lit("Please re-run discovery to generate CSS selectors"),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
    )
    return per_plan.select("plan_id", F.posexplode(errors).alias("pos", "error"))


def checked_sample(
    levels: DataFrame, docs: DataFrame, max_rows: int = 3, target_level: int | None = None, index: DataFrame | None = None
):
    """``scrape.sample`` of the plans without errors, and the errors of the others."""
    errors = check_sample(levels, target_level)
    good = levels.join(errors.select("plan_id").distinct(), "plan_id", "left_anti")
    return sample(good, docs, max_rows, target_level, index), errors


def find_fields(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """First level and field with each requested name (``plan_id, field``)."""
    fields = levels.select(
        "plan_id", "level", "sample_url", "item_container_selector", F.posexplode("fields").alias("pos", "f")
    ).withColumn("field", F.col("f.name"))
    first = fields.groupBy("plan_id", "field").agg(
        F.min_by(F.struct("level", "pos", "sample_url", "item_container_selector", "f"), F.struct("level", "pos")).alias("hit")
    )
    return requests.join(first, ["plan_id", "field"]).select(*requests.columns, "hit.*")


def apply_field_fixes(levels: DataFrame, fixes: DataFrame) -> DataFrame:
    """Levels with corrected selectors.

    ``fixes`` holds ``plan_id, seq, field, container_selector, selector, attribute`` and optionally
    ``clear_container``. A null keeps the old value; later fixes win. Only the first field of a
    name is corrected. Fixes are combined per field before they are joined.
    """
    clears = F.coalesce("clear_container", F.lit(False)) if "clear_container" in fixes.columns else F.lit(False)
    latest = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("seq")))
    container = F.when(clears, F.lit("")).otherwise(F.col("container_selector"))
    combined = fixes.groupBy("plan_id", "field").agg(
        latest(container).alias("new_container"),
        latest(F.col("selector")).alias("new_selector"),
        latest(F.col("attribute")).alias("new_attribute"),
    )
    rows = levels.select("plan_id", "level", F.posexplode("fields").alias("pos", "f")).withColumn("field", F.col("f.name"))
    order = Window.partitionBy("plan_id", "field").orderBy("level", "pos")
    fixed = (
        rows.withColumn("nth", F.row_number().over(order))
        .join(combined, ["plan_id", "field"], "left")
        .withColumn("hit", F.col("nth") == 1)
    )
    put = lambda new, old: F.when(F.col("hit"), F.coalesce(F.col(new), F.col(old))).otherwise(F.col(old))
    field = (
        F.col("f")
        .withField("container_selector", blank_to_null(put("new_container", "f.container_selector")))
        .withField("selector", put("new_selector", "f.selector"))
        .withField("attribute", put("new_attribute", "f.attribute"))
    )
    grouped = fixed.groupBy("plan_id", "level").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", field.alias("f")))), lambda x: x["f"]).alias("fixed")
    )
    return levels.join(grouped, ["plan_id", "level"], "left").select(
        *[
            F.coalesce("fixed", F.array().cast(f"array<{FIELD}>")).alias("fields") if c == "fields" else F.col(c)
            for c in levels.columns
        ]
    )


def correction_context(
    requests: DataFrame, levels: DataFrame, docs: DataFrame, index: DataFrame, max_hits: int | None = None
) -> DataFrame:
    """All that a correction of a field needs: definition, page summary and where the value stands.

    ``requests`` holds ``plan_id, field, expected_value``; a field may be asked about with several values.
    """
    keys = ["plan_id", "field", "expected_value"]
    found = find_fields(requests, levels).withColumn("url", F.col("sample_url"))
    placed = lookup(found, index)
    hits = find_values(placed.select(*keys, "page_id"), docs, max_hits)
    listed = hits.groupBy(*keys).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "pos", "tag", "classes", "id", "parent_chain", "text_preview", "selector_hint",
                        "attribute_found", "full_text",
                    )
                )
            ),
            lambda h: h.dropFields("pos"),
        ).alias("found_elements")
    )
    summaries = summarize(docs.join(placed.select("page_id").distinct(), "page_id", "left_semi"), **SHORT).drop("url")
    return placed.join(listed, keys, "left").join(summaries, "page_id")


def fix_and_resample(
    levels: DataFrame,
    fixes: DataFrame,
    docs: DataFrame,
    max_rows: int = 3,
    target_level: int | None = None,
    index: DataFrame | None = None,
):
    """Corrected levels, their new sample and the decisions that are still open."""
    fixed = apply_field_fixes(levels, fixes)
    rows, _ = checked_sample(fixed, docs, max_rows, target_level, index)
    return fixed, rows, fix_decisions(rows, field_names(fixed))
