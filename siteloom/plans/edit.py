"""Plans as rows: creation, change, edits and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.urls import normalize_url, plan_id
from siteloom.plans.model import FIELD, LEVEL, make_field

EDIT = (
    "struct<seq:int,action:string,field:string,new_name:string,name:string,level:int,type:string,required:boolean,"
    "description:string,container_selector:string,selector:string,attribute:string>"
)


def create_plans(roots: DataFrame, plans: DataFrame) -> DataFrame:
    """Empty plans for requested URLs (``url, created_at``) that have none."""
    known = plans.select(normalize_url(F.col("root_url")).alias("root_url"))
    fresh = (
        roots.select(normalize_url(F.col("url")).alias("root_url"), "created_at")
        .groupBy("root_url")
        .agg(F.min("created_at").alias("created_at"))
        .join(known, "root_url", "left_anti")
    )
    return fresh.select(
        plan_id(F.col("root_url"), F.col("created_at")).alias("id"),
        "root_url",
        F.lit("Item").alias("item_name"),
        F.lit(0).alias("nesting_depth"),
        F.array().cast("array<string>").alias("level_names"),
        F.array().cast(f"array<{LEVEL}>").alias("schema_chain"),
        F.array().cast("array<string>").alias("visited_urls"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def update_plans(plans: DataFrame, stamp: Column, **changes: Column) -> DataFrame:
    """Plans with named columns replaced and ``updated_at`` set; an unknown name is an error."""
    unknown = sorted(set(changes) - set(plans.columns))
    if unknown:
        raise ValueError(f"Unknown field: {unknown[0]}")
    return plans.withColumns({**changes, "updated_at": stamp})


def _edit_fields(fields: Column, edit: Column) -> Column:
    same = F.transform(fields, lambda f: F.coalesce(f["name"] == edit["field"], F.lit(False)))
    first = F.array_position(same, True).cast("int") - 1
    renamed = F.transform(fields, lambda f, i: F.when(i == first, f.withField("name", edit["new_name"])).otherwise(f))
    kept = F.filter(fields, lambda f: ~F.coalesce(f["name"] == edit["field"], F.lit(False)))

    def changed(f: Column) -> Column:
        out = f
        for name in ("name", "type", "required", "description", "container_selector", "selector", "attribute"):
            out = out.withField(name, F.coalesce(edit[name], f[name]))
        return out

    updated = F.transform(fields, lambda f, i: F.when(i == first, changed(f)).otherwise(f))
    new = make_field(
        name=edit["name"],
        type=F.coalesce(edit["type"], F.lit("string")),
        required=F.coalesce(edit["required"], F.lit(False)),
        description=F.coalesce(edit["description"], F.lit("")),
        container_selector=edit["container_selector"],
        selector=edit["selector"],
        attribute=F.coalesce(edit["attribute"], F.lit("text")),
    )
    return (
        F.when(edit["action"] == "rename", renamed)
        .when(edit["action"] == "delete", kept)
        .when(edit["action"] == "update", updated)
        .when(edit["action"] == "add", F.concat(fields, F.array(new)))
        .otherwise(fields)
    )


def apply_schema_edits(plans: DataFrame, edits: DataFrame) -> DataFrame:
    """Plans after their edits, applied in the order of ``seq``.

    ``level`` of an edit is an index from 0 (default 0); an edit outside the chain is skipped. Edits
    depend on one another only within one level of one plan, so that is the unit of work. An absent
    property of an ``update`` is null and keeps the old value.
    """
    levels = plans.select("id", F.posexplode("schema_chain").alias("at", "s")).select("id", "at", "s.fields")
    ordered = (
        edits.withColumn("at", F.coalesce("level", F.lit(0)))
        .groupBy(F.col("plan_id").alias("id"), "at")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(*[F.col(n) for n in _edit_columns()]))
            ).alias("edits")
        )
    )
    done = levels.join(ordered, ["id", "at"]).select(
        "id",
        "at",
        F.aggregate("edits", F.col("fields").cast(f"array<{FIELD}>"), _edit_fields).alias("fields"),
    )
    per_plan = done.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "fields"))).alias("edited"))
    chain = F.transform(
        "schema_chain",
        lambda s, i: s.withField("fields", F.coalesce(F.try_element_at(F.col("edited"), i), s["fields"])),
    )
    return (
        plans.join(per_plan, "id", "left")
        .withColumn("schema_chain", F.when(F.col("edited").isNull(), F.col("schema_chain")).otherwise(chain))
        .select(*plans.columns)
    )


def _edit_columns() -> list[str]:
    return [part.split(":")[0] for part in EDIT[7:-1].split(",")]


def validate_plans(plans: DataFrame) -> DataFrame:
    """Warnings per plan: ``id, pos, warning``; none means the plan is sound."""
    fields = F.flatten(F.transform("schema_chain", lambda s: s["fields"]))
    bare = lambda f: F.coalesce(f["selector"], F.lit("")) == ""
    names = lambda which: F.array_join(F.transform(which, lambda f: F.coalesce(f["name"], F.lit(""))), ", ")
    rows = plans.withColumn("_bare", F.filter(fields, bare)).withColumn("_count", F.size(fields))
    required = F.filter("_bare", lambda f: F.coalesce(f["required"], F.lit(False)))
    warnings = F.array(
        F.when(F.coalesce("root_url", F.lit("")) == "", F.lit("Missing root URL")),
        F.when(F.col("_count") == 0, F.lit("No fields defined")),
        F.when(F.size("_bare") > 0, F.concat(F.lit("Fields without selectors: "), names(F.col("_bare")))),
        F.when(F.size(required) > 0, F.concat(F.lit("Required fields without selectors: "), names(required))),
    )
    return rows.select("id", F.posexplode(F.filter(warnings, lambda w: w.isNotNull())).alias("pos", "warning"))


