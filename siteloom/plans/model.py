"""Schemas of plans, levels and fields, as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = (
    "struct<name:string,type:string,required:boolean,description:string,container_selector:string,"
    "selector:string,attribute:string,sample_value:string>"
)
NESTING = (
    "struct<is_final_level:boolean,reasoning:string,recommended_link_index:string,recommended_link_reason:string,"
    "drill_down_link_selector:string,ranked_candidates:array<struct<link_index:string,label:string,reason:string,"
    "confidence:string>>>"
)
LEVEL = (
    "struct<level:int,url:string,is_catalog:boolean,catalog_type:string,confidence:double,archetype:string,"
    f"item_name:string,item_container_selector:string,fields:array<{FIELD}>,reasoning:string,"
    f"nesting_analysis:{NESTING}>"
)
PLAN = (
    "id string, root_url string, item_name string, nesting_depth int, level_names array<string>, "
    f"schema_chain array<{LEVEL}>, visited_urls array<string>, created_at string, updated_at string"
)
LEVEL_PLAN = (
    "plan_id string, level int, level_name string, sample_url string, catalog_type string, item_name string, "
    "item_container_selector string, is_final_level boolean, drill_down_link_selector string, "
    f"fields array<{FIELD}>"
)

# What a stored field, level or plan holds where its JSON says nothing.
FIELD_DEFAULTS = {"name": "", "type": "string", "required": False, "description": "", "attribute": "text"}
LEVEL_DEFAULTS = {"level": 1, "url": "", "is_catalog": False, "confidence": 0.0, "reasoning": ""}
PLAN_DEFAULTS = {"id": "", "root_url": "", "item_name": "Item", "nesting_depth": 1}


def struct_type(ddl: str) -> T.StructType:
    return T.DataType.fromDDL(ddl)


def make_struct(ddl: str, defaults: dict | None = None, **values: Column) -> Column:
    """A struct of the given type; members not named take their default or null."""
    fields = struct_type(ddl).fields
    defaults = defaults or {}
    return F.struct(
        *[values.get(f.name, F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in fields]
    )


def make_field(**values: Column) -> Column:
    return make_struct(FIELD, FIELD_DEFAULTS, **values)


def make_level(**values: Column) -> Column:
    empty = F.array().cast(f"array<{FIELD}>")
    return make_struct(LEVEL, LEVEL_DEFAULTS, **{"fields": empty, **values})


def _filled(value: Column, defaults: dict) -> Column:
    out = value
    for name, default in defaults.items():
        out = out.withField(name, F.coalesce(value[name], F.lit(default)))
    return out


def named_fields(fields: Column) -> Column:
    """Fields of an answer as stored ones: no list is none, and what a field leaves out takes its default."""
    return F.coalesce(F.transform(fields, lambda f: _filled(f, FIELD_DEFAULTS)), F.array().cast(f"array<{FIELD}>"))


def fill_defaults(plans: DataFrame) -> DataFrame:
    """Stored plans as they are meant: nulls of absent keys become the defaults."""
    field = lambda f: _filled(f, FIELD_DEFAULTS)
    level = lambda s: _filled(s, LEVEL_DEFAULTS).withField(
        "fields", F.coalesce(F.transform(s["fields"], field), F.array().cast(f"array<{FIELD}>"))
    )
    out = plans
    for name, default in PLAN_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return (
        out.withColumn("level_names", F.coalesce("level_names", F.array().cast("array<string>")))
        .withColumn("visited_urls", F.coalesce("visited_urls", F.array().cast("array<string>")))
        .withColumn("schema_chain", F.coalesce(F.transform("schema_chain", level), F.array().cast(f"array<{LEVEL}>")))
    )
