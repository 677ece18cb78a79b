"""Answers of a model: cleaned, parsed, and the broken ones told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import cut, strip
from siteloom.plans.discovery import SCHEMA
from siteloom.plans.model import NESTING, struct_type

CORRECTION = (
    "struct<corrected_container_selector:string,corrected_selector:string,corrected_attribute:string,"
    "reasoning:string,confidence:double>"
)
BODIES = {"schema": SCHEMA, "nesting": NESTING, "correction": CORRECTION}
_PREVIEW = 200


def clean_response(raw: Column) -> Column:
    """The JSON text of an answer, without a Markdown fence around it."""
    text = strip(raw)
    opened = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    return F.when(text.startswith("```"), strip(F.regexp_replace(opened, r"\n?```\s*$", ""))).otherwise(text)


def parse_responses(responses: DataFrame, kind: str) -> DataFrame:
    """``responses`` (with ``raw``) plus ``body`` (a struct, null if broken) and ``error``."""
    text = clean_response(F.col("raw"))
    rows = responses.withColumn("_text", text)
    parsed = F.try_parse_json("_text")
    broken = parsed.isNull()
    # members that are there must have their type: what is read as null was null or absent
    names = [f.name for f in struct_type(BODIES[kind]).fields]
    body = F.from_json("_text", struct_type(BODIES[kind]))
    given = lambda name: F.coalesce(F.get_json_object("_text", "$." + name), F.lit("null")) != "null"
    wrong = F.array_compact(F.array(*[F.when(given(n) & F.col("_body")[n].isNull(), F.lit(n)) for n in names]))
    preview = F.concat(cut(F.col("_text"), _PREVIEW), F.when(F.length("_text") > _PREVIEW, "...").otherwise(""))
    error = F.when(F.coalesce("raw", F.lit("")) == "", F.lit("empty response")).when(
        broken, F.concat(F.lit("invalid JSON: "), preview)
    ).when(
        ~F.schema_of_variant(parsed).startswith("OBJECT"), F.concat(F.lit("no JSON object: "), preview)
    ).when(F.size("_wrong") > 0, F.concat(F.lit("wrong type: "), F.array_join("_wrong", ", ")))
    return (
        rows.withColumn("_body", body)
        .withColumn("_wrong", wrong)
        .withColumn("error", error)
        .withColumn("body", F.when(F.col("error").isNull(), F.col("_body")))
        .drop("_text", "_body", "_wrong")
    )


def correction_fixes(corrections: DataFrame) -> DataFrame:
    """Parsed corrections (``plan_id, seq, field, body``) as field fixes."""
    body = F.col("body")
    return corrections.where(body.isNotNull()).select(
        "plan_id",
        "seq",
        "field",
        body["corrected_container_selector"].alias("container_selector"),
        body["corrected_selector"].alias("selector"),
        body["corrected_attribute"].alias("attribute"),
        (body["corrected_container_selector"].isNull() & body["corrected_selector"].isNotNull()).alias("clear_container"),
    )
