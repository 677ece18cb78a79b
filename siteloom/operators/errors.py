"""What went wrong in a run, as one table: ``plan_id, level, url, kind, detail``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.selectors import is_supported
from siteloom.operators.extract import WHOLE_PAGE
from siteloom.sources.pages import lookup, missing

COLUMNS = ("plan_id", "level", "url", "kind", "detail")


def selector_errors(levels: DataFrame, nested: bool = True) -> DataFrame:
    """Selectors that match nothing because they are not supported, and fields without a name.

    Without ``nested`` the levels are meant for a reader that knows no nested lists (``:has``, ``:is``, ``:where``), so these are named too.
    """
    entry = lambda where, selector: F.struct(where.alias("place"), selector.alias("selector"))
    name = lambda f: F.coalesce(f["name"], F.lit(""))
    used = F.concat(
        F.array(entry(F.lit("item"), F.col("item_container_selector")), entry(F.lit("drill link"), F.col("drill_down_link_selector"))),
        F.transform("fields", lambda f: entry(F.concat(F.lit("container of "), name(f)), f["container_selector"])),
        F.transform("fields", lambda f: entry(F.concat(F.lit("field "), name(f)), f["selector"])),
    )
    place = ["plan_id", "level", F.col("sample_url").alias("url")]
    wrong = (
        levels.select(*place, F.inline(used))
        .where((F.col("selector") != "") & (F.col("selector") != WHOLE_PAGE) & ~is_supported(F.col("selector"), nested))
        .select("plan_id", "level", "url", F.lit("unsupported selector").alias("kind"), F.concat_ws(": ", "place", "selector").alias("detail"))
    )
    nameless = levels.select(*place, F.posexplode("fields").alias("pos", "f")).where(F.coalesce(F.col("f.name"), F.lit("")) == "")
    return wrong.unionByName(
        nameless.select("plan_id", "level", "url", F.lit("field without a name").alias("kind"), F.concat(F.lit("field "), F.col("pos")).alias("detail"))
    )


def run_errors(levels: DataFrame, docs: DataFrame, index: DataFrame, lost: DataFrame | None = None, nested: bool = True) -> DataFrame:
    """Errors of a scrape: unsupported selectors, unnamed fields, pages that are missing or were read in part.

    ``lost`` is ``Scrape.missing``; without it the levels' own pages are looked up. ``nested`` as for ``selector_errors``.
    """
    asked = levels.where(F.col("sample_url") != "").select("plan_id", "level", F.col("sample_url").alias("url"))
    gone = missing(asked, index) if lost is None else lost
    broken = docs.where(F.col("error").isNotNull()).select("page_id", F.col("error").alias("detail"))
    parsed = lookup(asked, index).join(broken, "page_id").withColumn("kind", F.lit("page read in part"))
    return (
        selector_errors(levels, nested)
        .unionByName(gone.select("plan_id", "level", "url", F.lit("missing page").alias("kind"), F.lit(None).cast("string").alias("detail")))
        .unionByName(parsed.select(*COLUMNS))
    )


def request_errors(requests: DataFrame, levels: DataFrame, index: DataFrame) -> DataFrame:
    """Correction requests (``plan_id, field``) that get no context: ``plan_id, field, error``."""
    fields = levels.select("plan_id", "level", F.col("sample_url").alias("url"), F.explode("fields.name").alias("field"))
    first = fields.groupBy("plan_id", "field").agg(F.min_by("url", "level").alias("url"))
    known = requests.select("plan_id", "field").join(first, ["plan_id", "field"], "left")
    unknown = known.where(F.col("url").isNull()).select("plan_id", "field", F.lit("no such field").alias("error"))
    return unknown.unionByName(missing(known.where(F.col("url").isNotNull()), index).select("plan_id", "field", "error"))
