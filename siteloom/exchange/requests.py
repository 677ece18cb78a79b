"""Requests to a model, one row each: ``request_id, kind, url, prompt``.

The call itself is made elsewhere; these jobs write its input table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.urls import part, rstrip_slashes

# The keys an answer must have.
_FIELD_KEYS = '{"name", "type": "string | number | boolean | url | date", "required", "description", "container_selector", "selector", "attribute": "text | href | src | ..."}'
SCHEMA_KEYS = (
    '{"is_catalog", "catalog_type", "confidence", "archetype", "item_schema": {"item_name", '
    f'"item_container_selector", "fields": [{_FIELD_KEYS}]}}, "reasoning"}}'
)
NESTING_KEYS = (
    '{"is_final_level", "reasoning", "recommended_link_index", "recommended_link_reason", '
    '"drill_down_link_selector", "ranked_candidates": [{"link_index", "label", "reason", "confidence"}]}'
)
CORRECTION_KEYS = '{"corrected_container_selector", "corrected_selector", "corrected_attribute", "reasoning", "confidence"}'

_LIST_TASK = (
    "Decide whether the page repeats one kind of entry. is_catalog says so, item_name names an entry in the singular, and "
    "item_container_selector matches each entry once and nothing else. Give one member of fields for each distinct value that "
    "the entries show; its selectors are read from inside one entry. A value you cannot address safely keeps its name, with null "
    "as its selector. archetype says how the entries are laid out. Fill item_schema in any case."
)
_DETAIL_TASK = (
    "The page is the record of one thing. Set is_catalog to false if it lists nothing, and give one member of fields for each "
    "value that belongs to the thing itself: container_selector finds the block that holds the value on the page, selector the "
    "value inside that block. Values that other pages of the site repeat unchanged do not belong to the thing."
)
_NESTING_TASK = (
    "Each numbered line below is a link of the page. Say whether following one kind of them gives a record with more values than "
    "the page shows (is_final_level is false then). ranked_candidates names such links by number, the most promising one first, and "
    "drill_down_link_selector finds the link of that kind from inside an entry. Without such links ranked_candidates stays empty."
)
_CORRECTION_TASK = (
    "A value of this page is read from the wrong place. Give the pair of selectors that reads the expected value: a block, or null "
    "where the entry itself is the block, and the place inside it. Give null for both if the page does not show the value."
)
_SITE_WIDE = "  (site-wide)"


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ": "), F.coalesce(value.cast("string"), F.lit("none")))


def _json(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ": "), F.to_json(value, {"ignoreNullFields": "false"}))


def schema_requests(summaries: DataFrame, detail: bool = False, max_structures: int | None = None) -> DataFrame:
    """Asks what a page holds, with all structures of its summary or the first ``max_structures``."""
    structures = F.col("structural_elements")
    shown = structures if max_structures is None else F.slice(structures, 1, max_structures)
    kind = "schema_detail" if detail else "schema_list"
    return summaries.select(
        F.concat_ws(":", F.lit(kind), F.col("page_id")).alias("request_id"),
        F.lit(kind).alias("kind"),
        "url",
        _lines(
            _DETAIL_TASK if detail else _LIST_TASK,
            "Answer with JSON only: " + SCHEMA_KEYS,
            _labelled("URL", F.col("url")),
            _labelled("Title", F.col("title")),
            _json("Structures", shown),
            _json("Common classes", F.col("common_classes")),
            _json("Samples", F.col("samples")),
            _json("Links", F.col("link_samples")),
        ).alias("prompt"),
    )


def nesting_requests(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Asks whether to go deeper.

    ``pages`` holds ``page_id, url, title, catalog_type, item_name, item_container_selector`` and
    ``links`` the link pool (``page_id, position, link_url, label`` and optionally ``in_nav``).
    """
    text = F.when(F.col("label") != "", F.concat(F.lit('  "'), F.col("label"), F.lit('"')))
    nav = F.when(F.col("in_nav"), _SITE_WIDE) if "in_nav" in links.columns else F.lit("")
    line = F.concat(
        F.lit("  "), F.col("position"), F.lit(": "), F.col("link_url"), F.coalesce(text, F.lit("")), F.coalesce(nav, F.lit(""))
    )
    listed = links.groupBy("page_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("links")
    )
    return pages.join(listed, "page_id", "left").select(
        F.concat_ws(":", F.lit("nesting"), F.col("page_id")).alias("request_id"),
        F.lit("nesting").alias("kind"),
        "url",
        _lines(
            _NESTING_TASK,
            "Answer with JSON only: " + NESTING_KEYS,
            _labelled("URL", F.col("url")),
            _labelled("Root path", rstrip_slashes(part(F.col("url"), "path"))),
            _labelled("Title", F.col("title")),
            _labelled("Catalog type", F.col("catalog_type")),
            _labelled("Item", F.coalesce("item_name", F.lit("unknown"))),
            _labelled("Item selector", F.coalesce("item_container_selector", F.lit("unknown"))),
            "Links:",
            F.coalesce("links", F.lit("")),
        ).alias("prompt"),
    )


def correction_requests(contexts: DataFrame) -> DataFrame:
    """Asks for a better selector.

    ``contexts`` are the rows of ``correction_context`` with ``user_feedback`` and ``current_value``.
    """
    found = F.when(
        F.size("found_elements") > 0, _json("The expected value was found here", F.col("found_elements"))
    ).otherwise("The expected value was not found on the page; it may be split up or written differently.")
    return contexts.select(
        F.concat_ws(":", F.lit("correction"), F.col("plan_id"), F.col("field")).alias("request_id"),
        F.lit("correction").alias("kind"),
        "url",
        _lines(
            _CORRECTION_TASK,
            "Answer with JSON only: " + CORRECTION_KEYS,
            _labelled("Field", F.col("field")),
            _labelled("Item selector", F.col("item_container_selector")),
            _labelled("Container", F.coalesce("f.container_selector", F.lit("the item"))),
            _labelled("Selector", F.col("f.selector")),
            _labelled("Attribute", F.col("f.attribute")),
            _labelled("Value now", F.coalesce("current_value", F.lit("nothing"))),
            _labelled("What is wrong", F.col("user_feedback")),
            _labelled("Expected value", F.col("expected_value")),
            found,
            _json("Common classes", F.col("common_classes")),
            _json("Samples", F.col("samples")),
        ).alias("prompt"),
    )
