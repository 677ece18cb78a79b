"""Candidate links of pages: collected, resolved, filtered, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.selectors import compile_selectors
from siteloom.functions.text import blank_to_null, cut, strip
from siteloom.functions.urls import (
    DEAD_PREFIXES,
    is_valid_drill_link,
    resolved,
    score_drill_link,
    starts_with_any,
    url_label,
)
from siteloom.operators.parse import strings_of
from siteloom.operators.select import candidates, settle, steps_sizes
from siteloom.operators.skew import spread_join, tasks_for, with_pages
from siteloom.operators.summary import all_links
from siteloom.session import keep

# How many candidates and links a short decision shows, as callers that want one pass them.
MAX_CANDIDATES = 8
MAX_LINKS_MANUAL = 20
MAX_LINKS_FINAL = 10


def resolve_links(links: DataFrame) -> DataFrame:
    """Valid links of each page as absolute URLs, each once, at its first position.

    ``links`` holds ``page_id, url, pos, href``; the result ``page_id, url, link_url, pos``.
    """
    target = links.withColumn("link_url", resolved("url", "href"))
    valid = target.where(is_valid_drill_link(F.col("href"), F.col("url"), F.col("link_url")))
    return valid.groupBy("page_id", "url", "link_url").agg(F.min("pos").alias("pos"))


def item_links(scopes: DataFrame, docs: DataFrame, label_length: int | None = None) -> DataFrame:
    """Links inside the item containers of each page: ``page_id, url, pos, href, text``.

    ``scopes`` holds ``page_id, url, item_container_selector``. Outermost containers do not overlap,
    so the order "container, then link" is document order.
    """
    keys = ["page_id", "url"]
    wanted = scopes.where(F.col("item_container_selector") != "")
    listed = F.inline(
        F.array(
            F.struct(F.lit(0).alias("sel"), F.col("item_container_selector").alias("selector")),
            F.struct(F.lit(1).alias("sel"), F.lit("a[href]").alias("selector")),
        )
    )
    # selectors are compiled once per distinct text and not per page
    texts = wanted.select("item_container_selector").distinct()
    compiled = (
        compile_selectors(texts.select("item_container_selector", listed))
        .select("item_container_selector", F.transform("steps", lambda s: s.withField("sel", F.col("sel"))).alias("steps"))
        .groupBy("item_container_selector")
        .agg(F.flatten(F.collect_list("steps")).alias("steps"))
    )
    sizes = steps_sizes(compiled)
    asked = keep(wanted.select("page_id").distinct())
    n = asked.count()
    spread = [tasks_for(n, docs.sparkSession), "page_id"]
    pages = with_pages(asked, docs.select("page_id", "elems", "texts"), n)
    tasks = spread_join(wanted, compiled, "item_container_selector").repartition(*spread).join(pages.repartition(*spread), "page_id")
    text = lambda e: cut(F.array_join(strings_of(F.col("texts"), e), ""), label_length)
    found = candidates(
        tasks,
        keys,
        lambda e, s: {
            "href": F.when(s["sel"] == 1, F.try_element_at(e["attrs"], F.lit("href"))),
            "text": F.when(s["sel"] == 1, text(e)),
        },
        sizes[2],
    )
    before = Window.partitionBy(*keys).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
    inside = (
        settle(found, keys, *sizes)
        .withColumn("reach", F.max(F.when(F.col("sel") == 0, F.col("last"))).over(before))
        .where((F.col("sel") == 1) & (F.col("reach") >= F.col("node")))
        .where((F.col("href") != "") & ~starts_with_any(F.col("href"), DEAD_PREFIXES))
    )
    return (
        inside.groupBy(*keys, "href")
        .agg(F.min(F.struct(F.col("node").alias("pos"), "text")).alias("first"))
        .select(*keys, "first.pos", "href", "first.text")
    )


def _page_links(scopes: DataFrame, docs: DataFrame, label_length: int | None) -> DataFrame:
    rows = all_links(with_pages(keep(scopes.select("page_id").distinct()), docs), label_length)
    return scopes.select("page_id", "url").join(rows, "page_id")


def source_links(scopes: DataFrame, docs: DataFrame, label_length: int | None = None) -> DataFrame:
    """Item links of each page, or all links of the page where there are none."""
    both = (
        item_links(scopes, docs, label_length)
        .withColumn("source", F.lit(0))
        .unionByName(_page_links(scopes, docs, label_length).withColumn("source", F.lit(1)))
    )
    best = F.min("source").over(Window.partitionBy("page_id", "url"))
    return both.withColumn("best", best).where(F.col("source") == F.col("best")).drop("best", "source")


def link_labels(links: DataFrame) -> DataFrame:
    """First non-empty anchor text of each absolute URL, over all links, valid or not."""
    texts = links.select(
        "page_id", "url", resolved("url", "href").alias("link_url"), "pos", strip(F.col("text")).alias("label")
    ).where((F.col("href") != "") & (F.col("label") != ""))
    return texts.groupBy("page_id", "url", "link_url").agg(F.min_by("label", "pos").alias("label"))


def rank_links(links: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Pool of links to follow: ``page_id, url, position, link_url, score, label``.

    Links below the page's own path come first, then page order. ``visited`` (``page_id,
    link_url``) is left out by exact spelling. ``position`` counts from 0.
    """
    target = links.withColumn("link_url", resolved("url", "href"))
    valid = is_valid_drill_link(F.col("href"), F.col("url"), F.col("link_url"))
    text = strip(F.col("text"))
    # one aggregation gives both the position of a link and the label of its URL
    pool = (
        target.groupBy("page_id", "url", "link_url")
        .agg(
            F.min(F.when(valid, F.col("pos"))).alias("pos"),
            F.min(F.when(text != "", F.struct("pos", text.alias("label"))))["label"].alias("label"),
        )
        .where(F.col("pos").isNotNull())
        .withColumn("score", score_drill_link(F.col("url"), F.col("link_url")))
    )
    if visited is not None:
        pool = pool.join(visited.select("page_id", "link_url"), ["page_id", "link_url"], "left_anti")
    order = Window.partitionBy("page_id", "url").orderBy(F.col("score").desc(), "pos")
    return pool.withColumn("position", F.row_number().over(order) - 1).select(
        "page_id", "url", "position", "link_url", "score", "label"
    )


def link_pool(
    scopes: DataFrame, docs: DataFrame, visited: DataFrame | None = None, label_length: int | None = None
) -> DataFrame:
    return rank_links(source_links(scopes, docs, label_length), visited)


def top_candidates(pool: DataFrame, limit: int | None = None) -> DataFrame:
    """Links of each pool, or the first ``limit``, with a readable label and the score as confidence."""
    return (pool if limit is None else pool.where(F.col("position") < limit)).select(
        "page_id",
        "url",
        F.col("position").alias("rank"),
        F.col("link_url"),
        F.coalesce("label", url_label(F.col("link_url"))).alias("label"),
        F.lit("").alias("reason"),
        F.col("score").alias("confidence"),
    )


def resolve_candidates(responses: DataFrame, pool: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates named by index in a response, as URLs; the top of the pool where none is usable.

    ``responses`` holds ``page_id`` and ``ranked_candidates`` (``link_index, label, reason,
    confidence`` as strings).
    """
    listed = responses.select("page_id", F.posexplode("ranked_candidates").alias("rank", "c")).select(
        "page_id", "rank", F.col("c.link_index").try_cast("int").alias("position"), "c.label", "c.reason", "c.confidence"
    )
    named = (
        listed.join(pool.withColumnRenamed("label", "anchor"), ["page_id", "position"])
        .select(
            "page_id",
            "url",
            "rank",
            "link_url",
            F.coalesce(blank_to_null(F.col("label")), F.col("anchor"), url_label(F.col("link_url"))).alias("label"),
            F.coalesce("reason", F.lit("")).alias("reason"),
            F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
            F.lit(0).alias("source"),
        )
    )
    asked = responses.select("page_id").distinct()
    rest = top_candidates(pool, limit).join(asked, "page_id", "left_semi").withColumn("source", F.lit(1))
    best = F.min("source").over(Window.partitionBy("page_id"))
    return named.unionByName(rest).withColumn("best", best).where(F.col("source") == F.col("best")).drop("best", "source")


def choose_links(answers: DataFrame, pool: DataFrame) -> DataFrame:
    """Link each answer leads to: the chosen URL, the chosen index, the recommendation, the first.

    ``answers`` holds ``page_id, selected_url, link_index, recommended_url``; a choice counts only
    if it is in the pool.
    """
    at = lambda test: F.max(F.when(test, F.col("link_url")))
    picked = (
        answers.join(pool.select("page_id", "position", "link_url"), "page_id", "left")
        .groupBy(*answers.columns)
        .agg(
            at(F.col("link_url") == F.col("selected_url")).alias("a"),
            at(F.col("position") == F.col("link_index").try_cast("int")).alias("b"),
            at(F.col("link_url") == F.col("recommended_url")).alias("c"),
            at(F.col("position") == 0).alias("d"),
        )
    )
    return picked.select(*answers.columns, F.coalesce("a", "b", "c", "d").alias("next_url"))


def guard_frontier(frontier: DataFrame, visited: DataFrame, max_depth: int = 10) -> DataFrame:
    """Frontier rows with ``proceed``: not too deep and not visited before (exact spelling).

    ``frontier`` holds ``root_url, current_url, current_level``; ``visited`` ``root_url, url``.
    """
    seen = visited.select("root_url", F.col("url").alias("current_url"), F.lit(True).alias("seen")).distinct()
    return (
        frontier.join(seen, ["root_url", "current_url"], "left")
        .withColumn("proceed", (F.col("current_level") <= max_depth) & F.col("seen").isNull())
        .drop("seen")
    )
