"""Hierarchical scrape: levels are followed for all plans at once, one set of joins per level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.extract import compile_levels, extract_items, split_tasks, with_levels
from siteloom.operators.select import steps_sizes
from siteloom.operators.skew import salted_join, with_pages
from siteloom.session import keep
from siteloom.sources.pages import lookup, missing, page_index

_RANK_BUCKETS = 64
# What tells that a page need not be read again for a plan: the same page, contents and level definition.
_SAME = ["plan_id", "url", "page_id", "digest", "definition"]


@dataclass
class Scrape:
    """``rows`` as ``plan_id, order_key, level, fields`` and the pages that were not found.

    ``items`` is what each page gave to each level of each plan, if that was asked for; the next run takes it as ``known``.
    """

    rows: DataFrame
    missing: DataFrame
    items: DataFrame | None = None


def override(parent: Column, child: Column) -> Column:
    """Parent values with those of the child on top; a child's null counts as a value.

    Names keep the place where they first appeared.
    """
    replaced = F.transform_values(
        parent, lambda k, v: F.when(F.map_contains_key(child, k), F.try_element_at(child, k)).otherwise(v)
    )
    return F.map_concat(replaced, F.map_filter(child, lambda k, v: ~F.map_contains_key(parent, k)))


def page_of(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def _join_children(parents: DataFrame, items: DataFrame, is_open: Column) -> DataFrame:
    """Open rows joined to the items of the page they lead to; closed rows pass unchanged."""
    left = parents.withColumn("is_open", is_open).withColumn(
        "url", F.when(F.col("is_open"), page_of(F.col("drill_url"))).otherwise("")
    )
    right = items.select(
        "plan_id",
        "url",
        F.col("item").alias("child_item"),
        F.col("fields").alias("child_fields"),
        F.col("drill_url").alias("child_drill"),
    )
    return salted_join(left, right, ["plan_id", "url"], "left", idle=~F.col("is_open"))


def scrape(
    levels: DataFrame,
    docs: DataFrame,
    target_level: int | None = None,
    max_items: int | None = None,
    index: DataFrame | None = None,
    digests: DataFrame | None = None,
    known: DataFrame | None = None,
) -> Scrape:
    """All rows of all plans.

    ``levels`` are level plans (``plan_id, level, sample_url, item_container_selector,
    is_final_level, drill_down_link_selector, fields``) and ``docs`` parsed pages, best read from a
    saved table. Each plan goes down to its deepest level or to ``target_level``. An item without a
    drill link above that level gives a partial row; a missing page gives nothing. ``max_items``
    keeps the first items of each page. Rows come unordered; sort by ``plan_id, order_key`` for
    depth-first order.

    To run again over pages that change, pass ``digests`` (``page_id, digest``, for example of the HTML), save the ``items``
    of the result, and pass them as ``known`` the next time. Then only pages that are new, have another digest or are read by a
    changed level are looked at (others need not be in ``docs``), and the rows are those of a scrape from the start.
    """
    result, _ = _scrape(levels, docs, target_level, max_items, index, None, digests, known, digests is not None)
    return result


def _scrape(levels, docs, target_level, max_items, index, first, digests, known, track) -> tuple[Scrape, DataFrame]:
    definition = F.md5(F.to_json(F.struct("names", "scopes", "is_final_level", "steps")))
    compiled = keep(compile_levels(levels).withColumn("definition", definition))
    sizes = steps_sizes(compiled)
    index = keep(page_index(docs)) if index is None else index
    goal = levels.groupBy("plan_id").agg(F.max("level").alias("goal"))
    if target_level is not None:
        goal = goal.select("plan_id", F.least("goal", F.lit(target_level)).alias("goal"))
    deepest = goal.agg(F.max("goal")).first()[0] or 0
    listed = []

    def read(tasks: DataFrame, level: int, pages: DataFrame) -> DataFrame:
        plan = compiled.where(F.col("level") == level).drop("level", "sample_url", "definition")
        return extract_items(with_levels(keep(split_tasks(tasks)), plan), pages, sizes)

    def remembered(tasks: DataFrame, level: int) -> DataFrame:
        """Items of tasks, those known and those of the pages that must be read."""
        tasks = with_levels(tasks, compiled.where(F.col("level") == level).select("plan_id", "definition"))
        if digests is None:
            tasks = tasks.withColumn("digest", F.lit(""))
        else:
            tasks = salted_join(keep(tasks), digests.select("page_id", "digest"), ["page_id"], "left")
        tasks = keep(tasks)
        old = None if known is None else known.where(F.col("level") == level).drop("level")
        fresh = tasks if old is None else keep(tasks.join(old.select(*_SAME).distinct(), _SAME, "left_anti"))
        made = read(fresh.drop("digest", "definition"), level, _pages_of(fresh, docs))
        # a page without items is known as well
        items = keep(fresh.join(made, ["plan_id", "url", "page_id"], "left").select(*_SAME, "item", "fields", "drill_url"))
        if old is not None:
            items = items.unionByName(tasks.join(old, _SAME).select(*items.columns))
        listed.append(items.withColumn("level", F.lit(level)))
        return items.where("item is not null").drop("digest", "definition")

    def items_of(frontier: DataFrame, level: int) -> DataFrame:
        tasks = lookup(frontier, index)
        items = remembered(tasks, level) if track or known is not None else read(tasks, level, docs)
        if max_items is not None:
            order = Window.partitionBy("plan_id", "url").orderBy("item")
            items = items.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_items).drop("n")
        return items

    frontier = levels.where((F.col("level") == 1) & (F.col("sample_url") != "")).select(
        "plan_id", page_of(F.col("sample_url")).alias("url")
    )
    errors = [missing(frontier, index).withColumn("level", F.lit(1))]
    rows = (
        items_of(frontier, 1)
        .join(goal, "plan_id")
        .select("plan_id", F.array("item").alias("order_key"), F.lit(1).alias("level"), "goal", "fields", "drill_url")
    )
    cuts = []
    for level in range(2, deepest + 1):
        if first is not None:
            rows, cut = _prefix(rows, first)
            cuts.append(cut)
        rows = keep(rows)
        is_open = (F.col("level") == level - 1) & (F.col("goal") >= level) & F.col("drill_url").isNotNull()
        frontier = rows.where(is_open).select("plan_id", page_of(F.col("drill_url")).alias("url")).distinct()
        if frontier.isEmpty():
            break
        errors.append(missing(frontier, index).withColumn("level", F.lit(level)))
        joined = _join_children(rows, items_of(frontier, level), is_open)
        found = F.col("is_open") & F.col("child_item").isNotNull()
        rows = joined.where(~F.col("is_open") | found).select(
            "plan_id",
            F.when(found, F.concat("order_key", F.array("child_item"))).otherwise(F.col("order_key")).alias("order_key"),
            F.when(found, level).otherwise(F.col("level")).alias("level"),
            "goal",
            F.when(found, override(F.col("fields"), F.col("child_fields"))).otherwise(F.col("fields")).alias("fields"),
            F.when(found, F.col("child_drill")).otherwise(F.col("drill_url")).alias("drill_url"),
        )
    ended = (F.col("level") == F.col("goal")) | F.col("drill_url").isNull()
    out = rows.where(ended).select("plan_id", "order_key", "level", "fields")
    lost = errors[0]
    for more in errors[1:]:
        lost = lost.unionByName(more)
    dropped = None
    for cut in cuts:
        dropped = cut if dropped is None else dropped.unionByName(cut)
    items = None
    for part in listed:
        items = part if items is None else items.unionByName(part)
    return Scrape(out, lost.select("plan_id", "level", "url", "error"), items), dropped


def _pages_of(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that tasks are about. Up to a number of pages their list goes to the readers, else it is joined."""
    return with_pages(keep(tasks.select("page_id").distinct()), docs)


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each plan in depth-first order, numbered from 1 in ``row``.

    The rows of a plan are first cut in buckets, so that a very long plan is not sorted by one task.
    """
    order = Window.partitionBy("plan_id").orderBy("order_key")
    bucket = Window.partitionBy("plan_id", "bucket").orderBy("order_key")
    spread = F.pmod(F.xxhash64("order_key"), F.lit(_RANK_BUCKETS))
    rows = rows.withColumn("bucket", spread).withColumn("row", F.row_number().over(bucket))
    rows = rows.where(F.col("row") <= limit).drop("bucket", "row")
    return rows.withColumn("row", F.row_number().over(order)).where(F.col("row") <= limit)


def _prefix(rows: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of each plan, and the key of the first row left out."""
    ranked = keep(_ranked(rows, first + 1))
    cut = ranked.where(F.col("row") == first + 1).select("plan_id", F.col("order_key").alias("cut"))
    return ranked.where(F.col("row") <= first).drop("row"), cut


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each plan in depth-first order."""
    return _ranked(rows, limit)


def sample(
    levels: DataFrame,
    docs: DataFrame,
    max_rows: int = 3,
    target_level: int | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """First ``max_rows`` rows of each plan: ``plan_id, row, order_key, level, fields``.

    Only the first items of each level are followed. Rows that come before everything left out are
    final; a plan that has too few of those goes on with four times as many, from the items of the pages it has read, so no page
    is read twice by one sample.
    """
    pending, breadth, parts = levels, max_rows, []
    index = keep(page_index(docs)) if index is None else index
    known = None
    while True:
        result, cuts = _scrape(pending, docs, target_level, None, index, breadth, None, known, True)
        known = result.items
        rows = keep(result.rows)
        if cuts is None:
            parts.append(first_rows(rows, max_rows))
            break
        cut = cuts.groupBy("plan_id").agg(F.min("cut").alias("cut"))
        sure = rows.join(cut, "plan_id", "left").where(F.col("cut").isNull() | (F.col("order_key") < F.col("cut")))
        parts.append(keep(first_rows(sure.drop("cut"), max_rows)))
        full = parts[-1].groupBy("plan_id").count().where(F.col("count") >= max_rows)
        short = keep(cut.join(full, "plan_id", "left_anti").select("plan_id"))
        if max_rows == 0 or short.isEmpty():
            break
        parts[-1] = parts[-1].join(short, "plan_id", "left_anti")
        pending = pending.join(short, "plan_id", "left_semi")
        breadth *= 4
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("plan_id", "row", "order_key", "level", "fields")
