"""Items, field values and drill links of pages, for the levels of many plans at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.selectors import compile_selectors
from siteloom.functions.text import blank_to_null, collapse, cut
from siteloom.functions.urls import DEAD_PREFIXES_IN_ITEM, resolved, starts_with_any
from siteloom.operators.parse import text_of
from siteloom.operators.select import DOCUMENT, candidates, first_below, settle, steps_sizes
from siteloom.operators.skew import parts_of, spread_join, tasks_for, with_pages
from siteloom.session import keep, per_session
from siteloom.sources.pages import lookup

# Numbers of the selectors of a level: 0 items, -1 drill link, -2 any link; the p-th field has its
# container at 2p+1 and its own selector at 2p+2.
_ITEM, _DRILL, _ANY_LINK = 0, -1, -2

# Item selector that stands for the page as one item.
WHOLE_PAGE = ":document"

# Tasks on one page that are handled together; a page asked for by more is split.
_TASKS_PER_PART = 256


def _last_of_name(fields: Column) -> Column:
    """A name defined twice on a level keeps its place and holds its last definition."""
    names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
    return F.transform(names, lambda name: F.element_at(F.filter(fields, lambda f: f["name"].eqNullSafe(name)), -1))


def compile_levels(levels: DataFrame) -> DataFrame:
    """Level plans with their selectors as steps: one row per plan and level."""
    # a field without a name is kept, under the empty name
    named = F.transform("fields", lambda f: f.withField("name", F.coalesce(f["name"], F.lit(""))))
    fields = levels.withColumn("fields", _last_of_name(named))
    entry = lambda sel, selector, attribute: F.struct(
        F.lit(sel).cast("int").alias("sel") if isinstance(sel, int) else sel.cast("int").alias("sel"),
        selector.alias("selector"),
        attribute.alias("attribute"),
    )
    nothing = F.lit(None).cast("string")
    listed = F.concat(
        F.array(
            entry(_ITEM, F.col("item_container_selector"), nothing),
            entry(_DRILL, F.col("drill_down_link_selector"), nothing),
            entry(_ANY_LINK, F.lit("a[href]"), nothing),
        ),
        F.transform("fields", lambda f, p: entry(p * 2 + 1, f["container_selector"], nothing)),
        F.transform(
            "fields",
            lambda f, p: entry(
                p * 2 + 2, f["selector"], F.coalesce(blank_to_null(f["attribute"]), F.lit("text"))
            ),
        ),
    )
    unused = F.col("is_final_level") & F.col("sel").isin(_DRILL, _ANY_LINK)
    whole = F.col("selector") == WHOLE_PAGE
    steps = compile_selectors(
        fields.select("plan_id", "level", "is_final_level", F.inline(listed))
        .where((F.col("selector") != "") & ~unused)
        .withColumn("css", F.when(whole, "html").otherwise(F.col("selector"))),
        "css",
    ).select(
        "plan_id",
        "level",
        F.transform(
            "steps",
            lambda s: s.withField("sel", F.col("sel"))
            .withField("attribute", F.col("attribute"))
            .withField("tag", F.when(whole, DOCUMENT).otherwise(s["tag"]))
            .withField("tests", F.when(whole, F.slice(s["tests"], 1, 0)).otherwise(s["tests"])),
        ).alias("steps"),
    )
    grouped = steps.groupBy("plan_id", "level").agg(F.flatten(F.collect_list("steps")).alias("steps"))
    own = F.filter(
        F.transform("fields", lambda f, p: F.when(F.coalesce(f["container_selector"], F.lit("")) == "", p * 2 + 2)),
        lambda sel: sel.isNotNull(),
    ).cast("array<int>")
    return fields.select(
        "plan_id",
        "level",
        "sample_url",
        "is_final_level",
        F.transform("fields", lambda f: f["name"]).alias("names"),
        F.when(F.col("is_final_level"), own)
        .otherwise(F.concat(own, F.array(F.lit(_DRILL), F.lit(_ANY_LINK))))
        .alias("scopes"),
    ).join(grouped.hint("merge"), ["plan_id", "level"])


def split_tasks(tasks: DataFrame) -> DataFrame:
    """Adds ``part``: tasks that share one page in great number are spread over several parts."""
    return parts_of(tasks, "page_id", _TASKS_PER_PART, ["plan_id", "url"])


def with_levels(tasks: DataFrame, compiled: DataFrame) -> DataFrame:
    """Tasks with the compiled level that each is about. Steps are long, and there are as many levels as plans: they are not broadcast."""
    return spread_join(tasks, compiled, "plan_id", shuffled=True)


def extract_items(tasks: DataFrame, docs: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """Items of each task's page: ``plan_id, url, page_id, item, fields, drill_url``.

    ``tasks`` are compiled levels joined to pages (``plan_id, url, page_id, names, scopes,
    is_final_level, steps, part``). A field with a container takes its value from the first container on
    the whole page, so all items share it; any other field is sought inside the item.
    """
    place = ["page_id", "part"]
    keys = [*place, "plan_id", "url"]
    asked = keep(tasks.select(*place).distinct())
    n = asked.count()
    spread = [tasks_for(n, tasks.sparkSession), *place]
    pages = with_pages(asked, docs.select("page_id", "elems", "texts"), n)
    # from this join on, all steps keep the rows of a page (or part of its tasks) where they are
    found = candidates(
        tasks.repartition(*spread).join(pages.select(*place, "elems", "texts").repartition(*spread), place),
        keys,
        lambda e, s: {
            "t0": e["t0"],
            "t1": e["t1"],
            "tag": e["tag"],
            "is_text": s["attribute"] == "text",
            "value": F.when(s["attribute"] != "text", F.try_element_at(e["attrs"], s["attribute"])),
            "href": F.when(s["sel"] <= 0, F.try_element_at(e["attrs"], F.lit("href"))),
            "scopes": F.when(s["sel"] == _ITEM, F.col("scopes")),
            "names": F.when(s["sel"] == _ITEM, F.col("names")),
            "drills": F.when(s["sel"] == _ITEM, ~F.col("is_final_level")),
        },
        sizes[2],
    )
    settled = settle(found, keys, *sizes)
    rows = settled.select(*[c for c in settled.columns if c not in ("sel", "scopes")], F.inline_outer(_roles()))
    hit = F.struct("node", "t0", "t1", "tag", "is_text", "value", "href")
    one_selector = Window.partitionBy(*keys, "sel")
    refs = (
        rows.withColumn("hit", first_below(rows, [*keys, "sel"], F.col("kind") == "match", hit))
        .withColumn("first_container", F.min(F.when(F.col("item") == -1, F.col("node"))).over(one_selector))
        .where((F.col("kind") != "match") & ((F.col("item") != -1) | (F.col("node") == F.col("first_container"))))
        .select(
            *keys, "item", "sel", "hit", "kind", "names", "drills",
            F.when(F.col("tag") == "a", F.col("href")).alias("own_href"),
        )
    )
    # the text of the chosen elements is a slice of the page's strings; they meet once per page
    chosen = refs.groupBy(*place).agg(
        F.collect_list(F.struct("plan_id", "url", "item", "sel", "hit", "kind", "names", "drills", "own_href")).alias("refs")
    )
    valued = (
        chosen.join(pages.select(*place, "texts").repartition(*spread), place)
        .withColumn("_read", _values())
        .select(*place, F.inline_outer("_read"))
    )
    page_wide = F.collect_list(F.when(F.col("item") == -1, F.col("entry"))).over(Window.partitionBy(*keys))
    of_kind = lambda kind, name: F.max(F.when(F.col("sel") == kind, F.col(name)))
    items = (
        valued.withColumn("page_wide", page_wide)
        .where("item >= 0")
        .groupBy(*keys, "item")
        .agg(
            F.collect_list(F.when(F.col("sel") > 0, F.col("entry"))).alias("own"),
            F.first("page_wide").alias("page_wide"),
            F.first("names", ignorenulls=True).alias("names"),
            F.bool_or("drills").alias("drills"),
            of_kind(_ITEM, "own_href").alias("own_href"),
            of_kind(_DRILL, "href").alias("drill_href"),
            of_kind(_ANY_LINK, "href").alias("any_href"),
        )
    )
    return (
        items.withColumn("href", F.when(F.col("drills"), _drill_href()))
        .withColumn("drill_url", resolved("url", "href"))
        .select("plan_id", "url", "page_id", "item", _fields().alias("fields"), "drill_url")
    )


@per_session
def _roles() -> Column:
    """What a matched element does: it is an item, opens scopes for fields, or is sought in them."""
    sel = F.col("sel")
    role = lambda kind, number, item: F.struct(
        F.lit(kind).alias("kind"), number.cast("int").alias("sel"), item.cast("int").alias("item")
    )
    return (
        F.when(
            sel == _ITEM,
            F.concat(
                F.array(role("item", sel, F.col("node"))),
                F.transform("scopes", lambda s: role("scope", s, F.col("node"))),
            ),
        )
        .when((sel > 0) & (sel % 2 == 1), F.array(role("scope", sel + 1, F.lit(-1))))
        .otherwise(F.array(role("match", sel, F.lit(None))))
    )


@per_session
def _values() -> Column:
    """The page's chosen elements with their values."""
    value = lambda r: F.when(r["hit"]["is_text"], collapse(text_of(F.col("texts"), r["hit"]))).otherwise(r["hit"]["value"])
    read = lambda r: F.struct(
        *[r[name].alias(name) for name in ("plan_id", "url", "item", "sel", "kind", "names", "drills", "own_href")],
        r["hit"]["href"].alias("href"),
        F.struct(((r["sel"] - 2) / 2).cast("int").alias("p"), value(r).alias("v")).alias("entry"),
    )
    return F.transform("refs", read)


@per_session
def _drill_href() -> Column:
    """Link of an item: its own, that of the drill selector, or the first one in it."""
    usable = lambda href: F.when((href != "") & ~starts_with_any(href, DEAD_PREFIXES_IN_ITEM), href)
    return F.coalesce(usable(F.col("own_href")), blank_to_null(F.col("drill_href")), usable(F.col("any_href")))


@per_session
def _fields() -> Column:
    """All fields of an item in order; an empty ``url`` field takes the drill link."""
    at = lambda p: F.get(F.filter(F.concat("own", "page_wide"), lambda x: x["p"] == p), F.lit(0))["v"]
    value = lambda name, p: F.coalesce(at(p), F.when(name == "url", F.col("drill_url")))
    return F.map_from_arrays("names", F.transform("names", value))


def sample_values(levels: DataFrame, docs: DataFrame, index: DataFrame, length: int | None = None) -> DataFrame:
    """A value for each field of a level, from its own page: ``plan_id, level, name, sample_value``.

    On a catalog page the first item is looked at, on any other page (or where no item is found)
    the whole page.
    """
    keyed = levels.withColumn("is_final_level", F.lit(True))
    by_item = keyed.where(F.col("is_catalog") & (F.col("item_container_selector") != ""))
    first = keep(_first_items(by_item, docs, index))
    rest = keyed.join(first.select("plan_id", "level").distinct(), ["plan_id", "level"], "left_anti")
    whole = _first_items(rest.withColumn("item_container_selector", F.lit(WHOLE_PAGE)), docs, index)
    return (
        first.unionByName(whole)
        .select("plan_id", "level", F.explode("fields").alias("name", "value"))
        .where(F.col("value").isNotNull())
        .select("plan_id", "level", "name", cut(F.col("value"), length).alias("sample_value"))
    )


def _first_items(levels: DataFrame, docs: DataFrame, index: DataFrame) -> DataFrame:
    # a level has one page, so (plan, level) takes the place of the plan
    both = F.to_json(F.struct("plan_id", "level"))
    keyed = levels.withColumn("plan_id", both).withColumn("drill_down_link_selector", F.lit(None).cast("string"))
    compiled = keep(compile_levels(keyed))
    pages = split_tasks(lookup(compiled.select("plan_id", F.col("sample_url").alias("url")).where("url != ''"), index))
    tasks = with_levels(pages, compiled.drop("level", "sample_url"))
    items = extract_items(tasks, docs, steps_sizes(compiled))
    first = items.groupBy("plan_id").agg(F.min_by("fields", "item").alias("fields"))
    kinds = levels.select("plan_id", "level").schema
    key = F.from_json(F.col("plan_id"), kinds)
    return first.select(key["plan_id"].alias("plan_id"), key["level"].alias("level"), "fields")
