"""Discovery in rounds: every open site moves one level per round.

A round looks up the current page of each open site, joins the answers of the model (schema and
nesting, as tables), and ends in a decision per site. Answers to the decisions give the next state.
A person or a model may answer between two rounds, so each round is its own job on a state table
(``root_url, current_url, current_level, visited, done, chain``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.urls import normalize_url, plan_id, url_label
from siteloom.operators.extract import sample_values
from siteloom.operators.frontier import link_pool
from siteloom.operators.skew import salted_join
from siteloom.plans.model import FIELD, LEVEL, NESTING, make_level, named_fields
from siteloom.session import keep
from siteloom.sources.pages import lookup

SCHEMA = (
    "struct<is_catalog:boolean,catalog_type:string,confidence:double,archetype:string,"
    f"item_schema:struct<item_name:string,item_container_selector:string,fields:array<{FIELD}>>,reasoning:string>"
)
# Decisions and the answers they take; the first one is the default.
OPTIONS = {
    "confirm_drilling": ["continue", "final"],
    "confirm_final_level": ["confirm", "drill"],
    "select_link": ["final", "drill"],
}
DEFAULT_ANSWERS = {"confirm_drilling": "continue", "confirm_final_level": "confirm", "select_link": "final"}
PROMPTS = {
    "confirm_drilling": "The links lead to a deeper level. Go on?",
    "confirm_final_level": "This looks like the last level. Finish here, or go deeper?",
    "select_link": "Is this the last level, or shall a link be followed?",
}
_LINKS = "array<struct<link_url:string,label:string,score:double>>"
_CANDIDATES = "array<struct<link_url:string,label:string,reason:string,confidence:double>>"


def start(roots: DataFrame) -> DataFrame:
    """First state of each distinct ``root_url``."""
    return roots.select("root_url").distinct().select(
        "root_url",
        F.col("root_url").alias("current_url"),
        F.lit(1).alias("current_level"),
        F.array().cast("array<string>").alias("visited"),
        F.lit(False).alias("done"),
        F.array().cast(f"array<{LEVEL}>").alias("chain"),
    )


def _latest(answers: DataFrame, body: str) -> DataFrame:
    """One answer per page: the one with the largest ``seq``, or without such a column the first in JSON order."""
    order = F.struct("seq", F.to_json("body")) if "seq" in answers.columns else F.to_json("body")
    return answers.where(F.col("body").isNotNull()).groupBy("url_key").agg(F.max_by("body", order).alias(body))


def observe(
    state: DataFrame, docs: DataFrame, index: DataFrame, schemas: DataFrame, nestings: DataFrame, max_depth: int = 10
) -> DataFrame:
    """Open sites with all that their decision depends on.

    ``schemas`` holds ``url_key, kind (list | detail), body`` and ``nestings`` ``url_key, body``, one
    row per key. Every round reads them, so they should be saved tables. New columns: ``stop`` (too deep, visited before, or no page), ``schema``, ``detail``,
    ``nesting`` and ``links`` (unvisited, best first).
    """
    open_ = state.where(~F.col("done"))
    barred = (F.col("current_level") > max_depth) | F.array_contains("visited", F.col("current_url"))
    rows = open_.withColumn("barred", barred).withColumn(
        "visited", F.when(barred, F.col("visited")).otherwise(F.array_append("visited", F.col("current_url")))
    )
    keyed = rows.withColumn("url_key", normalize_url(F.col("current_url")))
    placed = (
        salted_join(keyed, index.select("url_key", "page_id"), ["url_key"], "left")
        .join(_latest(schemas.where(F.col("kind") == "list"), "schema"), "url_key", "left")
        .join(_latest(schemas.where(F.col("kind") == "detail"), "detail"), "url_key", "left")
        .join(_latest(nestings, "nesting"), "url_key", "left")
    )
    placed = keep(
        placed.withColumn("stop", F.col("barred") | F.col("page_id").isNull() | F.col("schema").isNull()).drop("barred")
    )
    # sites that stand on the same page share its links
    scopes = (
        placed.where(~F.col("stop") & F.coalesce(F.col("schema.is_catalog"), F.lit(False)))
        .groupBy("page_id", F.col("current_url").alias("url"))
        .agg(F.first("schema.item_schema.item_container_selector").alias("item_container_selector"))
    )
    pool = link_pool(scopes, docs).groupBy("page_id", F.col("url").alias("current_url")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "link_url", "label", "score"))),
            lambda x: x.dropFields("position"),
        ).cast(_LINKS).alias("pool")
    )
    fresh = F.filter("pool", lambda x: ~F.array_contains("visited", x["link_url"]))
    return (
        placed.join(pool, ["page_id", "current_url"], "left")
        .withColumn("links", F.coalesce(fresh, F.array().cast(_LINKS)))
        .drop("pool", "url_key")
    )


def _ranked(limit: int | None) -> Column:
    shown = lambda x: F.coalesce(x["label"], url_label(x["link_url"]))
    named = F.filter(
        F.transform(
            "nesting.ranked_candidates",
            lambda c: F.struct(
                F.get("links", F.when(c["link_index"].try_cast("int") >= 0, c["link_index"].try_cast("int"))).alias("x"),
                c.alias("c"),
            ),
        ),
        lambda p: p["x"].isNotNull(),
    )
    from_response = F.transform(
        named,
        lambda p: F.struct(
            p["x"]["link_url"].alias("link_url"),
            F.coalesce(F.when(p["c"]["label"] != "", p["c"]["label"]), shown(p["x"])).alias("label"),
            F.coalesce(p["c"]["reason"], F.lit("")).alias("reason"),
            F.coalesce(p["c"]["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
        ),
    ).cast(_CANDIDATES)
    from_pool = F.transform(
        "links" if limit is None else F.slice("links", 1, limit),
        lambda x: F.struct(
            x["link_url"].alias("link_url"), shown(x).alias("label"), F.lit("").alias("reason"), x["score"].alias("confidence")
        ),
    ).cast(_CANDIDATES)
    return F.when(F.size(from_response) > 0, from_response).otherwise(from_pool)


def decide(
    observed: DataFrame, mode: str = "auto", candidates: int | None = None, manual_links: int | None = None, final_links: int | None = None
) -> DataFrame:
    """Adds ``outcome`` (finish, add_level, ask), ``decision`` and its context columns.

    A decision shows all links and candidates, or as many as the caller wants.
    """
    is_catalog = F.coalesce(F.col("schema.is_catalog"), F.lit(False))
    outcome = (
        F.when(F.col("stop"), "finish").when(~is_catalog | (F.size("links") == 0), "add_level").otherwise("ask")
    )
    final = F.coalesce(F.col("nesting.is_final_level"), F.lit(True))
    manual = F.lit(mode == "manual")
    decision = F.when(
        outcome == "ask",
        F.when(manual, "select_link").when(final, "confirm_final_level").otherwise("confirm_drilling"),
    )
    rows = (
        observed.withColumn("outcome", outcome)
        .withColumn("decision", decision)
        # a detail page is described by the answer for detail pages
        .withColumn("schema", F.when(~is_catalog, F.coalesce("detail", "schema")).otherwise(F.col("schema")))
        .withColumn("ranked_candidates", F.when(F.col("decision").isNotNull(), _ranked(candidates)))
    )
    options = F.col("decision")
    lists = F.when(options == "confirm_drilling", F.array(*map(F.lit, OPTIONS["confirm_drilling"])))
    for name in ("confirm_final_level", "select_link"):
        lists = lists.when(options == name, F.array(*map(F.lit, OPTIONS[name])))
    prompt = F.when(options == "confirm_drilling", PROMPTS["confirm_drilling"])
    for name in ("confirm_final_level", "select_link"):
        prompt = prompt.when(options == name, PROMPTS[name])
    urls = lambda n: F.transform("links" if n is None else F.slice("links", 1, n), lambda x: x["link_url"])
    return rows.withColumns(
        {
            "step": F.when(manual, "discovery").otherwise("nesting_analysis"),
            "prompt": prompt,
            "options": lists,
            "recommended_url": F.when(options == "confirm_drilling", F.get("ranked_candidates", F.lit(0))["link_url"]),
            "reasoning": F.col("nesting.reasoning"),
            "available_links": F.when(options == "select_link", urls(manual_links)).when(
                options == "confirm_final_level", urls(final_links)
            ),
        }
    )


def _level(schema: Column) -> Column:
    body = schema["item_schema"]
    return make_level(
        level=F.col("current_level"),
        url=F.col("current_url"),
        is_catalog=F.coalesce(schema["is_catalog"], F.lit(False)),
        catalog_type=schema["catalog_type"],
        confidence=F.coalesce(schema["confidence"], F.lit(0.0)),
        archetype=schema["archetype"],
        item_name=body["item_name"],
        item_container_selector=body["item_container_selector"],
        fields=named_fields(body["fields"]),
        reasoning=F.coalesce(schema["reasoning"], F.lit("")),
        nesting_analysis=F.when(F.col("outcome") == "ask", F.col("nesting")),
    )


def apply_answers(decided: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Next state of each site.

    ``answers`` holds ``root_url, choice, selected_url, link_index``; a site without an answer takes
    the default choice of its decision. A choice that the decision does not know, or a wish to go
    deeper without a link to follow, leaves the site where it is, so it is asked again.
    """
    if answers is None:
        rows = decided.withColumns(
            {name: F.lit(None).cast("string") for name in ("choice", "selected_url", "link_index")}
        )
    else:
        answer = F.struct("choice", "selected_url", F.col("link_index").cast("string").alias("link_index"))
        order = F.struct("seq", answer) if "seq" in answers.columns else answer
        given = answers.groupBy("root_url").agg(F.max_by(answer, order).alias("_given")).select("root_url", "_given.*")
        rows = decided.join(given, "root_url", "left")
    default = F.when(F.col("decision") == "confirm_drilling", DEFAULT_ANSWERS["confirm_drilling"])
    for name in ("confirm_final_level", "select_link"):
        default = default.when(F.col("decision") == name, DEFAULT_ANSWERS[name])
    urls = F.transform("links", lambda x: x["link_url"])
    listed = lambda u: F.when(F.array_contains(urls, u), u)
    number = F.col("link_index").try_cast("int")
    next_url = F.coalesce(
        listed(F.col("selected_url")),
        F.get(urls, F.when(number >= 0, number)),
        listed(F.col("recommended_url")),
        F.get(urls, F.lit(0)),
    )
    decision, choice = F.col("decision"), F.col("choice")
    drilling = decision == "confirm_drilling"
    known = choice.isin("continue", "final", "stop")
    ends = (drilling & choice.isin("final", "stop")) | ((decision == "confirm_final_level") & (choice == "confirm")) | (
        (decision == "select_link") & (choice == "final")
    )
    deeper = ((drilling & known & ~choice.isin("final", "stop")) | (~drilling & (choice == "drill"))) & F.col(
        "next_url"
    ).isNotNull()
    no_fields = F.coalesce(F.size("schema.item_schema.fields"), F.lit(0)) <= 0
    asks_detail = (drilling & (choice == "final")) | ((decision == "confirm_final_level") & no_fields) | (
        decision == "select_link"
    )
    used = F.when(
        (F.col("outcome") == "ask") & F.col("ends") & asks_detail, F.coalesce("detail", "schema")
    ).otherwise(F.col("schema"))
    rows = (
        rows.withColumn("choice", F.coalesce("choice", default))
        .withColumn("next_url", next_url)
        .withColumn("ends", F.coalesce(ends, F.lit(False)))
        .withColumn("deeper", F.coalesce(deeper, F.lit(False)))
        .withColumn("used", used)
    )
    adds = (F.col("outcome") == "add_level") | F.col("ends") | F.col("deeper")
    asked_again = (F.col("outcome") == "ask") & ~F.col("ends") & ~F.col("deeper")
    # N10: the level joins the chain; a site asked again has not finished its visit
    return rows.select(
        "root_url",
        F.when(F.col("deeper"), F.col("next_url")).otherwise(F.col("current_url")).alias("current_url"),
        F.when(F.col("deeper"), F.col("current_level") + 1).otherwise(F.col("current_level")).alias("current_level"),
        F.when(asked_again, F.array_remove("visited", F.col("current_url"))).otherwise(F.col("visited")).alias("visited"),
        (F.col("outcome").isin("finish", "add_level") | F.col("ends")).alias("done"),
        F.when(adds, F.array_append("chain", _level(F.col("used")))).otherwise(F.col("chain")).alias("chain"),
    )


def finish(state: DataFrame, stamp: Column) -> DataFrame:
    """Plans of all sites that are done."""
    chain = F.col("chain")
    final = F.element_at(chain, -1)
    has = F.size(chain) > 0
    name = lambda s: F.coalesce(F.when(s["catalog_type"] != "", s["catalog_type"]), F.concat(F.lit("level_"), s["level"]))
    return state.where("done").select(
        plan_id(F.col("root_url"), stamp).alias("id"),
        "root_url",
        F.when(has, F.coalesce(F.when(final["item_name"] != "", final["item_name"]), F.lit("Item"))).otherwise("Item").alias(
            "item_name"
        ),
        F.when(has, F.size(chain)).otherwise(1).alias("nesting_depth"),
        F.transform(chain, name).alias("level_names"),
        chain.alias("schema_chain"),
        F.col("visited").alias("visited_urls"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def with_sample_values(plans: DataFrame, docs: DataFrame, index: DataFrame) -> DataFrame:
    """Plans whose fields show a value from the page they were found on."""
    levels = plans.select(F.col("id").alias("plan_id"), F.inline("schema_chain")).withColumnRenamed("url", "sample_url")
    values = sample_values(levels, docs, index).groupBy("plan_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(":", "level", "name").alias("k"), F.col("sample_value").alias("v")))
        ).alias("values")
    )
    filled = F.transform(
        "schema_chain",
        lambda s: s.withField(
            "fields",
            F.transform(
                s["fields"],
                lambda f: f.withField(
                    "sample_value",
                    F.coalesce(F.try_element_at(F.col("values"), F.concat_ws(":", s["level"], f["name"])), f["sample_value"]),
                ),
            ),
        ),
    )
    joined = plans.join(values, plans["id"] == values["plan_id"], "left").drop("plan_id")
    return joined.withColumn(
        "schema_chain", F.when(F.col("values").isNull(), F.col("schema_chain")).otherwise(filled)
    ).drop("values")


def run(
    roots: DataFrame,
    docs: DataFrame,
    index: DataFrame,
    schemas: DataFrame,
    nestings: DataFrame,
    stamp: Column,
    mode: str = "auto",
    max_depth: int = 10,
) -> DataFrame:
    """Discovery to the end with default answers: at most ``max_depth`` rounds over all sites."""
    state = keep(start(roots))
    parts = []
    for _ in range(max_depth + 1):
        if state.isEmpty():
            break
        state = keep(apply_answers(decide(observe(state, docs, index, schemas, nestings, max_depth), mode)))
        parts.append(state.where("done"))
        state = state.where(~F.col("done"))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return finish(done, stamp)
