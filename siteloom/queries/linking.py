"""Queries on link candidates and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.exchange.responses import parse_responses
from siteloom.functions.urls import normalize_url, resolve_url
from siteloom.operators import frontier as N
from siteloom.plans import discovery
from siteloom.plans.model import LEVEL
from siteloom.queries import inputs as I
from siteloom.queries import sql as Q


def _cards(spark, sf, selector):
    pages = I.part_pages(spark, sf).where("url like '%/cards/%'")
    return pages.select(F.xxhash64("url").alias("page_id"), "url", F.lit(selector).cast("string").alias("item_container_selector"))


def _captured(spark, sf):
    """Pages with an item selector that fits, one that does not, or none."""
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    selector = F.when(lang == "en", "nav li").when(lang == "de", ".none")
    return I.pages(spark, sf).select("page_id", "url", selector.alias("item_container_selector"))


def n1_item_links(spark, sf):
    return N.item_links(_captured(spark, sf), I.docs(spark, sf)).select("page_id", "href", "text")


def n2_link_pool(spark, sf):
    docs = I.docs(spark, sf)
    first = N.source_links(_captured(spark, sf), docs)
    visited = first.groupBy("page_id").agg(F.min_by(resolve_url(F.col("url"), F.col("href")), "pos").alias("link_url"))
    return N.link_pool(_captured(spark, sf), docs, visited).select("page_id", "position", "link_url", "score")


def n2_link_pool_items(spark, sf):
    pool = N.link_pool(_cards(spark, sf, "div.card"), I.site_docs(spark, sf))
    return pool.select("url", "position", "link_url", "score")


def n2_link_pool_fallback(spark, sf):
    pool = N.link_pool(_cards(spark, sf, None), I.site_docs(spark, sf))
    return pool.select("url", "position", "link_url", "score")


def n3_link_labels(spark, sf):
    links = N.source_links(_captured(spark, sf), I.docs(spark, sf))
    return N.link_labels(links).select("page_id", "link_url", "label")


def _pool(spark, sf):
    return I.once(
        spark, sf, "card_pool", lambda: N.link_pool(_cards(spark, sf, "div.card"), I.site_docs(spark, sf))
    )


def n4_top_candidates(spark, sf):
    return N.top_candidates(_pool(spark, sf), N.MAX_CANDIDATES).select("url", "rank", "link_url", "label", "reason", "confidence")


def _page_number():
    return F.regexp_extract("url", "([0-9]+)$", 1).cast("int")


def n5_resolve_candidates(spark, sf):
    good = [("3", None, "0.9"), ("x", "bad", "1"), (None, "none", "1"), ("99999", "far", "1"), ("0", "First", "high")]
    bad = [("-1", "below", "1"), ("x", None, None)]
    make = lambda rows: F.array(
        *[
            F.struct(
                F.lit(i).cast("string").alias("link_index"), F.lit(n).cast("string").alias("label"),
                F.lit("why").alias("reason"), F.lit(c).cast("string").alias("confidence"),
            )
            for i, n, c in rows
        ]
    )
    listed = _cards(spark, sf, "div.card").select(
        "page_id", F.when(_page_number() % 2 == 0, make(good)).otherwise(make(bad)).alias("ranked_candidates")
    )
    found = N.resolve_candidates(listed, _pool(spark, sf))
    return found.select("url", "rank", "link_url", "label", "reason", "confidence")


def n6_choose_links(spark, sf):
    number = _page_number()
    part = lambda n: F.concat(F.col("url"), F.lit("/part-"), (number * I.PARTS_PER_PAGE + n).cast("string"))
    answers = _cards(spark, sf, "div.card").select(
        "page_id",
        F.when(number % 4 == 0, part(2)).otherwise(F.lit("https://elsewhere.example.com/")).alias("selected_url"),
        F.when(number % 4 == 1, "1").when(number % 4 == 2, "many").otherwise("100000").alias("link_index"),
        F.when(number % 4 == 2, part(4)).alias("recommended_url"),
    )
    return N.choose_links(answers, _pool(spark, sf)).select("selected_url", "link_index", "next_url")


def n9_guard_frontier(spark, sf):
    pages = I.pages(spark, sf)
    rows = pages.select(
        F.col("url").alias("root_url"), F.concat("url", F.lit("/x")).alias("current_url"),
        F.expr("cast(page_id % 13 as int)").alias("current_level"),
    )
    visited = pages.where("url like 'https:%'").select(F.col("url").alias("root_url"), F.concat("url", F.lit("/x")).alias("url"))
    return N.guard_frontier(rows, visited, 10)


def _responses(spark, sf):
    """Raw answers about the pages of the shops, fenced or not, as a model might give them."""
    # saved, so that answers are made and parsed per page and not per customer that is listed there
    pages = I.once(spark, sf, "shop_urls", lambda: I.customer_pages(spark, sf).select("url"))
    pages = pages.repartition(spark.sparkContext.defaultParallelism)
    kind = F.when(F.col("url").contains("/n/"), "customer").when(F.col("url").contains("/r/"), "nation").otherwise("region")
    fields = F.lit('[{"name":"name","selector":"b","type":"string"},{"name":"link","selector":"a","attribute":"href"}]')
    schema = F.concat(
        F.lit('{"is_catalog":true,"catalog_type":"'), kind, F.lit('","confidence":0.8,"archetype":"list","item_schema":{"item_name":"'),
        kind, F.lit('","item_container_selector":"li.item","fields":'), fields, F.lit('},"reasoning":"list"}'),
    )
    nesting = F.concat(
        F.lit('{"is_final_level":'), F.when(kind == "customer", "true").otherwise("false"),
        F.lit(',"reasoning":"links","drill_down_link_selector":"a","ranked_candidates":[{"link_index":1,"label":"","confidence":0.7}]}'),
    )
    fenced = F.concat(F.lit("```json\n"), schema, F.lit("\n```"))
    key = normalize_url(F.col("url")).alias("url_key")
    schemas = pages.select(key, F.lit("list").alias("kind"), F.when(kind == "nation", fenced).otherwise(schema).alias("raw"))
    return schemas, pages.select(key, nesting.alias("raw"))


def _roots(spark, sf):
    return I.customer_roots(spark, sf).select(F.lower("url").alias("root_url"))


def _discovery_inputs(spark, sf):
    schemas, nestings = _responses(spark, sf)
    answered = lambda kind, raw: I.once(spark, sf, f"{kind}_answers", lambda: parse_responses(raw, kind))
    return I.site_docs(spark, sf), I.site_index(spark, sf), answered("schema", schemas), answered("nesting", nestings)


def _first_round(spark, sf, mode):
    state = discovery.start(_roots(spark, sf))
    return discovery.decide(discovery.observe(state, *_discovery_inputs(spark, sf)), mode)


def n7_decisions(spark, sf):
    return _first_round(spark, sf, "auto").select(
        "root_url", "outcome", "decision", "step", F.array_join("options", ",").alias("options"), "recommended_url",
        F.size("ranked_candidates").alias("n_candidates"), F.size("links").alias("n_links"),
    )


def n7_manual_decisions(spark, sf):
    return _first_round(spark, sf, "manual").select(
        "root_url", "decision", F.array_join("options", ",").alias("options"),
        F.array_join("available_links", " ").alias("available_links"),
    )


def n8_apply_answers(spark, sf):
    decided = _first_round(spark, sf, "auto")
    number = F.regexp_extract("root_url", "shop([0-9]+)", 1).cast("int")
    answers = _roots(spark, sf).select(
        "root_url",
        F.when(number % 4 == 0, "continue").when(number % 4 == 1, "stop").when(number % 4 == 2, "final").otherwise("what").alias("choice"),
        F.lit(None).cast("string").alias("selected_url"),
        F.lit("2").alias("link_index"),
    )
    state = discovery.apply_answers(decided, answers)
    return state.select(
        "root_url", "current_url", "current_level", "done", F.size("visited").alias("n_visited"), F.size("chain").alias("n_levels")
    )


def _discovered(spark, sf):
    return I.once(
        spark, sf, "discovered",
        lambda: discovery.run(_roots(spark, sf), *_discovery_inputs(spark, sf), F.lit("2026-01-01T00:00:00")),
    )


def n10_levels(spark, sf):
    plans = discovery.with_sample_values(_discovered(spark, sf), I.site_docs(spark, sf), I.site_index(spark, sf))
    levels = plans.select("root_url", F.inline("schema_chain"))
    fields = levels.select("root_url", "level", "url", "catalog_type", "item_container_selector", F.explode("fields").alias("f"))
    return fields.select("root_url", "level", "url", "catalog_type", "item_container_selector", "f.name", "f.sample_value")


def n11_finish_plans(spark, sf):
    """Plans of all customers' stored chains, finished anew."""
    state = I.plans(spark, sf).select(
        "root_url", F.lit(True).alias("done"), F.col("schema_chain").alias("chain"), F.col("visited_urls").alias("visited")
    )
    done = discovery.finish(state, F.lit("2026-01-01T00:00:00"))
    return done.select("root_url", "item_name", "nesting_depth", F.array_join("level_names", ",").alias("level_names"))


def n12_run_discovery(spark, sf):
    return _discovered(spark, sf).select(
        "root_url", "item_name", "nesting_depth", F.array_join("level_names", ",").alias("level_names"),
        F.array_join("visited_urls", " ").alias("visited_urls"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        n1_item_links, n2_link_pool, n2_link_pool_items, n2_link_pool_fallback, n3_link_labels, n4_top_candidates,
        n5_resolve_candidates, n6_choose_links, n7_decisions, n7_manual_decisions, n8_apply_answers, n9_guard_frontier,
        n10_levels, n11_finish_plans, n12_run_discovery,
    )
}

_CARD = """cards AS (SELECT p_partkey // 200 AS page, p_partkey, p_name, 'https://parts.example.com/cards/' || (p_partkey // 200) AS url,
    'https://parts.example.com/cards/' || (p_partkey // 200) || '/part-' || p_partkey AS link_url,
    row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) - 1 AS i,
    count(*) OVER (PARTITION BY p_partkey // 200) AS n FROM part)"""
_ROOT = """roots AS (SELECT DISTINCT c_custkey // 500 AS site, 'http://shop' || (c_custkey // 500) || '.example.com' AS root_url FROM customer)"""
_EN = "regexp_extract(url, '/([a-z][a-z])/', 1) = 'en'"
# which link of the region and of its first nations a discovery follows: the second of the list, minus what was visited
_REGION = "(SELECT r_regionkey AS k FROM region ORDER BY r_regionkey LIMIT 1 OFFSET 1)"
_NATION = f"(SELECT n_nationkey FROM nation WHERE n_regionkey = {_REGION} ORDER BY n_nationkey LIMIT 1 OFFSET 1)"

SQL = {
    "n1_item_links": f"""WITH {Q.LINKS} SELECT page_id, href, arg_min(label, pos) AS text FROM links
        WHERE {_EN} GROUP BY page_id, href""",
    "n2_link_pool": f"""WITH {Q.LINKS}, v AS (SELECT page_id, arg_min(link_url, pos) AS v FROM links GROUP BY 1),
        u AS (SELECT page_id, url, link_url, min(pos) AS pos FROM links WHERE {Q.page_of('url')} <> {Q.page_of('link_url')} GROUP BY ALL),
        s AS (SELECT *, {Q.score('url', 'link_url')} AS score FROM u)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) - 1 AS position, link_url, score
        FROM s JOIN v USING (page_id) WHERE link_url <> v""",
    "n2_link_pool_items": f"WITH {_CARD} SELECT url, i AS position, link_url, 1.0::DOUBLE AS score FROM cards",
    "n2_link_pool_fallback": f"""WITH {_CARD} SELECT url, i AS position, link_url, 1.0::DOUBLE AS score FROM cards
        UNION ALL SELECT DISTINCT url, n, 'https://parts.example.com/', 0.3::DOUBLE FROM cards""",
    "n3_link_labels": f"WITH {Q.LINKS} SELECT page_id, link_url, arg_min(label, pos) AS label FROM links GROUP BY ALL",
    "n4_top_candidates": f"""WITH {_CARD} SELECT url, i AS rank, link_url, p_name AS label, '' AS reason, 1.0::DOUBLE AS confidence
        FROM cards WHERE i < 8""",
    "n5_resolve_candidates": f"""WITH {_CARD} SELECT url, 0 AS rank, link_url, p_name AS label, 'why' AS reason, 0.9::DOUBLE AS confidence
          FROM cards WHERE i = 3 AND page % 2 = 0
        UNION ALL SELECT url, 4, link_url, 'First', 'why', 0.0::DOUBLE FROM cards WHERE i = 0 AND page % 2 = 0
        UNION ALL SELECT url, i, link_url, p_name, '', 1.0::DOUBLE FROM cards WHERE page % 2 = 1""",
    "n6_choose_links": f"""WITH {_CARD} SELECT CASE page % 4 WHEN 0 THEN url || '/part-' || (page * 200 + 2) ELSE 'https://elsewhere.example.com/' END
          AS selected_url, CASE page % 4 WHEN 1 THEN '1' WHEN 2 THEN 'many' ELSE '100000' END AS link_index,
          CASE page % 4 WHEN 0 THEN url || '/part-' || (page * 200 + 2) WHEN 1 THEN max(link_url) FILTER (i = 1)
            WHEN 2 THEN url || '/part-' || (page * 200 + 4) ELSE max(link_url) FILTER (i = 0) END AS next_url
        FROM cards GROUP BY page, url""",
    "n7_decisions": f"""WITH {_ROOT} SELECT root_url, 'ask' AS outcome, 'confirm_drilling' AS decision, 'nesting_analysis' AS step,
        'continue,final' AS options, root_url || '/r/' || {_REGION} || '/#top' AS recommended_url, 1 AS n_candidates,
        (SELECT count(*) FROM region) AS n_links FROM roots""",
    "n7_manual_decisions": f"""WITH {_ROOT} SELECT root_url, 'select_link' AS decision, 'final,drill' AS options,
        string_agg(root_url || '/r/' || r_regionkey || '/#top', ' ' ORDER BY r_regionkey) AS available_links
        FROM roots, region GROUP BY root_url""",
    "n8_apply_answers": f"""WITH {_ROOT}, t AS (SELECT *, (SELECT r_regionkey FROM region ORDER BY 1 LIMIT 1 OFFSET 2) AS k, site % 4 AS c FROM roots)
        SELECT root_url, CASE c WHEN 0 THEN root_url || '/r/' || k || '/#top' ELSE root_url END AS current_url,
        CASE c WHEN 0 THEN 2 ELSE 1 END AS current_level, c IN (1, 2) AS done, CASE c WHEN 3 THEN 0 ELSE 1 END AS n_visited,
        CASE c WHEN 3 THEN 0 ELSE 1 END AS n_levels FROM t""",
    "n9_guard_frontier": """SELECT url AS root_url, url || '/x' AS current_url, page_id % 13 AS current_level,
        page_id % 13 <= 10 AND url NOT LIKE 'https:%' AS proceed FROM pages""",
    "n10_levels": f"""WITH {_ROOT}, {Q.SHOPS}, c AS (SELECT site, arg_min(name, c_custkey) AS name FROM shops WHERE n_nationkey = {_NATION} GROUP BY 1),
        f AS (SELECT arg_min(n_name, n_nationkey) AS n, min(n_nationkey) AS k FROM nation WHERE n_regionkey = {_REGION})
        SELECT root_url, 1 AS level, root_url AS url, 'region' AS catalog_type, 'li.item' AS item_container_selector, unnest(['name', 'link']) AS name,
          unnest([NULL, 'r/' || (SELECT min(r_regionkey) FROM region) || '/#top']) AS sample_value FROM roots
        UNION ALL SELECT root_url, 2, root_url || '/r/' || {_REGION} || '/#top', 'nation', 'li.item', unnest(['name', 'link']), unnest([n, '/n/' || k]) FROM roots, f
        UNION ALL SELECT root_url, 3, root_url || '/n/' || {_NATION}, 'customer', 'li.item', unnest(['name', 'link']), unnest([name, NULL]) FROM roots JOIN c USING (site)""",
    "n12_run_discovery": f"""WITH {_ROOT} SELECT root_url, 'customer' AS item_name, 3 AS nesting_depth, 'region,nation,customer' AS level_names,
        root_url || ' ' || root_url || '/r/' || {_REGION} || '/#top ' || root_url || '/n/' || {_NATION} AS visited_urls FROM roots""",
    "n11_finish_plans": f"""WITH {Q.PLANS} SELECT root_url, CASE WHEN filled AND n_regionkey <> 1 THEN 'item ' || n_name ELSE 'Item' END AS item_name,
        CASE WHEN filled THEN 2 ELSE 1 END AS nesting_depth,
        CASE WHEN filled THEN kind || ',' || coalesce(kind2, 'level_2') ELSE '' END AS level_names FROM plans""",
}
