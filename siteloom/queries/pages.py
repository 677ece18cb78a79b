"""Queries on page sources, URL functions, document trees and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import preview, search, summary
from siteloom.operators.parse import dom_nodes
from siteloom.operators.select import select_many, select_one
from siteloom.queries import inputs as I
from siteloom.queries import sql as Q
from siteloom.sources.pages import fetch_pages, missing, page_index


def _links(spark, sf):
    """Every anchor of the pages, with its absolute URL."""
    rows = summary.all_links(I.docs(spark, sf))
    return I.pages(spark, sf).select("page_id", "url").join(rows, "page_id")


def s1_page_scan(spark, sf):
    return I.pages(spark, sf).select("page_id", "url", F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


def s1_page_lookup(spark, sf):
    pages = I.pages(spark, sf)
    asked = pages.select(
        F.col("page_id").alias("request"), F.concat(F.replace("url", F.lit("https:"), F.lit("http:")), F.lit("#x")).alias("url")
    )
    return fetch_pages(asked, pages).select("request", "page_id", F.length("html").alias("n_chars"))


def s2_missing_pages(spark, sf):
    asked = _links(spark, sf).select("page_id", U.resolve_url(F.col("url"), F.col("href")).alias("url")).distinct()
    return missing(asked, page_index(I.pages(spark, sf))).select("page_id", "url", "error")


def u1_normalize_url(spark, sf):
    return I.pages(spark, sf).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


def u2_url_hash(spark, sf):
    return I.pages(spark, sf).select("page_id", U.url_hash(U.normalize_url(F.col("url"))).alias("url_key"))


def u3_resolve_url(spark, sf):
    return _links(spark, sf).select("page_id", "href", U.resolve_url(F.col("url"), F.col("href")).alias("link_url")).distinct()


def _neighbours(spark, sf):
    pages = I.pages(spark, sf)
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return pages.select("page_id", "url").join(other, "page_id")


def u4_is_same_domain(spark, sf):
    return _neighbours(spark, sf).select("page_id", U.is_same_domain(F.col("url"), F.col("other")).alias("same_domain"))


def u5_score_drill_link(spark, sf):
    base = F.regexp_replace("url", "[?#].*$", "")
    child = F.concat(U.rstrip_slashes(base), F.lit("/more"))
    cases = F.array(F.col("other"), child, F.col("url"))
    rows = _neighbours(spark, sf).select("page_id", "url", F.posexplode(cases).alias("pos", "other"))
    return rows.select("page_id", "pos", U.score_drill_link(F.col("url"), F.col("other")).alias("score"))


def u6_is_valid_drill_link(spark, sf):
    cases = F.array(F.col("url"), F.lit("#top"), F.lit("?page=2"), F.lit("mailto:a@b.c"), F.lit("next"), F.col("other"))
    rows = _neighbours(spark, sf).select("page_id", "url", F.posexplode(cases).alias("pos", "link"))
    return rows.select("page_id", "pos", U.is_valid_drill_link(F.col("link"), F.col("url")).alias("valid"))


def u7_resolved_links(spark, sf):
    from siteloom.operators.frontier import resolve_links

    return resolve_links(_links(spark, sf)).select("page_id", "link_url")


def u8_url_label(spark, sf):
    rows = _links(spark, sf).select(U.resolve_url(F.col("url"), F.col("href")).alias("u")).union(
        I.pages(spark, sf).select("url")
    )
    return rows.distinct().select("u", U.url_label(F.col("u")).alias("label"))


def u9_plan_id(spark, sf):
    stamp = F.lit("2026-01-01T00:00:00")
    return I.pages(spark, sf).select("page_id", U.plan_id(F.col("url"), stamp).alias("plan_id"))


def d1_parse_pages(spark, sf):
    count = lambda tag: F.size(F.filter("elems", lambda e: e["tag"] == tag)).alias("n_" + tag)
    comments = F.size(F.filter("texts", lambda t: t["kind"] == "comment")).alias("n_comments")
    return I.docs(spark, sf).select(
        "page_id", *[count(t) for t in ("p", "a", "li", "b", "br", "div", "h1", "script", "footer")], comments
    )


def d1_dom_nodes(spark, sf):
    return dom_nodes(I.docs(spark, sf))


def d2_remove_noise(spark, sf):
    rows = summary.remove_noise(I.docs(spark, sf)).where((F.col("kind") == "element") & F.col("parent").isNotNull())
    return rows.groupBy("page_id").agg(F.count("*").alias("n_elements"))


def d3_page_titles(spark, sf):
    return summary.page_titles(I.docs(spark, sf))


def d4_class_frequency(spark, sf):
    docs = I.site_docs(spark, sf)
    rows = summary.class_frequency(docs, summary.MAX_CLASSES).join(docs.select("page_id", "url"), "page_id")
    return rows.select("url", "rank", F.col("class").alias("class_name"), "n")


def d5_class_samples(spark, sf):
    docs = I.site_docs(spark, sf)
    rows = summary.class_samples(docs, summary.MAX_CLASSES).join(docs.select("page_id", "url"), "page_id")
    return rows.select("url", F.col("class").alias("class_name"), "tag", "text_sample")


def d6_link_samples(spark, sf):
    return summary.link_samples(I.docs(spark, sf))


def d7_structural_elements(spark, sf):
    parsed = I.site_docs(spark, sf)
    rows = summary.structural_elements(parsed, summary.MAX_PER_TAG, summary.MAX_CHILDREN, summary.MAX_STRUCTURES).join(parsed.select("page_id", "url"), "page_id")
    return rows.select(
        "url", "pos", "selector", "tag", "text_preview", F.size("children").alias("n_children"),
        F.col("children")[0]["text"].alias("first_child"),
    )


def d8_summarize(spark, sf):
    return summary.summarize(I.docs(spark, sf), **summary.SHORT).select(
        "page_id", "title", F.to_json("common_classes").alias("common_classes"), F.to_json("samples").alias("samples"),
        F.to_json("link_samples").alias("link_samples"), F.to_json("structural_elements").alias("structural_elements"),
    )


def _part_searches(spark, sf):
    part = I.table(spark, sf, "part")
    asked = part.select(
        F.xxhash64(F.concat(F.lit("https://parts.example.com/cards/"), F.expr(f"p_partkey div {I.PARTS_PER_PAGE}"))).alias("page_id"),
        F.expr(f"p_partkey div {I.PARTS_PER_PAGE}").alias("page"),
        F.upper("p_name").alias("expected_value"),
    ).distinct()
    return asked


def _value_index(spark, sf):
    return I.once(spark, sf, "value_index", lambda: search.value_index(I.site_docs(spark, sf)))


def _found_parts(hits):
    return hits.groupBy("page", "expected_value").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("attribute_found") == "alt", 1)).alias("n_alt"),
        F.min_by("selector_hint", "pos").alias("first_hint"),
        F.min_by("full_text", "pos").alias("first_text"),
    )


def d9_find_values(spark, sf):
    return _found_parts(search.find_values(_part_searches(spark, sf), I.site_docs(spark, sf)))


def d9_find_indexed(spark, sf):
    return _found_parts(search.find_indexed(_part_searches(spark, sf), I.site_docs(spark, sf), _value_index(spark, sf)))


def d9_find_anywhere(spark, sf):
    """Every supplier's name, on whatever pages it stands."""
    docs = I.site_docs(spark, sf)
    # a name that several suppliers have is looked for once
    asked = I.table(spark, sf, "supplier").groupBy(F.upper("s_name").alias("expected_value")).agg(F.count("*").alias("times"))
    hits = search.find_indexed(asked, docs, _value_index(spark, sf)).groupBy("page_id", "expected_value").agg(
        F.sum("times").alias("n"), F.min_by("selector_hint", "pos").alias("first_hint")
    )
    return hits.join(docs.select("page_id", "url"), "page_id").select("url", "expected_value", "n", "first_hint")


def d10_sanitize_html(spark, sf):
    return preview.previews(I.pages(spark, sf)).select("page_id", F.md5("preview").alias("digest"))


def d10_highlight(spark, sf):
    rows = preview.previews(I.pages(spark, sf), F.lit("nav a"))
    return rows.select("page_id", (F.instr("preview", "nav a {outline") > 0).alias("marked"), F.instr("preview", "<style>p{").alias("own_style_at"))


_SELECTORS = {
    "below": "article p", "child": "article > p", "path": "nav > ul > li a[href]", "first": "li:first-child",
    "later": "li ~ li", "next": "li + li", "third": "nav li:nth-child(3)", "class": "div.ad", "not": "li:not(:first-child)",
    "list": "h1, footer, .ad", "prefix": 'a[href^="/"]', "word": "[class~=ad]", "none": "section",
}


def x1_select(spark, sf):
    found = select_many(I.docs(spark, sf), _SELECTORS)
    return found.groupBy("page_id", "selector_id").agg(F.count("*").alias("n"))


_NESTED = {
    "poor": ".entry:not(:has(a))", "either": '.entry:is(:has(> a[href$="7"]), :has(span))', "before_poor": ".entry:has(+ .entry > span)",
    "some_poor_later": ".entry:has(~ .entry span)", "segment": "li.item:has(> i.segment) > b.name", "debt": "li:has(> .balance):not(:has(i)) > b",
    "table": "body:has(> main table tr td + td) > header", "cards": "main:has(> div.card) > :is(div.card:not(:has(> .none, p)), article)",
}


def x1_nested_lists(spark, sf):
    docs = I.site_docs(spark, sf)
    found = select_many(docs, _NESTED).groupBy("page_id", "selector_id").agg(F.count("*").alias("n"))
    return found.join(docs.select("page_id", "url"), "page_id").select("url", "selector_id", "n")


def x2_select_one(spark, sf):
    docs = I.docs(spark, sf)
    hits = select_one(docs, "nav li", "a").where("hit is not null")
    rows = hits.join(docs.select("page_id", "elems"), "page_id")
    return rows.select("page_id", F.try_element_at(F.get("elems", F.col("hit.node"))["attrs"], F.lit("href")).alias("href"), "node").groupBy(
        "page_id", "href"
    ).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        s1_page_scan, s1_page_lookup, s2_missing_pages, u1_normalize_url, u2_url_hash, u3_resolve_url, u4_is_same_domain,
        u5_score_drill_link, u6_is_valid_drill_link, u7_resolved_links, u8_url_label, u9_plan_id, d1_parse_pages,
        d1_dom_nodes, d2_remove_noise, d3_page_titles, d4_class_frequency, d5_class_samples, d6_link_samples,
        d7_structural_elements, d8_summarize, d9_find_values, d9_find_indexed, d9_find_anywhere, d10_sanitize_html, d10_highlight, x1_select, x1_nested_lists, x2_select_one,
    )
}

_count = lambda pattern: f"len(regexp_extract_all(html, '{pattern}'))"
_article = "regexp_extract(html, '(?s)<article>(.*)$', 1)"
_list = lambda name, n: f"SELECT page_id, '{name}' AS selector_id, {n} AS n FROM pages"
_safe = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g')"
_neighbour_sql = "SELECT a.page_id, a.url, b.url AS other FROM pages a JOIN pages b ON b.page_id = a.page_id + 1"

# every class of the rendered pages that can be seen five times or more: page, place of its element and of the class in it, tag, text
_CLASSES = """
shop AS (SELECT DISTINCT 'https://shop' || (c_custkey // 500) || '.example.com/' AS host FROM customer),
cust AS (
  SELECT 'https://shop' || (c_custkey // 500) || '.example.com/n/' || c_nationkey AS url, c_custkey AS k, c_name AS name,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer),
card AS (
  SELECT 'https://parts.example.com/cards/' || (p_partkey // 200) AS url, p_partkey AS k, p_name AS name, CAST(p_retailprice AS VARCHAR) AS price,
         replace(lower(p_brand), '#', '-') AS brand FROM part),
t AS (
  SELECT url, k, o, c, tag, text FROM (
    SELECT url, k, unnest([0, 1, 2, 3, 4]) AS o, unnest(['card', brand, 'title', 'price', 'more']) AS c, unnest(['div', 'div', 'h2', 'span', 'a']) AS tag,
           unnest([name || ' ' || price || ' top ' || name || ' buy next', name || ' ' || price || ' top ' || name || ' buy next', name, price, name]) AS text
    FROM card)
  UNION ALL
  SELECT 'https://parts.example.com/rows/' || (p_partkey // 200), p_partkey, 0, 'row', 'tr', p_partkey || ' ' || p_type || ' ' || p_size FROM part
  UNION ALL
  SELECT 'https://supply' || (s_suppkey // 200) || '.example.com/', s_suppkey, 0, 'entry', 'div', s_name FROM supplier
  UNION ALL
  SELECT host, r_regionkey, 0, 'item', 'li', r_name FROM shop, region
  UNION ALL
  SELECT host || 'r/' || n_regionkey, n_nationkey, o, c, tag, text FROM shop, (
    SELECT n_regionkey, n_nationkey, unnest([0, 1]) AS o, unnest(['item', 'name']) AS c, unnest(['li', 'b']) AS tag, unnest([n_name || ' open', n_name]) AS text
    FROM nation)
  UNION ALL
  SELECT * FROM (
    SELECT url, k, unnest([0, 1, 2, 3]) AS o, unnest(['item', 'name', 'segment', 'balance']) AS c, unnest(['li', 'b', 'i', 'p']) AS tag,
           unnest([concat_ws(' ', name, segment, 'balance'), name, segment, 'balance']) AS text FROM cust)
  WHERE text IS NOT NULL)
"""

SQL = {
    "s1_page_scan": "SELECT page_id, url, length(html) AS n_chars, md5(html) AS digest FROM pages",
    "s1_page_lookup": f"""WITH k AS (SELECT page_id, {Q.norm('url')} AS url_key FROM pages),
        m AS (SELECT url_key, max(page_id) AS page_id FROM k GROUP BY url_key)
        SELECT k.page_id AS request, m.page_id, length(html) AS n_chars
        FROM k JOIN m USING (url_key) JOIN pages p ON p.page_id = m.page_id""",
    "s2_missing_pages": f"""WITH {Q.LINKS}, k AS (SELECT {Q.norm('url')} AS url_key FROM pages)
        SELECT DISTINCT page_id, link_url AS url, 'missing page' AS error FROM links
        WHERE {Q.norm('link_url')} NOT IN (SELECT url_key FROM k)""",
    "u1_normalize_url": f"SELECT page_id, {Q.norm('url')} AS normalized FROM pages",
    "u2_url_hash": f"SELECT page_id, substr(md5({Q.norm('url')}), 1, 12) AS url_key FROM pages",
    "u3_resolve_url": f"WITH {Q.LINKS} SELECT DISTINCT page_id, href, link_url FROM links",
    "u4_is_same_domain": f"SELECT page_id, {Q.host('url')} = {Q.host('other')} AS same_domain FROM ({_neighbour_sql})",
    "u5_score_drill_link": f"""WITH n AS ({_neighbour_sql}), c AS (
        SELECT page_id, url, 0 AS pos, other FROM n
        UNION ALL SELECT page_id, url, 1, {Q.page_of("regexp_replace(url, '[?#].*$', '')")} || '/more' FROM n
        UNION ALL SELECT page_id, url, 2, url FROM n)
        SELECT page_id, pos, {Q.score('url', 'other')} AS score FROM c""",
    "u6_is_valid_drill_link": f"""WITH n AS ({_neighbour_sql}), c AS (
        SELECT page_id, 0 AS pos, false AS valid FROM n UNION ALL SELECT page_id, 1, false FROM n
        UNION ALL SELECT page_id, 2, regexp_extract(url, '^([^?#]*)', 1) LIKE '%/' FROM n
        UNION ALL SELECT page_id, 3, false FROM n UNION ALL SELECT page_id, 4, true FROM n
        UNION ALL SELECT page_id, 5, {Q.host('url')} = {Q.host('other')} AND {Q.page_of('url')} <> {Q.page_of('other')} FROM n)
        SELECT * FROM c""",
    "u7_resolved_links": f"WITH {Q.LINKS} SELECT DISTINCT page_id, link_url FROM links WHERE {Q.page_of('url')} <> {Q.page_of('link_url')}",
    "u8_url_label": f"""WITH {Q.LINKS}, u AS (SELECT link_url AS u FROM links UNION SELECT url FROM pages)
        SELECT u, {Q.label('u')} AS label FROM u""",
    "u9_plan_id": """SELECT page_id, trim(substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 30), '_') || '_' ||
        substr(md5(url || ':2026-01-01T00:00:00'), 1, 12) AS plan_id FROM pages""",
    "d1_parse_pages": f"""SELECT page_id, {_count('<p[ >]')} AS n_p, {_count('<a[ >]')} AS n_a, {_count('<li[ >]')} AS n_li,
        {_count('<b>')} AS n_b, {_count('<br>')} AS n_br, {_count('<div[ >]')} AS n_div, {_count('<h1[ >]')} AS n_h1,
        {_count('<script>')} AS n_script, {_count('<footer>')} AS n_footer, {_count('<!-- ')} AS n_comments FROM pages""",
    "d2_remove_noise": """SELECT page_id, len(regexp_extract_all(regexp_replace(html,
        '(?is)<(?:script|style)>.*?</(?:script|style)>', '', 'g'), '<[a-z]')) AS n_elements FROM pages""",
    "d3_page_titles": """SELECT page_id, regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'),
        '&amp;?', '&', 'g') AS title FROM pages""",
    "d4_class_frequency": f"""WITH {_CLASSES},
        g AS (SELECT url, c, count(*) AS n, min(k * 10 + o) AS f FROM t GROUP BY ALL HAVING count(*) >= 5),
        r AS (SELECT url, c, n, row_number() OVER (PARTITION BY url ORDER BY f) AS rank FROM g)
        SELECT url, rank, c AS class_name, n FROM r WHERE rank <= 20""",
    "d5_class_samples": f"""WITH {_CLASSES},
        g AS (SELECT url, c, min(k * 10 + o) AS f FROM t GROUP BY ALL HAVING count(*) >= 5),
        r AS (SELECT url, c FROM g QUALIFY row_number() OVER (PARTITION BY url ORDER BY f) <= 20)
        SELECT url, c AS class_name, tag, text AS text_sample FROM t JOIN r USING (url, c)
        QUALIFY row_number() OVER (PARTITION BY url, c ORDER BY k) <= 3""",
    "d6_link_samples": f"""WITH {Q.LINKS}, f AS (SELECT page_id, href, min(pos) AS first, arg_min(label, pos) AS text FROM links GROUP BY ALL)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos, href, text,
        'li' AS parent_tag, '' AS parent_class, true AS in_nav FROM f""",
    "d7_structural_elements": """WITH c AS (SELECT p_partkey // 200 AS page, p_partkey, p_name AS name, CAST(p_retailprice AS VARCHAR) AS price,
          'div.card.' || replace(lower(p_brand), '#', '-') AS selector FROM part
          QUALIFY row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) <= 15),
        d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page, selector ORDER BY p_partkey) = 1),
        e AS (SELECT s_suppkey // 200 AS site, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey // 200 ORDER BY s_suppkey) = 1)
        SELECT 'https://parts.example.com/cards/' || page AS url, row_number() OVER (PARTITION BY page ORDER BY p_partkey) - 1 AS pos, selector,
          'div' AS tag, name || ' ' || price || ' top ' || name || ' buy next' AS text_preview, 6 AS n_children, name AS first_child FROM d
        UNION ALL SELECT 'https://supply' || site || '.example.com/', 0, 'div.entry', 'div', s_name, 1, s_name FROM e
        UNION ALL SELECT 'https://supply' || (s_suppkey // 200) || '.example.com/s/' || s_suppkey, 0, '#detail', 'article',
          CAST(s_acctbal AS VARCHAR), 1, CAST(s_acctbal AS VARCHAR) FROM supplier WHERE s_acctbal BETWEEN 2000 AND 8000""",
    "d9_find_values": """WITH q AS (SELECT DISTINCT p_partkey // 200 AS page, p_name AS q FROM part),
        t AS (SELECT q.page, q, count(*) AS c, arg_min(p_name, p_partkey) AS f FROM q JOIN part
              ON p_partkey // 200 = q.page AND contains(p_name, q) GROUP BY ALL)
        SELECT page, upper(q) AS expected_value, 3 * c AS n, c AS n_alt,
        'h2.title' AS first_hint, f AS first_text FROM t""",
    "d9_find_indexed": """WITH q AS (SELECT DISTINCT p_partkey // 200 AS page, p_name AS q FROM part),
        t AS (SELECT q.page, q, count(*) AS c, arg_min(p_name, p_partkey) AS f FROM q JOIN part
              ON p_partkey // 200 = q.page AND contains(p_name, q) GROUP BY ALL)
        SELECT page, upper(q) AS expected_value, 3 * c AS n, c AS n_alt,
        'h2.title' AS first_hint, f AS first_text FROM t""",
    "d9_find_anywhere": """SELECT 'https://supply' || (s_suppkey // 200) || '.example.com/' AS url, upper(s_name) AS expected_value, 1 AS n,
        CASE WHEN s_acctbal < 2000 THEN 'span' ELSE 'a' END AS first_hint FROM supplier
        UNION ALL SELECT 'https://supply' || (s_suppkey // 200) || '.example.com/s/' || s_suppkey, upper(s_name), 2, 'title' FROM supplier
        WHERE s_acctbal BETWEEN 2000 AND 8000""",
    "d10_sanitize_html": f"""SELECT page_id, md5(regexp_replace(regexp_replace({_safe}, '(?i)\\s+on\\w+="[^"]*"', '', 'g'),
        '(?i)(<head[^>]*>)', '\\1<base href="' || url || '" target="_blank">')) AS digest FROM pages""",
    "d10_highlight": f"""SELECT page_id, true AS marked, strpos({_safe}, '<style>p{{') + length('<base href="' || url || '" target="_blank">')
        AS own_style_at FROM pages""",
    "x1_select": "SELECT * FROM (" + " UNION ALL ".join(
        [
            _list("below", f"len(regexp_extract_all({_article}, '<p[ >]'))"),
            _list("child", f"CASE WHEN {_article} LIKE '%<p>%' THEN 1 ELSE 0 END"),
            _list("path", _count("<a href")),
            _list("first", "CASE WHEN html LIKE '%<li>%' THEN 1 ELSE 0 END"),
            _list("later", _count("<li>") + " - 1"),
            _list("next", _count("<li>") + " - 1"),
            _list("third", f"CASE WHEN {_count('<li>')} >= 3 THEN 1 ELSE 0 END"),
            _list("class", "1"),
            _list("not", _count("<li>") + " - 1"),
            _list("list", "3"),
            _list("prefix", _count("<a href=\"/")),
            _list("word", "1"),
        ]
    ) + ") WHERE n > 0",
    "x1_nested_lists": """WITH s AS (SELECT 'https://supply' || (s_suppkey // 200) || '.example.com/' AS url, s_suppkey, s_acctbal < 2000 AS poor,
          lead(s_acctbal < 2000) OVER w AS next_poor, max(s_suppkey) FILTER (s_acctbal < 2000) OVER (PARTITION BY s_suppkey // 200) AS last_poor
          FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 200 ORDER BY s_suppkey)),
        c AS (SELECT 'https://shop' || (c_custkey // 500) || '.example.com/n/' || c_nationkey AS url, c_acctbal >= 0 AS rich FROM customer),
        p AS (SELECT p_partkey // 200 AS page, count(*) AS n FROM part GROUP BY ALL),
        t AS (SELECT url, 'poor' AS selector_id, count(*) FILTER (poor) AS n FROM s GROUP BY ALL
          UNION ALL SELECT url, 'either', count(*) FILTER (poor OR s_suppkey % 10 = 7) FROM s GROUP BY ALL
          UNION ALL SELECT url, 'before_poor', count(*) FILTER (next_poor) FROM s GROUP BY ALL
          UNION ALL SELECT url, 'some_poor_later', count(*) FILTER (s_suppkey < last_poor) FROM s GROUP BY ALL
          UNION ALL SELECT url, 'segment', count(*) FILTER (rich) FROM c GROUP BY ALL
          UNION ALL SELECT url, 'debt', count(*) FILTER (NOT rich) FROM c GROUP BY ALL
          UNION ALL SELECT 'https://parts.example.com/rows/' || page, 'table', 1 FROM p
          UNION ALL SELECT 'https://parts.example.com/cards/' || page, 'cards', n FROM p)
        SELECT * FROM t WHERE n > 0""",
    "x2_select_one": f"WITH {Q.LINKS} SELECT page_id, href, count(*) AS n FROM links GROUP BY ALL",
}
