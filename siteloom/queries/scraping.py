"""Queries on extraction, scraping, quality and results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteloom.operators import quality
from siteloom.operators.extract import compile_levels, extract_items, sample_values, split_tasks, with_levels
from siteloom.operators.parse import parse_pages, spread_pages
from siteloom.operators.scrape import first_rows, sample, scrape
from siteloom.operators.select import steps_sizes
from siteloom.plans.extraction import check_sample
from siteloom.queries import inputs as I
from siteloom.queries import sql as Q
from siteloom.session import checkpoint_dir, keep
from siteloom.sources import sinks
from siteloom.sources.pages import lookup, page_index
from siteloom.streaming.items import current_items, stream_items

_SHOP_FIELDS = ["region", "heading", "nation", "url", "name", "segment", "balance"]


def _wide(rows, names, *keep_columns):
    return sinks.widen(rows.select("plan_id", *keep_columns, "fields"), names)


def _items(spark, sf, kind):
    """Items of the part pages, through the steps that a scrape takes for one level."""
    compiled = keep(compile_levels(I.part_levels(spark, sf, kind).where("level = 1")))
    pages = lookup(compiled.select("plan_id", F.col("sample_url").alias("url")), I.site_index(spark, sf))
    tasks = with_levels(split_tasks(pages), compiled.drop("level", "sample_url"))
    return extract_items(tasks, I.site_docs(spark, sf), steps_sizes(compiled))


def x3_field_values(spark, sf):
    return _wide(_items(spark, sf, "rows"), ["key", "kind", "size", "last"])


def x4_items(spark, sf):
    return _wide(_items(spark, sf, "cards"), ["title", "price", "image", "brand", "link_class", "heading", "url"])


def x4_stream_items(spark, sf):
    """The items of x4_items from a stream: an outdated capture of every page, then the pages, some of them twice."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/captures-{uuid.uuid4().hex}"
    # the files, and with them the batches, are as many at every size of the tables; batches are dealt out when they are parsed
    pages = keep(I.part_pages(spark, sf).where("url like '%/cards/%'").select(F.xxhash64("url").alias("page_id"), "url", "html")).repartition(4)
    at = lambda rows, day: rows.withColumn("captured_at", F.to_timestamp(F.lit(f"2026-01-{day:02d}")))
    at(pages, 2).write.parquet(f"{base}/pages/b")
    at(pages.withColumn("html", F.replace("html", F.lit("title"), F.lit("old"))), 1).write.parquet(f"{base}/pages/c")
    at(pages.where("page_id % 2 = 0"), 2).write.parquet(f"{base}/pages/d")
    levels = I.part_levels(spark, sf, "cards").where("level = 1")
    stream_items(spark, levels, f"{base}/pages/*", f"{base}/items", f"{base}/state", "2 days", files_per_batch=2).awaitTermination()
    return _wide(current_items(spark, f"{base}/items"), ["title", "price", "image", "brand", "link_class", "heading", "url"])


def x5_drill_urls(spark, sf):
    return _items(spark, sf, "cards").select("plan_id", "drill_url")


def x6_scrape_round_trip(spark, sf):
    return _wide(I.customer_rows(spark, sf), _SHOP_FIELDS)


def x6_scrape_again(spark, sf):
    """A run over earlier pages, on which some nations miss customers, and one over those that have changed since."""
    dated = lambda pages: pages.select(F.xxhash64("url").alias("page_id"), "url", "html", F.md5("html").alias("digest"))
    old = keep(dated(I.customer_pages(spark, sf, "c_nationkey % 5 > 0 or c_custkey % 3 > 0")))
    new = keep(dated(I.customer_pages(spark, sf)))
    levels = I.customer_levels(spark, sf)
    before = keep(parse_pages(spread_pages(old)))
    first = scrape(levels, before, index=page_index(before), digests=old.select("page_id", "digest"))
    known = keep(first.items)
    changed = keep(new.join(old, ["page_id", "digest"], "left_anti"))
    again = scrape(
        levels, keep(parse_pages(spread_pages(changed))), index=page_index(new), digests=new.select("page_id", "digest"), known=known
    )
    return _wide(again.rows, _SHOP_FIELDS)


def x6_partial_rows(spark, sf):
    return _wide(I.supplier_rows(spark, sf), ["name", "balance", "heading"], "level")


def x6_missing_pages(spark, sf):
    levels, docs = I.supplier_levels(spark, sf), I.site_docs(spark, sf)
    lost = scrape(levels, docs, index=I.site_index(spark, sf)).missing
    return lost.select("plan_id", "level", "url", "error")


def x7_sample(spark, sf):
    rows = sample(I.customer_levels(spark, sf), I.site_docs(spark, sf), 3, index=I.site_index(spark, sf))
    return _wide(rows, _SHOP_FIELDS, "row")


def x7_sample_checks(spark, sf):
    return check_sample(I.customer_levels(spark, sf), 9)


def x8_scrape_with_limit(spark, sf):
    rows = first_rows(I.customer_rows(spark, sf), 100)
    return _wide(rows, ["name", "balance"], "row")


def x8_scrape_to_level(spark, sf):
    levels, docs = I.customer_levels(spark, sf), I.site_docs(spark, sf)
    rows = scrape(levels, docs, target_level=2, index=I.site_index(spark, sf)).rows
    return _wide(rows, ["region", "nation", "name", "url"], "level")


def x9_items_per_page(spark, sf):
    levels, docs = I.customer_levels(spark, sf), I.site_docs(spark, sf)
    rows = scrape(levels, docs, max_items=2, index=I.site_index(spark, sf)).rows
    return _wide(rows, ["region", "nation", "name"])


def x10_field_names(spark, sf):
    return quality.field_names(I.customer_levels(spark, sf))


def x11_sample_values(spark, sf):
    cards = I.part_levels(spark, sf, "cards").where("level = 1").withColumn("is_catalog", F.lit(True))
    return sample_values(cards, I.site_docs(spark, sf), I.site_index(spark, sf)).select("plan_id", "name", "sample_value")


def x11_sample_values_detail(spark, sf):
    pages = I.supplier_pages(spark, sf).where("url like '%/s/%'").select(F.col("url").alias("plan_id"), "url")
    levels = I.make_levels(pages, I.SUPPLIER_LEVELS[1:]).withColumn("is_catalog", F.lit(False))
    rows = sample_values(levels, I.site_docs(spark, sf), I.site_index(spark, sf))
    return rows.select("plan_id", "name", "sample_value")


def q1_null_rates(spark, sf):
    names = quality.field_names(I.customer_levels(spark, sf))
    return quality.null_rates(I.customer_rows(spark, sf), names).select("plan_id", "name", "empty", "total")


def q1_null_issues(spark, sf):
    """Rows of customers by nation and segment, with a field that is often empty and one that always is."""
    customer = I.table(spark, sf, "customer")
    value = {"name": F.col("c_name"), "low": F.when(F.col("c_acctbal") < 4500, F.col("c_name")).otherwise(""), "none": F.lit(None).cast("string")}
    rows = customer.select(
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("plan_id"),
        F.create_map(*[c for name, column in value.items() for c in (F.lit(name), column)]).alias("fields"),
    )
    names = rows.select("plan_id").distinct().select("plan_id", F.posexplode(F.array(*map(F.lit, value))).alias("pos", "name"))
    return quality.null_issues(quality.null_rates(rows, names)).select("plan_id", "issue")


def q1_fix_decisions(spark, sf):
    """The cards have a field whose selector can match nothing."""
    levels = I.part_levels(spark, sf, "cards").where("level = 1")
    rows = scrape(levels, I.site_docs(spark, sf), index=I.site_index(spark, sf)).rows
    found = quality.fix_decisions(first_rows(rows, 3), quality.field_names(levels))
    return found.select(
        "plan_id", "decision", F.array_join("options", ",").alias("options"), F.array_join("issues", "; ").alias("issues"),
        F.array_join("field_names", ",").alias("field_names"), F.size("sample_rows").alias("n_rows"),
    )


def q3_counts(spark, sf):
    return quality.row_and_column_counts(I.customer_rows(spark, sf))


def _noted(spark, sf):
    note = F.concat(F.col("name"), F.lit(', "'), F.coalesce("segment", F.lit("none")), F.lit('"'))
    return x6_scrape_round_trip(spark, sf).select("plan_id", "name", "segment", note.alias("note"))


def k3_csv_export(spark, sf):
    folder = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4()}"
    sinks.write_csv(_noted(spark, sf), folder)
    lines = spark.read.text(folder).where("value <> 'plan_id,name,segment,note'")
    return lines.select(F.col("value").alias("line"))


def k3_csv_lines(spark, sf):
    rows = _noted(spark, sf)
    return rows.select(sinks.csv_lines(rows, rows.columns).alias("line"))


def k4_json_export(spark, sf):
    folder = f"{checkpoint_dir(spark)}/json-{uuid.uuid4()}"
    sinks.write_json(_noted(spark, sf), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def k5_column_union(spark, sf):
    return sinks.column_union(I.supplier_rows(spark, sf), preferred=("balance",))


QUERIES = {
    f.__name__: f
    for f in (
        x3_field_values, x4_items, x4_stream_items, x5_drill_urls, x6_scrape_round_trip, x6_scrape_again, x6_partial_rows, x6_missing_pages, x7_sample,
        x7_sample_checks, x8_scrape_with_limit, x8_scrape_to_level, x9_items_per_page, x10_field_names, x11_sample_values,
        x11_sample_values_detail, q1_null_rates, q1_null_issues, q1_fix_decisions, q3_counts, k3_csv_export, k3_csv_lines,
        k4_json_export, k5_column_union,
    )
}

_SHOP = "plan_id, region, 'Regions' AS heading, nation, url, name, segment, balance"
_CSV = """name || ',' || coalesce(segment, '') || ',"' || name || ', ""' || coalesce(segment, 'none') || '\"\""' """
_RANKED = f"""WITH {Q.SHOPS}, r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY r_regionkey, n_nationkey, c_custkey)
    AS row FROM shops)"""

SQL = {
    "x3_field_values": """SELECT 'rows' || (p_partkey // 200) AS plan_id, CAST(p_partkey AS VARCHAR) AS key, p_type AS kind,
        CAST(p_size AS VARCHAR) AS size, CAST(p_size AS VARCHAR) AS last FROM part""",
    "x4_items": """SELECT 'cards' || (p_partkey // 200) AS plan_id, p_name AS title, CAST(p_retailprice AS VARCHAR) AS price,
        '/i/' || p_partkey || '.png' AS image, CAST(NULL AS VARCHAR) AS brand, 'more' AS link_class, 'Cards' AS heading,
        'https://parts.example.com/cards/' || (p_partkey // 200) || '/part-' || p_partkey AS url FROM part""",
    "x4_stream_items": """SELECT 'cards' || (p_partkey // 200) AS plan_id, p_name AS title, CAST(p_retailprice AS VARCHAR) AS price,
        '/i/' || p_partkey || '.png' AS image, CAST(NULL AS VARCHAR) AS brand, 'more' AS link_class, 'Cards' AS heading,
        'https://parts.example.com/cards/' || (p_partkey // 200) || '/part-' || p_partkey AS url FROM part""",
    "x5_drill_urls": """SELECT 'cards' || (p_partkey // 200) AS plan_id,
        'https://parts.example.com/cards/' || (p_partkey // 200) || '/part-' || p_partkey AS drill_url FROM part""",
    "x6_scrape_round_trip": f"WITH {Q.SHOPS} SELECT {_SHOP} FROM shops",
    "x6_scrape_again": f"WITH {Q.SHOPS} SELECT {_SHOP} FROM shops",
    "x6_partial_rows": f"""WITH {Q.SUPPLIERS} SELECT plan_id, CASE WHEN poor THEN 1 ELSE 2 END AS level, name, balance, heading
        FROM supplies WHERE s_acctbal <= 8000""",
    "x6_missing_pages": f"""WITH {Q.SUPPLIERS} SELECT plan_id, 2 AS level, 'https://' || plan_id || '.example.com/s/' || s_suppkey AS url,
        'missing page' AS error FROM supplies WHERE s_acctbal > 8000""",
    "x7_sample": f"{_RANKED} SELECT row, {_SHOP} FROM r WHERE row <= 3",
    "x7_sample_checks": """SELECT DISTINCT 'shop' || (c_custkey // 500) AS plan_id, 0 AS pos,
        'Invalid target level 9. Valid range: 1-3' AS error FROM customer""",
    "x8_scrape_with_limit": f"{_RANKED} SELECT plan_id, row, name, balance FROM r WHERE row <= 100",
    "x8_scrape_to_level": """SELECT 'shop' || site AS plan_id, 2 AS level, r_name AS region, n_name AS nation, n_name AS name,
        'http://SHOP' || site || '.example.com/n/' || n_nationkey AS url
        FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT DISTINCT c_custkey // 500 AS site FROM customer)""",
    "x9_items_per_page": f"""WITH {Q.SHOPS}, n AS (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nr,
          row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS x FROM nation),
        r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS rr FROM region),
        c AS (SELECT *, row_number() OVER (PARTITION BY plan_id, n_nationkey ORDER BY c_custkey) AS cr FROM shops)
        SELECT plan_id, region, nation, name FROM c JOIN n USING (n_nationkey) JOIN r USING (r_regionkey)
        WHERE cr <= 2 AND nr <= 2 AND rr <= 2""",
    "x10_field_names": """SELECT DISTINCT 'shop' || (c_custkey // 500) AS plan_id, pos, name FROM customer,
        (VALUES (0, 'region'), (1, 'name'), (2, 'heading'), (3, 'nation'), (4, 'url'), (5, 'segment'), (6, 'balance')) t(pos, name)""",
    "x11_sample_values": """WITH f AS (SELECT *, p_partkey // 200 AS page FROM part
          QUALIFY row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) = 1)
        SELECT 'cards' || page AS plan_id, n AS name, v AS sample_value FROM (SELECT page,
          unnest(['title', 'price', 'image', 'link_class', 'heading']) AS n,
          unnest([p_name, CAST(p_retailprice AS VARCHAR), '/i/' || p_partkey || '.png', 'more', 'Cards']) AS v FROM f)""",
    "x11_sample_values_detail": f"""WITH {Q.SUPPLIERS} SELECT 'https://' || plan_id || '.example.com/s/' || s_suppkey AS plan_id,
        unnest(['balance', 'heading']) AS name, unnest([balance, heading]) AS sample_value
        FROM supplies WHERE s_acctbal BETWEEN 2000 AND 8000""",
    "q1_null_rates": f"""WITH {Q.SHOPS}, t AS (SELECT plan_id, count(*) AS total, count(*) - count(segment) AS missing FROM shops GROUP BY 1)
        SELECT plan_id, name, CASE name WHEN 'segment' THEN missing ELSE 0 END AS empty, total FROM t,
        (VALUES ('region'), ('name'), ('heading'), ('nation'), ('url'), ('segment'), ('balance')) v(name)""",
    "q1_null_issues": """WITH t AS (SELECT c_mktsegment || '-' || c_nationkey AS plan_id, count(*) AS total,
          count(*) FILTER (c_acctbal >= 4500) AS e FROM customer GROUP BY 1)
        SELECT plan_id, 'Field ''low'' is empty in ' || CASE WHEN e = total THEN 'all' ELSE e || '/' || total END || ' rows' AS issue
          FROM t WHERE e > total * 0.5
        UNION ALL SELECT plan_id, 'Field ''none'' is empty in all rows' FROM t""",
    "q1_fix_decisions": """SELECT 'cards' || (p_partkey // 200) AS plan_id, 'fix_field' AS decision, 'fix,skip' AS options,
        'Field ''brand'' is empty in all rows' AS issues, 'title,price,image,brand,link_class,heading,url' AS field_names,
        least(count(*), 3) AS n_rows FROM part GROUP BY p_partkey // 200""",
    "q3_counts": f"WITH {Q.SHOPS} SELECT plan_id, count(*) AS total_rows, 7 AS total_columns FROM shops GROUP BY 1",
    "k3_csv_export": f"WITH {Q.SHOPS} SELECT plan_id || ',' || {_CSV} AS line FROM shops",
    "k3_csv_lines": f"WITH {Q.SHOPS} SELECT plan_id || ',' || {_CSV} AS line FROM shops",
    "k4_json_export": f"""WITH {Q.SHOPS} SELECT '{{"plan_id":"' || plan_id || '","name":"' || name || '","segment":' ||
        coalesce('"' || segment || '"', 'null') || ',"note":"' || name || ', \\"' || coalesce(segment, 'none') || '\\""}}' AS line FROM shops""",
    "k5_column_union": f"""WITH {Q.SUPPLIERS} SELECT DISTINCT plan_id, pos, name FROM (SELECT DISTINCT plan_id, poor FROM supplies
        WHERE s_acctbal <= 8000) t, (VALUES (0, 'balance', true), (1, 'name', true), (2, 'heading', false)) v(pos, name, always)
        WHERE always OR NOT poor""",
}
