"""Inputs of the queries: the given tables, pages rendered from them, and plans for those pages.

Rendered sites hold a bounded number of items each, so more data means more sites and not longer
pages. Parsed documents and scraped rows are computed once per session and shared by the queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.parse import parse_pages, spread_pages
from siteloom.operators.scrape import scrape
from siteloom.plans.model import LEVEL, NESTING, PLAN, make_field, make_level, make_struct
from siteloom.session import checkpoint_dir, keep
from siteloom.sources.pages import page_index, read_pages

CUSTOMERS_PER_SITE = 500
SUPPLIERS_PER_SITE = 200
PARTS_PER_PAGE = 200

_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries read: computed and saved at first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        rows = make()
        rows.write.parquet(path)
        _kept[key] = spark.read.schema(rows.schema).parquet(path)
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed ``pages`` table."""
    return once(spark, sf_dir, "docs", lambda: parse_pages(spread_pages(pages(spark, sf_dir))))


def _tag(name: str, body: Column | str, **attrs: Column | str) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    opening = [F.lit("<" + name)]
    for key, value in attrs.items():
        opening += [F.lit(f' {key.rstrip("_")}="'), as_column(value), F.lit('"')]
    return F.concat(*opening, F.lit(">"), as_column(body), F.lit(f"</{name}>"))


def _listed(order: str, item: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return F.array_join(F.transform(rows, lambda r: r["i"]), "\n")


def _page(heading: Column | str, body: Column) -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"),
        F.lit(heading) if isinstance(heading, str) else heading,
        F.lit('</title><script>var t="</li>";</script></head><body><header><p class="heading">'),
        F.lit(heading) if isinstance(heading, str) else heading,
        F.lit('</p><a href="/">home</a></header><main>'),
        body,
        F.lit('</main><footer><a href="mailto:x@example.com">mail</a></footer></body></html>'),
    )


def customer_pages(spark: SparkSession, sf_dir: str, shown: str = "true") -> DataFrame:
    """Shops of three levels: regions, their nations, the shop's customers of a nation. Only customers that are ``shown`` are listed."""
    customer = table(spark, sf_dir, "customer").where(shown).withColumn("site", F.expr(f"c_custkey div {CUSTOMERS_PER_SITE}"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    host = F.concat(F.lit("https://shop"), F.col("site"), F.lit(".example.com"))
    person = F.concat(
        F.lit('<li class="item">'),
        _tag("b", F.concat(F.lit(" "), F.col("c_name"), F.lit("\n")), class_="name"),
        F.when(F.col("c_acctbal") >= 0, _tag("i", F.col("c_mktsegment"), class_="segment")).otherwise(""),
        # the paragraph stays open, as in many captured pages
        F.concat(F.lit('<p class="balance" data-value="'), F.col("c_acctbal").cast("string"), F.lit('">balance')),
        F.lit("</li>"),
    )
    people = (
        customer.groupBy("site", F.col("c_nationkey").alias("key"))
        .agg(_listed("c_custkey", person).alias("body"))
        .select(
            F.concat(host, F.lit("/n/"), F.col("key")).alias("url"), _page("Customers", _tag("ul", F.col("body"))).alias("html")
        )
    )
    sites = customer.select("site").distinct()
    nation_item = _tag("li", F.concat(_tag("b", F.col("n_name"), class_="name"), _tag("a", "open", href=F.concat(F.lit("/n/"), F.col("n_nationkey")))), class_="item")
    nations = (
        nation.groupBy(F.col("n_regionkey").alias("key"))
        .agg(_listed("n_nationkey", nation_item).alias("body"))
        .select(F.col("key"), _page("Nations", _tag("ul", F.col("body"))).alias("html"))
    )
    region_item = _tag("li", _tag("a", F.col("r_name"), href=F.concat(F.lit("r/"), F.col("r_regionkey"), F.lit("/#top"))), class_="item")
    regions = region.agg(_listed("r_regionkey", region_item).alias("body")).select(
        F.lit(-1).alias("key"), _page("Regions", _tag("ul", F.col("body"))).alias("html")
    )
    # every shop has the same upper pages: one of the regions, and one for each region
    upper = nations.unionByName(regions)
    last = region.agg(F.coalesce(F.max("r_regionkey"), F.lit(-1))).first()[0]
    tops = (
        sites.withColumn("key", F.explode(F.sequence(F.lit(-1), F.lit(last))))
        .join(upper, "key")
        .select(
            F.concat(host, F.when(F.col("key") < 0, F.lit("/")).otherwise(F.concat(F.lit("/r/"), F.col("key")))).alias("url"),
            "html",
        )
    )
    return people.unionByName(tops)


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of suppliers; poor ones have no link, and the pages of rich ones are missing."""
    supplier = table(spark, sf_dir, "supplier").withColumn("site", F.expr(f"s_suppkey div {SUPPLIERS_PER_SITE}"))
    host = F.concat(F.lit("https://supply"), F.col("site"), F.lit(".example.com"))
    link = _tag("a", F.col("s_name"), href=F.concat(F.lit("/s/"), F.col("s_suppkey")))
    item = _tag("div", F.when(F.col("s_acctbal") < 2000, _tag("span", F.col("s_name"))).otherwise(link), class_="entry")
    lists = supplier.groupBy("site").agg(_listed("s_suppkey", item).alias("body")).select(
        F.concat(host, F.lit("/")).alias("url"), _page("Suppliers", F.col("body")).alias("html")
    )
    details = supplier.where("s_acctbal between 2000 and 8000").select(
        F.concat(host, F.lit("/s/"), F.col("s_suppkey")).alias("url"),
        _page(F.col("s_name"), _tag("article", _tag("dd", F.col("s_acctbal")), id="detail")).alias("html"),
    )
    return lists.unionByName(details)


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of parts, as cards and as table rows, with links that lead nowhere among them."""
    part = table(spark, sf_dir, "part").withColumn("page", F.expr(f"p_partkey div {PARTS_PER_PAGE}"))
    url = lambda kind: F.concat(F.lit("https://parts.example.com/" + kind + "/"), F.col("page"))
    href = F.concat(F.col("page"), F.lit("/part-"), F.col("p_partkey"))
    card = F.concat(
        F.lit('<div class="card '),
        F.translate(F.lower("p_brand"), "#", "-"),
        F.lit('"><h2 class="title">'),
        F.col("p_name"),
        F.lit('</h2><img src="/i/'),
        F.col("p_partkey").cast("string"),
        F.lit('.png" alt="'),
        F.col("p_name"),
        F.lit('"><span class="price">'),
        F.col("p_retailprice").cast("string"),
        F.lit('</span><a href="#card">top</a><a class="more" href="'),
        href,
        F.lit('">'),
        F.col("p_name"),
        F.lit('</a><a href="javascript:buy()">buy</a><a href="?page=2">next</a></div>'),
    )
    row = F.concat(
        F.lit('<tr class="row"><td>'), F.col("p_partkey").cast("string"), F.lit("</td><td>"), F.col("p_type"),
        F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr>"),
    )
    cards = part.groupBy("page").agg(_listed("p_partkey", card).alias("body")).select(
        url("cards").alias("url"), _page("Cards", F.col("body")).alias("html")
    )
    rows = part.groupBy("page").agg(_listed("p_partkey", row).alias("body")).select(
        url("rows").alias("url"), _page("Rows", _tag("table", F.col("body"))).alias("html")
    )
    return cards.unionByName(rows)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rendered pages, as a ``pages`` table."""
    rendered = (
        customer_pages(spark, sf_dir).unionByName(supplier_pages(spark, sf_dir)).unionByName(part_pages(spark, sf_dir))
    )
    return rendered.select(F.xxhash64("url").alias("page_id"), "url", "html")


def site_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "site_docs", lambda: parse_pages(spread_pages(keep(site_pages(spark, sf_dir)))))


def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "site_index", lambda: page_index(site_docs(spark, sf_dir)))


def _fields(*specs: tuple) -> Column:
    """Fields from ``(name, selector[, attribute[, container]])``."""
    made = []
    for name, selector, *rest in specs:
        attribute = rest[0] if rest else "text"
        container = rest[1] if len(rest) > 1 else None
        made.append(
            make_field(
                name=F.lit(name), selector=F.lit(selector), attribute=F.lit(attribute), container_selector=F.lit(container)
            )
        )
    return F.array(*made)


def make_levels(roots: DataFrame, specs: list[dict]) -> DataFrame:
    """Level plans of all ``roots`` (``plan_id, url``), one per entry of ``specs``."""
    entries = []
    for number, spec in enumerate(specs, start=1):
        entries.append(
            make_struct(
                "struct<level:int,level_name:string,sample_url:string,catalog_type:string,item_name:string,"
                "item_container_selector:string,is_final_level:boolean,drill_down_link_selector:string>",
                level=F.lit(number),
                level_name=F.lit(spec["type"]),
                sample_url=F.col("url") if number == 1 else F.lit(None),
                catalog_type=F.lit(spec["type"]),
                item_name=F.lit(spec["type"]),
                item_container_selector=F.lit(spec["item"]),
                is_final_level=F.lit(number == len(specs)),
                drill_down_link_selector=F.lit(spec.get("drill")),
            ).withField("fields", _fields(*spec["fields"]))
        )
    return roots.select("plan_id", F.inline(F.array(*entries)))


def customer_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.expr(f"c_custkey div {CUSTOMERS_PER_SITE}")
    return table(spark, sf_dir, "customer").select(site.alias("site")).distinct().select(
        F.concat(F.lit("shop"), F.col("site")).alias("plan_id"),
        F.concat(F.lit("http://SHOP"), F.col("site"), F.lit(".example.com")).alias("url"),
    )


CUSTOMER_LEVELS = [
    {"type": "region", "item": "main li.item", "fields": [("region", "a"), ("name", "a"), ("heading", "p", "text", "header")]},
    {"type": "nation", "item": "li.item", "drill": "a[href]", "fields": [("nation", "b.name"), ("name", ".name"), ("url", ".none")]},
    {"type": "customer", "item": "ul > li", "fields": [("name", "b"), ("segment", "i.segment"), ("balance", ".balance", "data-value")]},
]
SUPPLIER_LEVELS = [
    {"type": "supplier", "item": ".entry", "fields": [("name", "a, span"), ("balance", None)]},
    {"type": "detail", "item": "#detail", "fields": [("balance", "dd"), ("heading", ".heading", "text", "body")]},
]
CARD_LEVELS = [
    {
        "type": "card",
        "item": "div.card",
        "drill": "a.more",
        "fields": [
            ("title", "h2"), ("price", "span.price"), ("image", "img", "src"), ("brand", ":bad("), ("link_class", "a:nth-of-type(2)", "class"),
            ("heading", ".heading", "text", "header"), ("url", "a.none", "href"),
        ],
    },
    {"type": "part", "item": ".part", "fields": [("title", "h1")]},
]
ROW_LEVELS = [
    {
        "type": "row",
        "item": "table tr.row",
        "fields": [("key", "td:first-child"), ("kind", "td:nth-child(2)"), ("size", "td + td + td"), ("last", "td:last-child:not(.x)")],
    }
]


def customer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_levels(customer_roots(spark, sf_dir), CUSTOMER_LEVELS)


def supplier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "supplier").select(F.expr(f"s_suppkey div {SUPPLIERS_PER_SITE}").alias("site")).distinct()
    return make_levels(
        roots.select(
            F.concat(F.lit("supply"), F.col("site")).alias("plan_id"),
            F.concat(F.lit("https://supply"), F.col("site"), F.lit(".example.com/")).alias("url"),
        ),
        SUPPLIER_LEVELS,
    )


def part_levels(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    roots = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {PARTS_PER_PAGE}").alias("page")).distinct()
    return make_levels(
        roots.select(
            F.concat(F.lit(kind), F.col("page")).alias("plan_id"),
            F.concat(F.lit(f"https://parts.example.com/{kind}/"), F.col("page")).alias("url"),
        ),
        CARD_LEVELS if kind == "cards" else ROW_LEVELS,
    )


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark, sf_dir, "customer_rows",
        lambda: scrape(
            customer_levels(spark, sf_dir), site_docs(spark, sf_dir), index=site_index(spark, sf_dir)
        ).rows,
    )


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark, sf_dir, "supplier_rows",
        lambda: scrape(
            supplier_levels(spark, sf_dir), site_docs(spark, sf_dir), index=site_index(spark, sf_dir)
        ).rows,
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored plan per customer; those in debt have no levels yet."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    root = F.concat(F.lit("http://Host"), F.col("c_nationkey"), F.lit(".example.com/c/"), F.col("c_custkey"), F.lit("/"))
    kind = F.lower("c_mktsegment")
    poor = F.col("c_acctbal") < 3000
    first = make_level(
        level=F.lit(1), url=root, is_catalog=F.lit(True), catalog_type=kind, confidence=F.lit(0.9), archetype=F.lit("list"),
        item_name=F.col("n_name"), item_container_selector=F.lit(".item"),
        fields=F.array(
            make_field(name=F.lit("title"), selector=F.lit("h2")),
            make_field(name=F.lit("price"), selector=F.when(~poor, F.lit(".price")), required=F.col("c_acctbal") < 1000),
            make_field(name=F.lit("url"), selector=F.lit("a"), attribute=F.lit("href")),
        ),
        nesting_analysis=make_struct(NESTING, is_final_level=F.lit(False), drill_down_link_selector=F.lit("a.more")),
    )
    second = make_level(
        level=F.lit(2), url=F.concat(root, F.lit("1")), is_catalog=F.lit(True),
        catalog_type=F.when(F.col("n_regionkey") < 2, kind).when(F.col("n_regionkey") < 4, F.lit("Detail Page!")),
        item_name=F.when(F.col("n_regionkey") != 1, F.concat(F.lit("item "), F.col("n_name"))),
        item_container_selector=F.when(F.col("n_regionkey") != 3, F.lit("#main")),
        fields=F.array(
            make_field(name=F.lit("title"), selector=F.lit("h1"), container_selector=F.lit("header")),
            make_field(name=F.lit("note"), selector=F.when(F.col("c_acctbal") < 8000, F.lit(".note"))),
        ),
    )
    chain = F.when(F.col("c_acctbal") >= 0, F.array(first, second)).otherwise(F.array().cast(f"array<{LEVEL}>"))
    values = {
        "id": F.concat(F.lit("plan-"), F.col("c_custkey")),
        "root_url": root,
        "item_name": F.col("n_name"),
        "nesting_depth": F.size(chain),
        "level_names": F.transform(chain, lambda s: F.coalesce(s["catalog_type"], F.concat(F.lit("level_"), s["level"]))),
        "schema_chain": chain,
        "visited_urls": F.array(root),
        "created_at": F.lit("2026-01-01T00:00:00"),
        "updated_at": F.lit("2026-01-02T00:00:00"),
    }
    return rows.select(make_struct(f"struct<{PLAN}>", **values).alias("p")).select("p.*")

