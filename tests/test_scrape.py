"""Extraction and scraping on a small site that holds every trap."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import extract, quality, scrape as scraping, skew
from siteloom.operators.parse import parse_pages
from siteloom.operators.scrape import first_rows, sample, scrape
from siteloom.plans.extraction import apply_field_fixes, check_sample, fix_and_resample
from siteloom.plans.model import LEVEL_PLAN
from siteloom.session import keep
from siteloom.sources.pages import page_index
from siteloom.sources.sinks import column_union

FIELD = ("string", False, "")


def field(name, selector, attribute="text", container=None):
    return (name, *FIELD, container, selector, attribute, None)


def level(plan, number, url, item, final, fields, drill=None, kind=None):
    return (plan, number, f"level_{number}", url, kind, None, item, final, drill, fields)


@pytest.fixture(scope="module")
def site(spark, docs_of):
    page = lambda body: f"<html><body><h1 class=h>Head</h1>{body}</body></html>"
    docs = docs_of(
        ("http://s.com/", page(
            '<ul><li class=item><a href="/r/1"> R 1 </a><i>n1</i></li><li class=item><b>nolink</b></li><li class=item><a href="r/2#x">R2</a></li>'
            '<li class=item><a href="/r/9">R9</a></li><li class=item><a href="#no">x</a><a href="/r/1">y</a></li>'
            '<li class=item><a href="/r/1">again</a></li></ul>')),
        ("https://s.com/r/1", page('<div class=p><h2 title=T>A</h2><p>x<p>y</div><div class=p><h2>B</h2></div>')),
        ("https://s.com/r/2/", page('<div class=p><h2 title="C c"></h2></div>')),
        ("https://t.com/", page('<a class=card href="/q">k<b>1</b></a><a class=card href="mailto:x">m</a>')),
    )
    levels = spark.createDataFrame(
        [
            level("P", 1, "http://s.com", "li.item", False, [
                field("region", "a"), field("note", "i"), field("url", "zz"), field("head", "*", container="h1"),
                field("hh", "h1.h", "class", "body"), field("bad", ":nope(", "text"), field("region", "a")]),
            level("P", 2, None, "div.p", True, [field("title", "h2"), field("note", "h2", "title"), field("txt", "p"), field("none", None)]),
            level("Q", 1, "https://t.com/", "a.card", False, [field("name", "b")]),
            level("Q", 2, None, ".x", True, []),
        ],
        LEVEL_PLAN,
    )
    return levels, docs


def fields_of(rows):
    return [(r.plan_id, r.level, r.fields) for r in rows.orderBy("plan_id", "order_key").collect()]


EXPECTED = [
    ("P", 2, {"region": "R 1", "url": "http://s.com/r/1", "hh": "h", "title": "A", "note": "T", "txt": "x y"}),
    ("P", 2, {"region": "R 1", "url": "http://s.com/r/1", "hh": "h", "title": "B"}),
    ("P", 1, {"hh": "h"}),
    ("P", 2, {"region": "R2", "url": "http://s.com/r/2#x", "hh": "h", "title": "", "note": "C c"}),
    ("P", 1, {"region": "x", "hh": "h"}),
    ("P", 2, {"region": "again", "url": "http://s.com/r/1", "hh": "h", "title": "A", "note": "T", "txt": "x y"}),
    ("P", 2, {"region": "again", "url": "http://s.com/r/1", "hh": "h", "title": "B"}),
    ("Q", 1, {}),
]


def filled(rows):
    return [(p, n, {k: v for k, v in f.items() if v is not None}) for p, n, f in rows]


def test_rows_in_depth_first_order(site):
    levels, docs = site
    result = scrape(levels, docs)
    rows = fields_of(result.rows)
    assert filled(rows) == EXPECTED
    # keys keep the order of levels and fields, and a child's null replaces the parent's value
    keys = result.rows.orderBy("plan_id", "order_key").select(F.map_keys("fields").alias("k")).collect()[1].k
    assert keys == ["region", "note", "url", "head", "hh", "bad", "title", "txt", "none"]
    assert rows[1][2]["note"] is None
    assert sorted((r.plan_id, r.url) for r in result.missing.collect()) == [("P", "http://s.com/r/9"), ("Q", "https://t.com/q")]


def test_measures_against_uneven_keys_change_nothing(site, monkeypatch):
    levels, docs = site
    monkeypatch.setattr(extract, "_TASKS_PER_PART", 1)
    monkeypatch.setattr(skew, "HOT_KEYS", 1)
    monkeypatch.setattr(skew, "SALTS", 3)
    assert filled(fields_of(scrape(levels, docs).rows)) == EXPECTED


def test_target_level_item_cap_and_given_index(site):
    levels, docs = site
    rows = fields_of(scrape(levels, docs, target_level=1, max_items=2, index=page_index(docs)).rows)
    assert filled(rows) == [
        ("P", 1, {"region": "R 1", "note": "n1", "url": "http://s.com/r/1", "hh": "h"}), ("P", 1, {"hh": "h"}), ("Q", 1, {"name": "1"}), ("Q", 1, {}),
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 50])
def test_sample_is_a_prefix(site, n):
    levels, docs = site
    got = [(r.plan_id, r.row, r.fields) for r in sample(levels, docs, n).orderBy("plan_id", "row").collect()]
    want = [(r.plan_id, r.row, r.fields) for r in first_rows(scrape(levels, docs).rows, n).orderBy("plan_id", "row").collect()]
    assert got == want


def test_long_plans_are_ranked_in_buckets(spark, monkeypatch):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, "big").otherwise("small").alias("plan_id"), F.array((F.col("id") * 7 % 5000).cast("int")).alias("order_key")
    )
    plain = first_rows(rows, 50).orderBy("plan_id", "row").collect()
    assert first_rows(rows, 50).orderBy("plan_id", "row").select("plan_id", "order_key", "row").collect() == [
        (r.plan_id, r.order_key, r.row) for r in plain
    ]


def test_checks_before_sampling(site, spark):
    levels, _ = site
    assert check_sample(levels).count() == 0
    assert [r.error for r in check_sample(levels, 3).where("plan_id = 'P'").collect()] == ["Invalid target level 3. Valid range: 1-2"]
    broken = levels.withColumn("item_container_selector", F.when(F.col("level") == 1, F.col("item_container_selector")))
    errors = check_sample(broken).where("plan_id = 'P'").orderBy("pos").collect()
    assert [r.error for r in errors][0] == "Missing item_container_selector for: Level 2" and len(errors) == 2


def test_null_rates_exactly_half_is_fine(spark):
    data = [("P", {"a": None, "b": "", "c": "x", "d": "y"}), ("P", {"a": None, "b": "v", "c": "x"}), ("P", {"b": "v", "d": None}), ("P", {"b": None, "d": ""})]
    rows = spark.createDataFrame(data, "plan_id string, fields map<string,string>")
    names = spark.createDataFrame([("P", i, n) for i, n in enumerate("abcd")] + [("Z", 0, "a")], "plan_id string, pos int, name string")
    rates = quality.null_rates(rows, names)
    issues = {(r.plan_id, r.issue) for r in quality.null_issues(rates).collect()}
    assert issues == {("P", "Field 'a' is empty in all rows"), ("P", "Field 'd' is empty in 3/4 rows"), ("Z", "No data extracted")}
    counts = quality.row_and_column_counts(rows).first()
    assert (counts.total_rows, counts.total_columns) == (4, 4)


def test_column_union(spark):
    data = [("P", [2], {"c": "1", "a": "1"}), ("P", [1, 3], {"b": "1", "a": "2"}), ("E", [1], {})]
    rows = spark.createDataFrame(data, "plan_id string, order_key array<int>, fields map<string,string>")
    got = [(r.plan_id, r.name) for r in column_union(rows, ("z", "a")).orderBy("plan_id", "pos").collect()]
    assert got == [("E", "z"), ("E", "a"), ("P", "z"), ("P", "a"), ("P", "b"), ("P", "c")]


def test_fix_and_resample(site, spark):
    levels, docs = site
    schema = "plan_id string, seq int, field string, container_selector string, selector string, attribute string, clear_container boolean"
    fixes = spark.createDataFrame([("P", 1, "hh", None, "a", "href", True), ("P", 2, "txt", None, "h2", None, None), ("P", 3, "gone", None, "x", None, None)], schema)
    fixed, rows, decisions = fix_and_resample(levels, fixes, docs)
    hh = fixed.select("plan_id", F.explode("fields").alias("f")).where("f.name = 'hh'").first().f
    assert (hh.container_selector, hh.selector, hh.attribute) == (None, "a", "href")
    first = rows.where("plan_id = 'P' and row = 1").first().fields
    assert (first["hh"], first["txt"]) == ("/r/1", "A")
    issues = decisions.where("plan_id = 'P'").first()
    assert "Field 'head' is empty in all rows" in issues.issues and len(issues.sample_rows) == 3
    # a null keeps what is there
    kept = apply_field_fixes(levels, fixes.withColumn("clear_container", F.lit(None).cast("boolean")))
    hh = kept.select(F.explode("fields").alias("f")).where("f.name = 'hh'").first().f
    assert hh.container_selector == "body"


def _shop(rng, n):
    """A list page and its detail pages; some links lead nowhere."""
    cards = "".join(f'<li class=c><b>{rng.randint(0, 99)}</b><a href="/d/{i}">x</a></li>' for i in range(n))
    pages = {"http://s.com/": f"<ul>{cards}</ul>"}
    for i in range(n):
        if rng.random() < 0.9:
            pages[f"http://s.com/d/{i}"] = "".join(f"<p class=r>{rng.randint(0, 99)}</p>" for _ in range(rng.randint(0, 3)))
    return pages


def test_a_second_run_reads_changed_pages_only(spark):
    rng = random.Random(4)
    plan = lambda top: spark.createDataFrame(
        [level("P", 1, "http://s.com/", "li.c", False, [field("v", top)]), level("P", 2, None, "p.r", True, [field("w", None)])], LEVEL_PLAN
    )
    levels = plan("b")
    pages, known, seen = _shop(rng, 12), None, {}
    for run in range(3):
        table = spark.createDataFrame([(hash(u) % 10**9, u, h) for u, h in pages.items()], "page_id long, url string, html string")
        docs, digests = keep(parse_pages(table)), table.select("page_id", F.md5("html").alias("digest"))
        # pages that have not changed are not even there to be read
        changed = [u for u, h in pages.items() if seen.get(u) != h]
        assert run == 0 or len(changed) < len(pages) / 2
        again = scrape(levels, docs.where(F.col("url").isin(changed)), index=page_index(docs), digests=digests, known=known)
        assert fields_of(again.rows) == fields_of(scrape(levels, docs).rows)
        known, seen = keep(again.items), dict(pages)
        fresh = _shop(rng, 14)
        pages = {**pages, **dict(rng.sample(sorted(fresh.items()), 4))}
    # a changed level is read anew
    wider = plan("a")
    docs = keep(parse_pages(spark.createDataFrame([(hash(u) % 10**9, u, h) for u, h in seen.items()], "page_id long, url string, html string")))
    assert {r[2]["v"] for r in fields_of(scrape(wider, docs, digests=digests, known=known).rows)} == {"x"}


def test_a_sample_reads_no_page_twice(site, monkeypatch):
    levels, docs = site
    read = []
    extract_items = scraping.extract_items
    monkeypatch.setattr(
        scraping, "extract_items", lambda tasks, pages, sizes: (read.extend((r.plan_id, r.url) for r in tasks.select("plan_id", "url").collect()), extract_items(tasks, pages, sizes))[1]
    )
    assert sample(levels, docs, 3).count() > 3
    assert len(read) == len(set(read)) > 3


def test_more_pages_are_matched_by_more_tasks(spark, docs_of, monkeypatch):
    docs = docs_of(*[f"<ul><li>{i}a<li>{i}b</ul>" for i in range(40)])
    levels = spark.createDataFrame([level(f"P{i}", 1, f"https://h.com/{i}", "li", True, [field("v", "*", container="li")]) for i in range(0, 40, 2)], LEVEL_PLAN)
    compiled = extract.compile_levels(levels)
    pages = scraping.lookup(compiled.select("plan_id", F.col("sample_url").alias("url")), page_index(docs))
    tasks = keep(extract.split_tasks(pages).join(compiled.drop("level", "sample_url"), "plan_id"))
    monkeypatch.setattr(skew, "PAGES_PER_TASK", 1)
    rows = extract.extract_items(tasks, docs, (1, 1, 0)).select("plan_id", "item", "fields", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 40 and len({r.task for r in rows}) > 4
    monkeypatch.setattr(skew, "NAMED_PAGES", 0)
    joined = extract.extract_items(tasks, docs, (1, 1, 0)).select("plan_id", "item", "fields").collect()
    assert sorted(joined) == sorted(r[:3] for r in rows)


def joins_on(plan, key, kind):
    """Joins of a kind on a column; plans are those that Spark makes from what the files tell."""
    return [line for line in plan._jdf.queryExecution().sparkPlan().toString().splitlines() if kind in line and f"{key}#" in line.split("]")[0]]


@pytest.fixture
def parts(spark, tmp_path, monkeypatch, docs_of):
    """A folder with a table of five parts that are shown on three pages; the tasks that are handed on to be extracted."""
    from siteloom.queries import inputs, scraping as queries

    spark.createDataFrame([(k,) for k in (1, 2, 200, 201, 400)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    row = "<tr class=row><td>1<td>2<td>3</tr>"
    page = lambda kind, i, body: (f"https://parts.example.com/{kind}/{i}", body)
    docs = docs_of(*[page("rows", i, f"<table>{row}</table>") for i in range(3)], *[page("cards", i, "<div class=card><h2>x</h2></div>") for i in range(3)])
    monkeypatch.setattr(inputs, "site_docs", lambda *_: docs)
    monkeypatch.setattr(inputs, "site_index", lambda *_: page_index(docs))
    tasks, extract_items = [], extract.extract_items
    for module in (extract, queries):
        monkeypatch.setattr(module, "extract_items", lambda t, d, sizes: tasks.append(t) or extract_items(t, d, sizes))
    return str(tmp_path), tasks


def test_levels_of_field_values_are_not_broadcast(spark, parts):
    from siteloom.queries.scraping import x3_field_values

    folder, tasks = parts
    assert [r.plan_id for r in x3_field_values(spark, folder).orderBy("plan_id").collect()] == ["rows0", "rows1", "rows2"]
    assert len(tasks) == 1 and joins_on(tasks[0], "salt", "SortMergeJoin") and not joins_on(tasks[0], "salt", "Broadcast")


def test_compiled_levels_are_not_broadcast(site):
    compiled = extract.compile_levels(keep(site[0]))
    assert joins_on(compiled, "level", "SortMergeJoin") and not joins_on(compiled, "level", "Broadcast")


def test_levels_of_sample_values_are_not_broadcast(spark, parts):
    from siteloom.queries.scraping import x11_sample_values

    folder, tasks = parts
    got = x11_sample_values(spark, folder).orderBy("plan_id").collect()
    assert got == [(f"cards{i}", "title", "x") for i in range(3)]
    assert len(tasks) == 2 and all(joins_on(t, "salt", "SortMergeJoin") and not joins_on(t, "salt", "Broadcast") for t in tasks)
