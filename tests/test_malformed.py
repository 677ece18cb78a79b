"""Malformed input: it is told apart, harms nothing else, and costs no more than good input."""

import glob
import time

from pyspark.sql import functions as F

from siteloom.exchange.responses import parse_responses
from siteloom.operators.errors import request_errors, run_errors
from siteloom.operators.parse import parse_pages
from siteloom.operators.scrape import scrape
from siteloom.plans.discovery import _latest
from siteloom.plans.model import FIELD, NESTING
from siteloom.sources.pages import page_index
from siteloom.sources.sinks import upsert_plans, write_csv


def test_answers_that_are_no_objects(spark):
    raws = {
        "object": '{"is_final_level": true, "reasoning": "r"}', "empty": "{}", "array": "[1, 2]", "text": '"text"', "null": "null", "number": "3",
        "broken": "{", "nothing": "", "type": '{"is_final_level": {"a": 1}}', "list": '{"ranked_candidates": "none"}', "nulls": '{"is_final_level": null}',
        "fenced": '```json\n{"is_final_level": false}\n```', "blank": "  ",
    }
    rows = parse_responses(spark.createDataFrame(list(raws.items()), "id string, raw string"), "nesting").collect()
    errors = {r.id: (r.error or "").split(":")[0] for r in rows}
    assert errors == {
        "object": "", "empty": "", "nulls": "", "fenced": "", "array": "no JSON object", "text": "no JSON object", "null": "no JSON object",
        "number": "no JSON object", "broken": "invalid JSON", "nothing": "empty response", "blank": "invalid JSON", "type": "wrong type", "list": "wrong type",
    }
    assert {r.id for r in rows if r.body is not None} == {"object", "empty", "nulls", "fenced"}


def test_one_answer_per_page(spark):
    rows = spark.range(4).select(
        F.lit("k").alias("url_key"), "id", F.when(F.col("id") < 3, F.from_json(F.concat(F.lit('{"reasoning": "r'), F.col("id"), F.lit('"}')), NESTING)).alias("body")
    )
    latest = lambda r: [x.nesting.reasoning for x in _latest(r, "nesting").collect()]
    assert latest(rows.withColumn("seq", -F.col("id"))) == ["r0"] and latest(rows.withColumnRenamed("id", "seq")) == ["r2"]
    assert len(latest(rows)) == 1
    stored = spark.createDataFrame([("a", "old", "x")], "url_key string, name string, more string")
    changed = spark.createDataFrame([("a", "one", 1), ("a", "two", 2)], "url_key string, name string, seq int")
    assert [tuple(r) for r in upsert_plans(stored, changed).collect()] == [("a", "two", "x")]


def _levels(spark, rows):
    return spark.createDataFrame(
        rows,
        "plan_id string, level int, sample_url string, item_container_selector string, is_final_level boolean, "
        f"drill_down_link_selector string, fields array<{FIELD}>",
    )


def field(name, selector):
    return (name, "string", False, "", None, selector, "text", None)


def test_a_field_without_a_name(spark, docs_of):
    docs = docs_of("<ul><li><b>one</b><i>1</i></li><li><b>two</b><i>2</i></li></ul>")
    levels = _levels(spark, [("p", 1, "https://h.com/0", "li", True, None, [field("title", "b"), field(None, "i")])])
    rows = scrape(levels, docs).rows.orderBy("order_key").collect()
    assert [r.fields for r in rows] == [{"title": "one", "": "1"}, {"title": "two", "": "2"}]


def test_errors_of_a_run(spark, docs_of):
    docs = docs_of("<p>x</p>")
    levels = _levels(
        spark,
        [
            ("good", 1, "https://h.com/0", "p", True, None, [field("a", "b")]),
            ("bad", 1, "https://h.com/0", "p:hover", True, None, [field("a", "b::after"), field(None, "i")]),
            ("lost", 1, "https://h.com/none", "p", True, None, []),
        ],
    )
    found = sorted((r.plan_id, r.kind, r.detail) for r in run_errors(levels, docs, page_index(docs)).collect())
    assert found == [
        ("bad", "field without a name", "field 1"), ("bad", "unsupported selector", "field a: b::after"),
        ("bad", "unsupported selector", "item: p:hover"), ("lost", "missing page", None),
    ]
    part = docs.withColumn("error", F.lit("stopped"))
    assert {(r.plan_id, r.detail) for r in run_errors(levels, part, page_index(docs)).where("kind = 'page read in part'").collect()} == {("good", "stopped"), ("bad", "stopped")}
    asked = spark.createDataFrame([("good", "a"), ("good", "z"), ("none", "a")], "plan_id string, field string")
    assert sorted((r.plan_id, r.field) for r in request_errors(asked, levels, page_index(docs)).collect()) == [("good", "z"), ("none", "a")]


def test_errors_for_a_reader_without_nested_lists(spark, docs_of):
    docs = docs_of("<p>x</p>")
    fields = [field("a", "b:not(.x, #y)"), field("c", "b:is(i, u)"), field("d", "i::before")]
    levels = _levels(spark, [("p", 1, "https://h.com/0", "li:has(a)", True, None, fields)])
    found = lambda **how: sorted(r.detail for r in run_errors(levels, docs, page_index(docs), **how).collect())
    assert found() == ["field d: i::before"]
    assert found(nested=False) == ["field c: b:is(i, u)", "field d: i::before", "item: li:has(a)"]


def test_csv_keeps_blanks(spark, tmp_path):
    values = ["  a ", " ", 'say "x"', "a,b", "", None, "é\t"]
    write_csv(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1), str(tmp_path / "out"))
    lines = open(glob.glob(str(tmp_path / "out/part-*"))[0], encoding="utf-8").read().split("\n")
    assert lines[:8] == ["i,v", "0,  a ", "1, ", '2,"say ""x"""', '3,"a,b"', "4,", "5,", "6,é\t"]


def test_long_pages_take_linear_time(spark):
    def seconds(n):
        html = "<p>" + "<br>" * n + "</p>" + "</i>" * n + "<li>x" * 300
        pages = spark.createDataFrame([(1, "https://h.com/", html)], "page_id long, url string, html string")
        started = time.perf_counter()
        page = parse_pages(pages).select(F.size("elems").alias("n"), F.col("elems")[n + 1]["idx"].alias("idx"), F.element_at("elems", -1)["depth"].alias("depth")).first()
        assert tuple(page) == (n + 302, n, 300)
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(50_000) < 40 * max(seconds(5_000), 0.5)


def test_long_scripts_do_not_pile_up(spark, monkeypatch):
    from siteloom.operators import tokens

    monkeypatch.setattr(tokens, "_BATCH_CHARS", 10)
    pages = spark.createDataFrame([(i, "https://h.com/", "<script>" + "x" * 50 + "</script><p>a</p>") for i in range(20)], "page_id long, url string, html string")
    assert parse_pages(pages).count() == 20
