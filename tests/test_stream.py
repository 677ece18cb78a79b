"""The stream of items gives what one batch over the latest captures gives."""

import datetime

from pyspark.sql import functions as F

from siteloom.operators.parse import parse_pages
from siteloom.operators.scrape import scrape
from siteloom.plans.model import LEVEL_PLAN
from siteloom.session import keep
from siteloom.streaming.items import CAPTURES, current_items, stream_items

FIELD = ("string", False, "")


def _levels(spark):
    of = lambda plan, url: (plan, 1, "level_1", url, "list", None, "li", True, None, [("v", *FIELD, None, "b", "text", None)])
    return spark.createDataFrame([of("a", "https://h.com/a"), of("b", "http://h.com/b/"), of("c", "https://h.com/none")], LEVEL_PLAN)


def _rows(*captures):
    day = lambda d: datetime.datetime(2026, 1, d)
    return [(page, f"https://h.com/{name}", "".join(f"<li><b>{v}</b></li>" for v in values), day(d)) for page, name, values, d in captures]


def test_late_and_repeated_files_and_a_restart(spark, tmp_path):
    base = str(tmp_path)
    first = _rows((1, "a", "xy", 5), (2, "b", "z", 5), (9, "other", "q", 5))
    again = _rows((1, "a", "xy", 5), (1, "a", "old", 4), (2, "b", "zw", 6))
    last = _rows((2, "b", "", 7), (1, "a", "older", 3), (1, "a", "xy", 5))
    seen = []
    for number, rows in enumerate((first, again, last)):
        spark.createDataFrame(rows, CAPTURES).coalesce(1).write.parquet(f"{base}/captures/{number}")
        # each run is a new query on the old state
        stream_items(spark, _levels(spark), f"{base}/captures/*", f"{base}/items", f"{base}/state", "10 days", 1).awaitTermination()
        seen += rows
        latest = {}
        for page, url, html, at in seen:
            latest[page] = max(latest.get(page, (at, url, html)), (at, url, html))
        table = spark.createDataFrame([(p, u, h) for p, (_, u, h) in latest.items()], "page_id long, url string, html string")
        want = sorted((r.plan_id, r.order_key[0], r.fields["v"]) for r in scrape(_levels(spark), keep(parse_pages(table))).rows.collect())
        got = current_items(spark, f"{base}/items").orderBy("plan_id", "item").collect()
        assert [(r.plan_id, r.item, r.fields["v"]) for r in got] == want
    assert want == [("a", 1, "x"), ("a", 3, "y")]
    # repeats were dropped by the state: six contents of the two pages of plans are left
    rows = spark.read.option("basePath", f"{base}/items").parquet(f"{base}/items/batch=*")
    assert rows.select("capture").distinct().count() == 6


def test_pages_of_a_batch_are_dealt_out(spark, tmp_path, monkeypatch):
    from siteloom.operators import parse
    from siteloom.streaming import items

    pages = [(i, f"https://h.com/{i}", "<p>" + "x" * 97, None) for i in range(50)]
    rows = spark.createDataFrame(pages, items.CAPTURES).withColumn("captured_at", F.to_timestamp(F.lit("2026-01-01")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(parse, "CHARS_PER_TASK", 500)
    tasks = []
    monkeypatch.setattr(items, "parse_pages", lambda dealt: tasks.append(dealt.rdd.getNumPartitions()) or parse.parse_pages(dealt))
    items.stream_items(spark, _levels(spark), f"{tmp_path}/in", f"{tmp_path}/items", f"{tmp_path}/state").awaitTermination()
    assert tasks[0] == 10


def test_levels_of_a_batch_are_not_broadcast(spark, tmp_path, monkeypatch):
    from siteloom.streaming import items

    spark.createDataFrame(_rows((1, "a", "xy", 5), (2, "b", "z", 5)), items.CAPTURES).coalesce(1).write.parquet(f"{tmp_path}/in")
    plans, extract_items = [], items.extract_items
    plan = lambda tasks: tasks._jdf.queryExecution().sparkPlan().toString().splitlines()
    monkeypatch.setattr(items, "extract_items", lambda tasks, docs, sizes: plans.append(plan(tasks)) or extract_items(tasks, docs, sizes))
    items.stream_items(spark, _levels(spark), f"{tmp_path}/in", f"{tmp_path}/items", f"{tmp_path}/state").awaitTermination()
    joins = [line for line in plans[0] if "salt#" in line.split("]")[0]]
    assert any("SortMergeJoin" in line for line in joins) and not any("Broadcast" in line for line in joins)
    assert items.current_items(spark, f"{tmp_path}/items").count() == 3
