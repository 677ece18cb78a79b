"""Plan tables, discovery, model exchange, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from siteloom.exchange.responses import clean_response, correction_fixes, parse_responses
from siteloom.plans import discovery, edit, merge
from siteloom.plans.extraction import build_levels
from siteloom.sources import sinks
from siteloom.sources.pages import page_index
from siteloom.sources.plans import list_plans, read_plans, reuse_offers
from siteloom.streaming.ingest import stream_batches, stream_docs

CHAIN = [
    {"level": 1, "url": "http://h/", "catalog_type": "film", "fields": [{"name": "title", "selector": "a"}, {"name": "year"}]},
    {"level": 2, "url": "http://h/1", "catalog_type": "film", "item_name": "Film", "fields": [{"name": "title", "selector": "h1", "required": True}]},
    {"level": 3, "url": "http://h/2", "fields": [{"name": "note"}, {"name": "year", "selector": ".y", "unknown": 1}], "nesting_analysis": {"is_final_level": True}},
]


@pytest.fixture(scope="module")
def plans(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    (folder / "a.json").write_text(json.dumps({"id": "A", "root_url": "http://h/", "schema_chain": CHAIN, "extra": [1]}, indent=2))
    (folder / "b.json").write_text('{"id": "B", "root_url": ""}')
    (folder / "c.json").write_text('{"id": "C", "root_url": ')
    return read_plans(spark, str(folder))


def test_reader_defaults_and_broken_files(plans):
    rows = {r.id: r for r in plans.collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["B"].item_name, rows["B"].nesting_depth, rows["B"].schema_chain, rows["B"].level_names) == ("Item", 1, [], [])
    field = rows["A"].schema_chain[0].fields[1]
    assert (field.type, field.required, field.description, field.selector, field.attribute) == ("string", False, "", None, "text")
    assert {r.id: r.field_count for r in list_plans(plans).collect()} == {"A": 5, "B": 0}


def test_reuse_offers(plans, spark):
    asked = spark.createDataFrame([("https://H/",), ("http://h/#x",), ("http://new/",)], "url string")
    assert {r.url: r.options for r in reuse_offers(asked, plans).collect()} == {
        "https://H/": ["reuse", "rediscover"], "http://h/#x": ["reuse", "rediscover"], "http://new/": ["discover"],
    }


def test_validate_and_merge(plans):
    warnings = [(r.id, r.warning) for r in edit.validate_plans(plans).orderBy("id", "pos").collect()]
    assert warnings == [("A", "Fields without selectors: year, note"), ("B", "Missing root URL"), ("B", "No fields defined")]
    merged = [(r.name, r.original_name, r.source_level_num) for r in merge.merged_fields(plans).orderBy("pos").collect()]
    # both titles stand on levels of the same type, the years on different ones
    assert merged == [("level_2_title", "title", 2), ("note", "note", 3), ("level_3_year", "year", 3)]
    levels = build_levels(plans).orderBy("level").collect()
    assert [(x.level_name, x.is_final_level) for x in levels] == [("film", False), ("film", False), ("level_3", True)]


def _edits(spark, *edits):
    names = [p.split(":")[0] for p in edit.EDIT[7:-1].split(",")]
    schema = "plan_id string, " + ", ".join(p.replace(":", " ") for p in edit.EDIT[7:-1].split(","))
    return spark.createDataFrame([tuple(["A"] + [{"seq": i, **e}.get(n) for n in names]) for i, e in enumerate(edits)], schema)


def test_edits_in_order(plans, spark):
    edits = _edits(
        spark,
        {"action": "rename", "field": "title", "new_name": "t1"}, {"action": "rename", "field": "t1", "new_name": "t2"},
        {"action": "add", "name": "year"}, {"action": "delete", "field": "year"}, {"action": "update", "field": "t2", "required": True, "level": 0},
        {"action": "add", "name": "late", "level": 7}, {"action": "add", "name": "sku", "type": "number", "level": 1}, {"action": "nonsense", "level": 1},
    )
    chain = edit.apply_schema_edits(plans, edits).where("id = 'A'").first().schema_chain
    assert [(f.name, f.required, f.selector) for f in chain[0].fields] == [("t2", True, "a")]
    assert [(f.name, f.type) for f in chain[1].fields] == [("title", "string"), ("sku", "number")] and len(chain[2].fields) == 2
    untouched = edit.apply_schema_edits(plans, _edits(spark, {"action": "delete", "field": "title", "level": 9}))
    assert untouched.orderBy("id").collect() == plans.orderBy("id").collect()


def test_create_update_upsert(plans, spark):
    roots = spark.createDataFrame([("https://h", "1"), ("http://n/x/", "1"), ("https://n/x", "1")], "url string, created_at string")
    new = edit.create_plans(roots, plans).collect()
    assert [(r.root_url, r.nesting_depth, r.schema_chain) for r in new] == [("https://n/x", 0, [])]
    assert {r.updated_at for r in edit.update_plans(plans, F.lit("now"), item_name=F.lit("x")).collect()} == {"now"}
    with pytest.raises(ValueError, match="Unknown field: colour"):
        edit.update_plans(plans, F.lit("now"), colour=F.lit("x"))
    old = spark.createDataFrame([("a", "p1", "s1"), ("b", "p2", "s2")], "url_key string, plan string, sample string")
    changed = spark.createDataFrame([("b", "p3"), ("c", "p4")], "url_key string, plan string")
    assert sorted(map(tuple, sinks.upsert_plans(old, changed).collect())) == [("a", "p1", "s1"), ("b", "p3", "s2"), ("c", "p4", None)]


def test_responses(spark):
    raws = ['{"is_final_level": false, "ranked_candidates": [{"link_index": 3, "confidence": "x"}]}', '```json\n{"reasoning": "a"}\n```',
            "```\n{}\n``` ", "", None, "no json " + "x" * 300, " [1"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    done = parse_responses(rows, "nesting").orderBy("i").collect()
    assert done[0].body.ranked_candidates[0].link_index == "3" and done[0].body.is_final_level is False
    assert done[1].body.reasoning == "a" and done[2].error is None
    assert [done[3].error, done[4].error] == ["empty response"] * 2
    assert done[5].error == "invalid JSON: " + raws[5][:200] + "..." and done[6].error == "invalid JSON: [1"
    assert rows.where("i = 2").select(clean_response(F.col("raw")).alias("c")).first().c == "{}"
    raw = '{"corrected_container_selector": null, "corrected_selector": "h1", "corrected_attribute": "text"}'
    fixes = correction_fixes(parse_responses(spark.createDataFrame([("P", 1, "f", raw)], "plan_id string, seq int, field string, raw string"), "correction"))
    assert fixes.first().asDict() == {"plan_id": "P", "seq": 1, "field": "f", "container_selector": None, "selector": "h1", "attribute": "text", "clear_container": True}


def _answers(spark, rows, body):
    frame = spark.createDataFrame([(*r[:-1], json.dumps(r[-1])) for r in rows], "url_key string, " + ("kind string, " if body == "schema" else "") + "raw string")
    return parse_responses(frame, body)


@pytest.fixture(scope="module")
def walk(spark, docs_of):
    docs = docs_of(("http://h/", '<p class=i><a href="/a">A</a></p><p class=i><a href="/b">B</a></p>'), ("http://h/a", "<h1>A</h1>"), ("http://h/b", "<h1>B</h1>"))
    item = {"item_name": "thing", "item_container_selector": ".i", "fields": [{"name": "name", "selector": "a"}]}
    detail = {"is_catalog": True, "catalog_type": "detail", "item_schema": {"item_name": "one", "item_container_selector": "body", "fields": [{"name": "h", "selector": "h1"}]}}
    schemas = _answers(
        spark,
        [("https://h/", "list", {"is_catalog": True, "catalog_type": "things", "item_schema": item}), ("https://h/a", "list", {"is_catalog": False}),
         ("https://h/a", "detail", detail), ("https://h/b", "list", {"is_catalog": False}), ("https://h/b", "detail", {**detail, "is_catalog": False})],
        "schema",
    )
    nestings = _answers(spark, [("https://h/", {"is_final_level": False, "ranked_candidates": [{"link_index": 1}]})], "nesting")
    roots = spark.createDataFrame([("http://h/",), ("http://gone/",)], "root_url string")
    return roots, docs, page_index(docs), schemas, nestings


def test_discovery_to_the_end(walk):
    roots, docs, index, schemas, nestings = walk
    plans = discovery.run(roots, docs, index, schemas, nestings, F.lit("t"))
    rows = {r.root_url: r for r in discovery.with_sample_values(plans, docs, index).collect()}
    found = rows["http://h/"]
    assert (found.item_name, found.nesting_depth, found.level_names) == ("one", 2, ["things", "detail"])
    assert [s.url for s in found.schema_chain] == ["http://h/", "http://h/b"]
    assert [s.fields[0].sample_value for s in found.schema_chain] == ["A", "B"]
    assert found.visited_urls == ["http://h/", "http://h/b"]
    lost = rows["http://gone/"]
    assert (lost.item_name, lost.nesting_depth, lost.level_names) == ("Item", 1, [])


@pytest.mark.parametrize(
    "mode, choice, extra, expect",
    [
        ("auto", "continue", {}, ("http://h/b", 2, False, 1)), ("auto", "continue", {"selected_url": "http://h/a"}, ("http://h/a", 2, False, 1)),
        ("auto", "continue", {"selected_url": "http://x/", "link_index": "0"}, ("http://h/a", 2, False, 1)), ("auto", "stop", {}, ("http://h/", 1, True, 1)),
        ("auto", "final", {}, ("http://h/", 1, True, 1)), ("auto", "what", {}, ("http://h/", 1, False, 0)), ("auto", None, {}, ("http://h/b", 2, False, 1)),
        ("manual", "drill", {}, ("http://h/a", 2, False, 1)), ("manual", None, {}, ("http://h/", 1, True, 1)),
    ],
)
def test_answers(walk, spark, mode, choice, extra, expect):
    roots, *inputs = walk
    state = discovery.start(roots.where("root_url = 'http://h/'"))
    given = spark.createDataFrame(
        [("http://h/", choice, extra.get("selected_url"), extra.get("link_index"))], "root_url string, choice string, selected_url string, link_index string"
    )
    row = discovery.apply_answers(discovery.decide(discovery.observe(state, *inputs), mode), given).first()
    assert (row.current_url, row.current_level, row.done, len(row.chain)) == expect
    assert row.visited == ([] if choice == "what" else ["http://h/"])


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([('a "q", b', None), ("", "line\nbreak")], "x string, y string").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 'x,y\n"a ""q"", b",\n,"line\nbreak"\n'
    sinks.write_json(rows, str(tmp_path / "json"))
    lines = next((tmp_path / "json").glob("*.json")).read_text().splitlines()
    assert json.loads(lines[0]) == {"x": 'a "q", b', "y": None}


def test_streams(spark, tmp_path):
    schema = "page_id long, url string, html string"
    pages = lambda *ids: spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in ids], schema)
    source, out = str(tmp_path / "pages"), str(tmp_path / "docs")
    counts = []
    for ids in ((1, 2), (3,)):
        pages(*ids).coalesce(1).write.mode("append").parquet(source)
        stream_docs(spark, source, out, str(tmp_path / "s1")).awaitTermination(120)
        stream_batches(spark, source, str(tmp_path / "s2"), lambda docs, n: counts.append(docs.count())).awaitTermination(120)
    assert spark.read.parquet(out).selectExpr("page_id", "size(elems) n").orderBy("page_id").collect() == [(1, 2), (2, 2), (3, 2)]
    assert counts == [2, 1]


def test_answers_of_a_discovery_are_saved_before_its_rounds(spark, tmp_path):
    from siteloom.queries import linking

    tables = {
        "customer": "select id c_custkey, 'C' || id c_name, cast(id % 2 as int) c_nationkey, 1.0D c_acctbal, 'X' c_mktsegment from range(3)",
        "nation": "select cast(id as int) n_nationkey, 'N' || id n_name, 0 n_regionkey from range(2)",
        "region": "select 0 r_regionkey, 'R' r_name",
        "supplier": "select id s_suppkey, 'S' s_name, 0 s_nationkey, 1.0D s_acctbal from range(1)",
        "part": "select id p_partkey, 'P' p_name, 'B' p_brand, 'T' p_type, 1 p_size, 1.0D p_retailprice from range(1)",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, index, schemas, nestings = linking._discovery_inputs(spark, str(tmp_path))
    for saved, name in ((schemas, "schema_answers"), (nestings, "nesting_answers")):
        assert all(name in f for f in saved.inputFiles()) and saved.count() == 4
