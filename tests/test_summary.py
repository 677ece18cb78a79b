"""Summaries, value search, previews and the link frontier on hand-made pages."""

import pytest
from pyspark.sql import functions as F

from siteloom.operators import frontier as N
from siteloom.operators import preview, search, summary
from siteloom.operators.select import select

PAGE = (
    '<html><head><title>T &amp; x</title><noscript>zz</noscript></head><body><nav class="n m"><a href="/a"> A <b> 1</b></a><a href="">e</a>'
    '<a href="/a">dup</a></nav><div id=box class=k><p class=q>one <i>two</i></p><p class=q title="Find Me">three</p><p class=q></p>'
    '<p class=q>4</p><p class=q>5</p><ul class="u v"><li>x<li>y</ul></div><div class=k>kk<script>find me</script></div><!-- find me too --></body>'
)


def test_summary_row(docs_of):
    row = summary.summarize(docs_of(PAGE)).first().asDict(recursive=True)
    assert row["title"] == "T & x" and row["common_classes"] == ["q"]
    assert [s["text_sample"] for s in row["samples"]] == ["one two", "three", ""]
    assert row["link_samples"] == [{"href": "/a", "text": "A1", "parent_tag": "nav", "parent_class": "n m", "in_nav": True}]
    box, inner = row["structural_elements"]
    assert box["selector"] == "#box" and [c["text"] for c in box["children"]] == ["one two", "three", "4", "5", "x y"]
    assert inner["selector"] == "ul.u.v" and inner["text_preview"] == "x y"


def test_class_limits_and_order(docs_of):
    many = "".join(f'<i class="c{k}"></i>' * 5 for k in range(30))
    html = '<b class="four"></b>' * 4 + '<b class="md:flex five"></b>' * 5 + many
    rows = summary.class_frequency(docs_of(html), 20).orderBy("rank").collect()
    assert [(r["class"], r["n"]) for r in rows] == [("md:flex", 5), ("five", 5)] + [(f"c{k}", 5) for k in range(18)]
    assert summary.class_frequency(docs_of(html)).count() == 32
    assert summary.class_frequency(docs_of("", "<p></p>")).count() == 0
    samples = summary.class_samples(docs_of(html)).where("class = 'md:flex'")
    assert samples.count() == 3


def test_structures_limits(docs_of):
    sections = "".join(f'<section class="s{i}"><p>a</p>' + "<p>b</p>" * (i % 3) + "</section>" for i in range(20))
    html = sections + '<div class="s1 empty"><p></p></div><div><p>no name</p></div>' + '<div class="wide">' + "<p>w</p>" * 14 + "</div>"
    assert summary.structural_elements(docs_of(html)).count() == 21
    assert len(summary.structural_elements(docs_of(html)).orderBy("pos").first().children) == 14
    rows = summary.structural_elements(docs_of(html), 15, 10, 25).orderBy("pos").collect()
    assert rows[0].selector == "div.wide" and len(rows[0].children) == 10
    assert [r.selector for r in rows[1:6]] == [f"section.s{i}" for i in (2, 5, 8, 11, 14)]
    assert len(rows) == 16  # fifteen sections at most, and one div


def test_summaries_do_not_shuffle(docs_of):
    plan = summary.summarize(docs_of(PAGE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_two_hundred_links(docs_of, spark):
    html = "".join(f'<a href="/{i % 200}">{i}</a>' for i in range(300)) + '<a href="">no</a><a>none</a>'
    docs = docs_of(html)
    links = summary.all_links(docs).orderBy("pos").collect()
    assert [(r.href, r.text) for r in links] == [(f"/{i}", str(i)) for i in range(200)]
    scopes = spark.createDataFrame([(0, "https://h.com/0", None)], "page_id long, url string, item_container_selector string")
    assert N.link_pool(scopes, docs).count() == 199  # all but the page itself


def test_first_sixty_anchors_before_repeats(docs_of):
    html = '<a href="/0">first</a>' * 59 + '<a href="/1">sixty</a><a href="/2">too late</a>'
    assert [r.href for r in summary.link_samples(docs_of(html), 60).orderBy("pos").collect()] == ["/0", "/1"]
    assert summary.link_samples(docs_of(html)).count() == 3


def test_value_search(docs_of, spark, monkeypatch):
    asked = spark.createDataFrame([(0, "a", " Find me "), (0, "b", "two"), (0, "c", "nowhere"), (0, "d", ".*")], "page_id long, id string, expected_value string")
    for size in (64, 1):
        monkeypatch.setattr(search, "_SEARCHES_PER_PART", size)
        rows = search.find_values(asked, docs_of(PAGE)).orderBy("id", "pos").collect()
        assert [(r.id, r.tag, r.selector_hint, r.attribute_found, r.text_preview) for r in rows] == [
            ("a", "body", "body", None, "find me too"), ("a", "p", "p.q", "title", "[title] Find Me"), ("b", "i", "i", None, "two"),
        ]
        assert [(p.tag, p.id) for p in rows[2].parent_chain] == [("p", ""), ("div", "box")]


def test_indexed_search(docs_of, spark):
    docs = docs_of(PAGE, "<p title='ab'>xyz</p>", "<p>xy 😀b</p><script>hidden</script>", "")
    index = search.value_index(docs)
    values = [" Find me ", "two", "nowhere", ".*", "xy", "X", "😀b", "ab", "hidden", " ", "ME"]
    every = spark.createDataFrame([(p, v) for p in range(4) for v in values], "page_id long, expected_value string")
    told = lambda rows: sorted((r.page_id, r.expected_value, r.pos, r.selector_hint, r.full_text) for r in rows.collect() if r.expected_value.strip())
    want = told(search.find_values(every, docs))
    assert len(want) > 8 and told(search.find_indexed(every, docs, index)) == want
    anywhere = every.select("expected_value").distinct()
    assert told(search.find_indexed(anywhere, docs, index)) == want
    # a page without the pieces is not looked through: it need not be there
    only = docs.where(F.col("page_id").isin([p for p, v, *_ in want if v == "two"]))
    assert told(search.find_indexed(anywhere.where("expected_value = 'two'"), only, index)) == [w for w in want if w[1] == "two"]


def test_preview(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/", '<HEAD lang=x><Script>a</sCript><p onClick="x()" id=a>t</p><script>\nb</script></HEAD>'), (2, "http://h/", "<p>bare</p>")],
        "page_id long, url string, html string",
    )
    out = [r.preview for r in preview.previews(pages, F.lit("p.x")).orderBy("page_id").collect()]
    style = "<style>p.x {outline: 3px solid #E74C3C; outline-offset: 3px}</style>"
    assert out[0] == f'<HEAD lang=x><base href="http://h/" target="_blank"><p id=a>t</p>{style}</HEAD>'
    assert out[1] == f'<html><head><base href="http://h/" target="_blank">{style}</head><body><p>bare</p></body></html>'


LINKS = (
    '<nav><a href="/home">Home</a></nav><div class=i><a href="#x">h</a><a href="javascript:1">j</a><a href="tel:1">t</a><a href="/b/2"> </a>'
    '<div class=i><a href="/b/2">Two</a><a href="https://else.com/">o</a></div><a href="?page=2">next</a><a href="/other">Other</a></div>'
    '<div class=i><a href="/b/3">Three</a><a href="/b/2">again</a></div>'
)


@pytest.fixture(scope="module")
def frontier(spark, docs_of):
    docs = docs_of(("http://h.com/b", LINKS), ("http://h.com/c", LINKS))
    scopes = spark.createDataFrame(
        [(0, "http://h.com/b", ".i, .j"), (1, "http://h.com/c", ".none")], "page_id long, url string, item_container_selector string"
    )
    return scopes, docs


def test_item_links(frontier):
    scopes, docs = frontier
    rows = N.item_links(scopes, docs).orderBy("pos").collect()
    assert [(r.page_id, r.href, r.text) for r in rows] == [
        (0, "/b/2", ""), (0, "https://else.com/", "o"), (0, "?page=2", "next"), (0, "/other", "Other"), (0, "/b/3", "Three"),
    ]


def test_pool_ranking_and_candidates(frontier, spark):
    scopes, docs = frontier
    visited = spark.createDataFrame([(0, "http://h.com/b/3"), (1, "http://h.com/other/")], "page_id long, link_url string")
    pool = N.link_pool(scopes, docs, visited)
    rows = [(r.page_id, r.position, r.link_url, r.score, r.label) for r in pool.orderBy("page_id", "position").collect()]
    assert rows == [
        (0, 0, "http://h.com/b/2", 1.0, None), (0, 1, "http://h.com/other", 0.3, "Other"),
        (1, 0, "http://h.com/home", 0.3, "Home"), (1, 1, "http://h.com/b/2", 0.3, None), (1, 2, "http://h.com/other", 0.3, "Other"),
        (1, 3, "http://h.com/b/3", 0.3, "Three"),
    ]
    best = N.top_candidates(pool).where("page_id = 0 and rank = 0").first()
    assert (best.label, best.reason, best.confidence) == ("2", "", 1.0)
    shape = "page_id long, ranked_candidates array<struct<link_index:string,label:string,reason:string,confidence:string>>"
    given = spark.createDataFrame([(0, [("1", "", None, "0.5"), ("x", "n", "", "1"), (None, "n", "", "1")]), (1, [("9", "far", "", "1")])], shape)
    rows = [(r.page_id, r.rank, r.link_url, r.label, r.confidence) for r in N.resolve_candidates(given, pool).orderBy("page_id", "rank").collect()]
    assert rows[0] == (0, 0, "http://h.com/other", "Other", 0.5) and len([r for r in rows if r[0] == 1]) == 4


def test_guard(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 11)], "root_url string, current_url string, current_level int")
    seen = spark.createDataFrame([("r", "b"), ("r", "b"), ("s", "a")], "root_url string, url string")
    assert {r.current_url: r.proceed for r in N.guard_frontier(rows, seen).collect()} == {"a": True, "b": False, "c": False}


def test_uneven_links_need_no_pairs(docs_of):
    # ten thousand nested elements: settled by windows, not by pairs
    assert select(docs_of("<div>" * 10_000), "div div").count() == 9_999


def test_long_values_are_looked_for_by_long_pieces(docs_of, spark, monkeypatch):
    docs = docs_of("<p>see abcdefghij</p>", *["<p>abc</p><p>bcd</p><p>cde</p><p>def</p><p>efg</p><p>fgh</p><p>ghi</p><p>hij</p>"] * 5)
    asked = spark.createDataFrame([("ABCDEFGHIJ",), ("abc",)], "expected_value string")
    index = search.value_index(docs)
    looked = []
    monkeypatch.setattr(search, "find_values", lambda told, *_: looked.append(told))
    search.find_indexed(asked, docs, index)
    rows = looked[0].collect()
    assert sorted(r.page_id for r in rows if r.expected_value == "ABCDEFGHIJ") == [0] and len(rows) == 7
