"""Tree rules and properties of parsed documents."""

import random

from pyspark.sql import functions as F

from siteloom.operators.parse import dom_nodes, text_of
from siteloom.operators.summary import page_titles, remove_noise
from siteloom.operators.tokens import Tokens

TRAPS = [
    '<!DOCTYPE html><p class="a  b" id=x>A &amp; B&copy;<b>c</p><br></br>d<div/>e<script>"</p>"</script><!--cc--><ul><li>1<li>2</ul>',
    "<p>a<p>b<img>c</img></p></span>d",
    "<div>cut off <i>here",
    "&unknown; &lt;x&gt; &#65;&#x42; a & b",
    "<a class='x' class='y' rel='  n  o '>t</a><noscript><p>n</p></noscript><template><p>t</p></template>",
    "",
]


def test_tree_rules(docs_of):
    docs = docs_of(*TRAPS).orderBy("page_id").collect()
    shape = lambda d: [(e.tag, e.parent, e.last) for e in d.elems]
    assert shape(docs[0]) == [
        ("[document]", -1, 8), ("p", 0, 2), ("b", 1, 2), ("br", 0, 3), ("div", 0, 4), ("script", 0, 5), ("ul", 0, 8), ("li", 6, 8), ("li", 7, 8)
    ]
    assert docs[0].elems[1].classes == ["a", "b"] and docs[0].elems[1].attrs["class"] == "a b"
    assert [t.kind for t in docs[0].texts] == ["doctype", "text", "text", "text", "text", "script", "comment", "text", "text"]
    assert shape(docs[1]) == [("[document]", -1, 3), ("p", 0, 3), ("p", 1, 3), ("img", 2, 3)]
    assert shape(docs[2]) == [("[document]", -1, 2), ("div", 0, 2), ("i", 1, 2)]
    assert docs[3].texts[0].text == "&unknown <x> AB a & b"
    assert docs[4].elems[1].attrs == {"class": "y", "rel": "n o"}
    assert [(t.kind, t.noise) for t in docs[4].texts] == [("text", False), ("text", True), ("template", False)]
    assert shape(docs[5]) == [("[document]", -1, 0)] and all(d.error is None for d in docs)


def test_ranges_nest_and_texts_add_up(docs_of, spark):
    docs = docs_of(*TRAPS)
    nodes = dom_nodes(docs)
    pairs = nodes.alias("c").join(nodes.alias("p"), (F.col("c.page_id") == F.col("p.page_id")) & (F.col("c.parent") == F.col("p.node")))
    assert pairs.where("c.node <= p.node or c.last > p.last or c.depth <> p.depth + 1").count() == 0
    assert pairs.count() == nodes.where("parent is not null").count()
    assert nodes.groupBy("page_id").agg((F.count("*") - F.max("last")).alias("d")).where("d <> 1").count() == 0
    texts = docs.select("page_id", F.transform("elems", lambda e: text_of(F.col("texts"), e)).alias("t")).orderBy("page_id").collect()
    assert texts[0].t[0] == "A & B© c d e 1 2" and texts[0].t[5] == '"</p>"'
    assert texts[4].t[0] == "t n" and texts[4].t[3] == "n"


def test_titles_and_noise(docs_of):
    docs = docs_of(
        "<title> a </title><title>b</title>", "<title>a<b>x</b></title>", "<title><b>x</b></title>", "<title></title>", "<p>none</p>",
        "<script>1</script><noscript><i>2</i></noscript><p>3</p>",
    )
    assert [r.title for r in page_titles(docs).orderBy("page_id").collect()] == [" a ", None, "x", None, None, None]
    left = remove_noise(docs).where("page_id = 5").orderBy("node").collect()
    assert [(r.kind, r.tag or r.text) for r in left] == [("element", "[document]"), ("element", "p"), ("text", "3")]


def test_siblings_over_many_pages_in_one_batch(docs_of):
    docs = docs_of(*(["<ul><li>1</li><p>x</p><li>2</li></ul><ul></ul>"] * 5)).collect()
    for d in docs:
        at = [(e.tag, e.idx, e.ridx, e.tidx, e.rtidx, e.prev) for e in d.elems[1:]]
        assert at == [("ul", 1, 2, 1, 2, -1), ("li", 1, 3, 1, 2, -1), ("p", 2, 2, 1, 1, 2), ("li", 3, 1, 2, 1, 3), ("ul", 2, 1, 2, 1, 1)]


def _recursive(kinds, values):
    """The tree by recursive descent: an element reads its children until an end tag closes it or one outside of it."""
    elems, at = [["[document]", -1, None, 0]], 0

    def read(number, open_names):
        """Returns the name whose end tag closes this element and more, or None."""
        nonlocal at
        while at < len(kinds):
            kind, value = kinds[at], values[at]
            at += 1
            if kind == "start":
                elems.append([value, number, None, len(open_names) + 1])
                mine = len(elems) - 1
                closing = read(mine, [*open_names, value])
                elems[mine][2] = len(elems) - 1
                if closing is not None and closing != value:
                    return closing
            elif kind == "end" and value in open_names:
                return value
        return None

    read(0, [])
    elems[0][2] = len(elems) - 1
    return [tuple(e) for e in elems]


def test_nodes_equal_a_recursive_reference(docs_of):
    rng = random.Random(5)
    bits = ["<b>", "</b>", "<p>", "</p>", "<br>", "</br>", "<div/>", "<i>", "</i>", "x", "<ul>", "<li>", "</li>", "</ul>", "<!--c-->", "<script>a</script>", "</none>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 30, 127, 128, 129, 700]))) for _ in range(60)]
    docs = docs_of(*pages)
    kinds = {d.page_id: [(e.tag, e.parent, e.last, e.depth) for e in d.elems] for d in docs.collect()}
    reader = Tokens()
    for i, html in enumerate(pages):
        reader.clear()
        reader.read(html)
        assert kinds[i] == _recursive(reader.kind, reader.value), html
    # nodes number elements and strings together, in the order of the tokens
    nodes = dom_nodes(docs).where("page_id = 3 and parent is not null").orderBy("node").collect()
    reader.clear()
    reader.read(pages[3])
    assert [n.tag or n.kind for n in nodes] == [v if k == "start" else "script" if v == "a" else k for k, v in zip(reader.kind, reader.value) if k != "end"]


def test_more_pages_make_more_tasks(spark, monkeypatch):
    from siteloom.operators import parse

    monkeypatch.setattr(parse, "CHARS_PER_TASK", 1000)
    pages = spark.createDataFrame([(i, f"https://h.com/{i}", "<p>" + "x" * 97) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    docs = parse.parse_pages(parse.spread_pages(pages))
    rows = docs.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 20 and max(r["count"] for r in rows) <= 20
    assert parse.spread_pages(pages.where("page_id < 0")).count() == 0
