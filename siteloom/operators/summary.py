"""Page summaries: what a person or a model needs to see of a page's structure.

Everything is computed inside the document row, without a shuffle. Limits are arguments; without one nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.columns import let
from siteloom.functions.text import collapse, cut
from siteloom.operators.parse import dom_nodes, strings_of, text_of

# Fixed values of a short summary, as callers that want one pass them.
MIN_CLASS_COUNT = 5
MAX_CLASSES = 20
SAMPLES_PER_CLASS = 3
MAX_ANCHORS = 60
NAV_TAGS = ("nav", "header", "footer")
STRUCTURE_TAGS = ("main", "article", "section", "header", "aside", "div", "dl", "ul", "ol", "table", "figure")
MAX_PER_TAG = 15
MAX_CHILDREN = 10
MAX_STRUCTURES = 25
SAMPLE_LENGTH, LABEL_LENGTH, CLASS_LENGTH, CHILD_LENGTH, PREVIEW_LENGTH = 300, 60, 50, 100, 150


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """One row per entry of a computed array (the plain explode would compute it twice)."""
    entries = rows.select("page_id", F.posexplode_outer(name).alias("pos", "entry")).where(F.col("pos").isNotNull())
    return entries.select("page_id", "pos", "entry.*")


def remove_noise(docs: DataFrame) -> DataFrame:
    """Nodes outside script, style and noscript."""
    return dom_nodes(docs).where(~F.col("noise")).drop("noise")


def title_column() -> Column:
    """Text of the first title if it holds exactly one string (directly or through only children)."""
    marks = F.transform("elems", lambda e: (e["tag"] == "title") & ~e["noise"])
    at = F.array_position(marks, True).cast("int") - 1
    elem = F.get("elems", at)
    string = F.get("texts", elem["t0"])
    chain = F.get("elems", elem["last"])["depth"] - elem["depth"] == elem["last"] - at
    single = (elem["t1"] - elem["t0"] == 1) & (string["parent"] == elem["last"]) & chain
    return F.when((at >= 0) & single, string["text"])


def page_titles(docs: DataFrame) -> DataFrame:
    return docs.select("page_id", title_column().alias("title"))


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def _counted(least: int, max_classes: int | None) -> Column:
    """(class, n) of the classes seen ``least`` times or more, in order of first appearance.

    Sorting the page's class names puts equal ones together, so a run's length is its count: n log n in the row.
    """
    names = F.flatten(F.transform(F.filter("elems", lambda e: ~e["noise"]), lambda e: e["classes"]))
    ordered = lambda all_: F.array_sort(F.transform(all_, lambda c, i: F.struct(c.alias("class"), i.alias("at"))))
    # in sorted order the first of a run has the smallest place; the next run's start gives the length
    starts = lambda s: F.filter(
        F.transform(s, lambda x, i: F.struct(x["class"].alias("class"), x["at"].alias("at"), i.alias("i"))),
        lambda x: (x["i"] == 0) | (F.get(s, x["i"] - 1)["class"] != x["class"]),
    )
    sized = lambda s, t: F.transform(
        t,
        lambda x, k: F.struct(
            x["at"].alias("at"),
            x["class"].alias("class"),
            (F.coalesce(F.get(t, k + 1)["i"], F.size(s)) - x["i"]).cast("long").alias("n"),
        ),
    )
    runs = let(names, lambda a: let(ordered(a), lambda s: let(starts(s), lambda t: sized(s, t))))
    kept = F.array_sort(F.filter(runs, lambda r: r["n"] >= least))
    return _first(F.transform(kept, lambda r: F.struct(r["class"].alias("class"), r["n"].alias("n"))), max_classes)


def class_frequency(docs: DataFrame, max_classes: int | None = None, least: int = MIN_CLASS_COUNT) -> DataFrame:
    """Classes seen ``least`` times or more on a page, in order of first appearance."""
    rows = _listed(docs.select("page_id", _counted(least, max_classes).alias("counted")), "counted")
    return rows.select("page_id", (F.col("pos") + 1).alias("rank"), "class", "n")


def _with_classes(docs: DataFrame, max_classes: int | None, least: int) -> DataFrame:
    return docs.withColumn("common_classes", F.transform(_counted(least, max_classes), lambda c: c["class"]))


def _samples(per_class: int | None, length: int | None) -> Column:
    first = lambda name: _first(
        F.filter("elems", lambda e: ~e["noise"] & F.array_contains(e["classes"], name)), per_class
    )
    return F.flatten(
        F.transform(
            "common_classes",
            lambda name: F.transform(
                first(name),
                lambda e: F.struct(
                    name.alias("class"),
                    e["tag"].alias("tag"),
                    cut(collapse(text_of(F.col("texts"), e, clean=True)), length).alias("text_sample"),
                ),
            ),
        )
    )


def class_samples(
    docs: DataFrame, max_classes: int | None = None, per_class: int | None = SAMPLES_PER_CLASS, least: int = MIN_CLASS_COUNT,
    sample_length: int | None = None,
) -> DataFrame:
    """First elements of each frequent class."""
    rows = _with_classes(docs, max_classes, least).where(F.size("common_classes") > 0)
    return _listed(rows.withColumn("samples", _samples(per_class, sample_length)), "samples")


def all_links(docs: DataFrame, label_length: int | None = None) -> DataFrame:
    """Every link of each page outside noise, each address once: ``page_id, pos, href, text``. ``pos`` is its first anchor's number."""
    anchors = F.filter(
        F.transform("elems", lambda e, i: F.struct(i.alias("node"), e.alias("e"))),
        lambda x: (x["e"]["tag"] == "a") & ~x["e"]["noise"] & (F.try_element_at(x["e"]["attrs"], F.lit("href")) != ""),
    )
    found = F.transform(
        anchors,
        lambda x: F.struct(
            x["node"].alias("node"),
            F.try_element_at(x["e"]["attrs"], F.lit("href")).alias("href"),
            cut(F.array_join(strings_of(F.col("texts"), x["e"], clean=True), ""), label_length).alias("text"),
        ),
    )
    rows = _listed(docs.select("page_id", found.alias("found")).withColumnRenamed("found", "links"), "links")
    first = rows.groupBy("page_id", "href").agg(F.min(F.struct("node", "text")).alias("first"))
    return first.select("page_id", F.col("first.node").alias("pos"), "href", "first.text")


def _with_links(docs: DataFrame, max_anchors: int | None, label_length: int | None, class_length: int | None) -> DataFrame:
    """Adds ``link_samples``: the first anchors, without empty and repeated addresses."""
    numbered = F.transform("elems", lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    anchors = F.filter(
        numbered,
        lambda x: (x["e"]["tag"] == "a") & ~x["e"]["noise"] & F.map_contains_key(x["e"]["attrs"], F.lit("href")),
    )
    navs = F.transform(
        F.filter(numbered, lambda x: x["e"]["tag"].isin(*NAV_TAGS)),
        lambda x: F.struct(x["i"].alias("i"), x["e"]["last"].alias("last")),
    )
    href = lambda x: F.try_element_at(x["e"]["attrs"], F.lit("href"))
    parent = lambda x: F.get("elems", x["e"]["parent"])
    new = lambda x, k: (href(x) != "") & ~F.exists(F.slice("_anchors", 1, k), lambda y: href(y) == href(x))
    link = lambda x, within: F.struct(
        href(x).alias("href"),
        cut(F.array_join(strings_of(F.col("texts"), x["e"], clean=True), ""), label_length).alias("text"),
        parent(x)["tag"].alias("parent_tag"),
        cut(F.array_join(parent(x)["classes"], " "), class_length).alias("parent_class"),
        F.exists(within, lambda n: (n["i"] < x["i"]) & (x["i"] <= n["last"])).alias("in_nav"),
    )
    return (
        docs.withColumn("_anchors", _first(anchors, max_anchors))
        .withColumn("link_samples", let(navs, lambda n: F.transform(F.filter("_anchors", new), lambda x: link(x, n))))
        .drop("_anchors")
    )


def link_samples(
    docs: DataFrame, max_anchors: int | None = None, label_length: int | None = None, class_length: int | None = None
) -> DataFrame:
    rows = _with_links(docs.select("page_id", "elems", "texts"), max_anchors, label_length, class_length)
    return _listed(rows, "link_samples")


def _with_structures(
    docs: DataFrame, per_tag_limit: int | None, max_children: int | None, max_structures: int | None, child_length: int | None, preview_length: int | None
) -> DataFrame:
    """Adds ``structural_elements``: containers that may hold field data, most children first."""
    named = lambda e: (F.coalesce(e["id"], F.lit("")) != "") | (F.size(e["classes"]) > 0)
    selector = lambda e: F.when(
        F.coalesce(e["id"], F.lit("")) != "", F.concat(F.lit("#"), e["id"])
    ).otherwise(F.concat_ws(".", e["tag"], F.array_join(e["classes"], ".")))
    numbered = F.transform("elems", lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    containers = F.filter(numbered, lambda x: x["e"]["tag"].isin(*STRUCTURE_TAGS) & ~x["e"]["noise"])
    per_tag = [
        _first(F.filter("_containers", lambda x: x["e"]["tag"] == name), per_tag_limit) for name in STRUCTURE_TAGS
    ]
    listed = F.transform(
        F.filter(F.concat(*per_tag), lambda x: named(x["e"])),
        lambda x: F.struct(selector(x["e"]).alias("selector"), x["i"].alias("i"), x["e"].alias("e")),
    )
    unseen = lambda x, k: ~F.exists(F.slice("_listed", 1, k), lambda y: y["selector"] == x["selector"])
    plain = lambda e, n: cut(text_of(F.col("texts"), e, clean=True), n)
    child = lambda c: F.struct(
        c["tag"].alias("tag"),
        F.when(F.size(c["classes"]) > 0, F.array_join(c["classes"], ".")).alias("class"),
        F.when(c["id"] != "", c["id"]).alias("id"),
        plain(c, child_length).alias("text"),
    )
    inner = lambda x: F.slice("elems", x["i"] + 2, x["e"]["last"] - x["i"])
    children = lambda x: _first(
        F.filter(
            F.transform(F.filter(inner(x), lambda c: (c["parent"] == x["i"]) & ~c["noise"]), child),
            lambda c: c["text"] != "",
        ),
        max_children,
    )
    described = F.transform(
        F.filter("_listed", unseen),
        lambda x: F.struct(
            x["selector"].alias("selector"),
            x["e"]["tag"].alias("tag"),
            plain(x["e"], preview_length).alias("text_preview"),
            children(x).alias("children"),
        ),
    )
    ranked = F.array_sort(
        F.transform(
            F.filter("_described", lambda s: F.size(s["children"]) > 0),
            lambda s, k: F.struct((-F.size(s["children"])).alias("rank"), k.alias("k"), s.alias("s")),
        )
    )
    return (
        docs.withColumn("_containers", containers)
        .withColumn("_listed", listed)
        .withColumn("_described", described)
        .withColumn("structural_elements", F.transform(_first(ranked, max_structures), lambda r: r["s"]))
        .drop("_containers", "_listed", "_described")
    )


def structural_elements(
    docs: DataFrame, per_tag: int | None = None, max_children: int | None = None, max_structures: int | None = None,
    child_length: int | None = None, preview_length: int | None = None,
) -> DataFrame:
    rows = _with_structures(
        docs.select("page_id", "elems", "texts"), per_tag, max_children, max_structures, child_length, preview_length
    )
    return _listed(rows, "structural_elements")


#: The limits of a short summary, for ``summarize(docs, **SHORT)``.
SHORT = {
    "max_classes": MAX_CLASSES, "max_anchors": MAX_ANCHORS, "per_tag": MAX_PER_TAG, "max_children": MAX_CHILDREN,
    "max_structures": MAX_STRUCTURES, "sample_length": SAMPLE_LENGTH, "label_length": LABEL_LENGTH, "class_length": CLASS_LENGTH,
    "child_length": CHILD_LENGTH, "preview_length": PREVIEW_LENGTH,
}


def summarize(
    docs: DataFrame,
    max_classes: int | None = None,
    per_class: int | None = SAMPLES_PER_CLASS,
    least: int = MIN_CLASS_COUNT,
    max_anchors: int | None = None,
    per_tag: int | None = None,
    max_children: int | None = None,
    max_structures: int | None = None,
    sample_length: int | None = None,
    label_length: int | None = None,
    class_length: int | None = None,
    child_length: int | None = None,
    preview_length: int | None = None,
) -> DataFrame:
    """One summary row per page."""
    rows = _with_classes(docs, max_classes, least).withColumn("title", title_column()).withColumn("samples", _samples(per_class, sample_length))
    linked = _with_links(rows, max_anchors, label_length, class_length)
    return _with_structures(linked, per_tag, max_children, max_structures, child_length, preview_length).select(
        "page_id", "url", "title", "common_classes", "samples", "link_samples", "structural_elements"
    )
