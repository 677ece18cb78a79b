"""Where on a page, or on which pages, does a value stand?

``find_values`` looks through the pages it is told. ``value_index`` lists the pages of every eight characters in a row (and of
every one, two and three, for short values); ``find_indexed`` intersects the lists of a value's rarest pieces and looks only
through the pages that hold them all, so it needs no page and reads none without reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.columns import let
from siteloom.functions.text import cut, strip
from siteloom.operators.parse import strings_of
from siteloom.operators.skew import parts_of, spread_join, tasks_for, with_pages
from siteloom.session import keep

# Attributes searched after the text, in this order, and the most hits and characters of a short answer.
SEARCHED_ATTRIBUTES = ("alt", "title", "value", "placeholder", "aria-label")
MAX_HITS = 5
SHORT_PREVIEW, SHORT_TEXT = 100, 200
# Searches of one page that are answered together; a page asked about more often is split.
_SEARCHES_PER_PART = 64
# Pieces of a value whose pages are intersected; all are verified afterwards.
_PIECES = 4
# Characters of a piece: of a value that has as many, the longest of these, because long pieces are rare.
_LENGTHS = (1, 2, 3, 8)

_PLACE = "array<struct<tag:string,classes:array<string>,id:string>>"


def _hint(e: Column) -> Column:
    return (
        F.when(F.coalesce(e["id"], F.lit("")) != "", F.concat(F.lit("#"), e["id"]))
        .when(F.size(e["classes"]) > 0, F.concat_ws(".", e["tag"], F.array_join(e["classes"], ".")))
        .otherwise(e["tag"])
    )


def find_values(
    searches: DataFrame, docs: DataFrame, max_hits: int | None = None, preview_length: int | None = None, text_length: int | None = None
) -> DataFrame:
    """Places that hold ``expected_value`` on ``page_id``, ignoring case: all, or the first ``max_hits``.

    ``searches`` may have further columns, which identify the search in the result. Strings come
    before attributes, each in document order. Searches that pile up on one page are split.
    """
    ids = [name for name in searches.columns if name not in ("page_id", "expected_value")]
    asked = keep(
        parts_of(searches.withColumn("_q", _wanted(F.col("expected_value"))), "page_id", _SEARCHES_PER_PART, searches.columns)
    )
    # the searches of a page meet it once, in groups of limited size
    place = ["page_id", "part"]
    places = keep(asked.select(*place).distinct())
    n = places.count()
    spread = [tasks_for(n, docs.sparkSession), *place]
    grouped = asked.repartition(*spread).groupBy(*place).agg(F.collect_list(F.struct(*ids, "expected_value", "_q")).alias("asked"))
    rows = grouped.join(with_pages(places, docs.select("page_id", "elems", "texts"), n).repartition(*spread), place)
    first = lambda hits: hits if max_hits is None else F.slice(hits, 1, max_hits)
    hit = lambda h: _hit(h, preview_length, text_length)
    answer = lambda a, hay: F.struct(
        *[a[name].alias(name) for name in [*ids, "expected_value"]],
        F.transform(first(F.filter(hay, lambda h: F.contains(h["low"], a["_q"]))), hit).alias("hits"),
    )
    found = let(_searchable(), lambda hay: F.transform("asked", lambda a: answer(a, hay)))
    each = rows.withColumn("_all", found).select("page_id", F.inline_outer("_all"))
    listed = each.select("page_id", *ids, "expected_value", F.posexplode_outer("hits").alias("pos", "hit"))
    return listed.where(F.col("pos").isNotNull()).select("page_id", *ids, "expected_value", "pos", "hit.*")


def _wanted(value: Column) -> Column:
    return strip(F.lower(value))


def _pieces(text: Column, length: int) -> Column:
    """The distinct pieces of so many characters."""

    def joined(chars: Column) -> Column:
        starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - length + 1, F.lit(0)))
        return F.array_distinct(F.transform(starts, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, length)])))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), joined)


def value_index(docs: DataFrame) -> DataFrame:
    """``piece, page_id``: which pages hold a piece (``_LENGTHS``) in a searchable string or attribute.

    Built once per page, inside its row; save it (bucketed by ``piece`` for repeated use).
    """
    own = F.flatten(F.transform("_hay", lambda t: F.flatten(F.array(*[_pieces(t, n) for n in _LENGTHS]))))
    strings = docs.select("page_id", F.array_distinct(F.transform(_searchable(), lambda h: h["low"])).alias("_hay"))
    return strings.select("page_id", F.explode(F.array_distinct(own)).alias("piece")).select("piece", "page_id")


def find_indexed(
    searches: DataFrame, docs: DataFrame, index: DataFrame, max_hits: int | None = None, preview_length: int | None = None, text_length: int | None = None
) -> DataFrame:
    """``find_values`` with the help of ``index``. ``searches`` without ``page_id`` are made on all pages.

    Values that are blank are found nowhere.
    """
    keys = ["_q", "page_id"] if "page_id" in searches.columns else ["_q"]
    asked = searches.withColumn("_q", _wanted(F.col("expected_value"))).where(F.col("_q") != "")
    length = F.char_length("_q")
    pieces = F.coalesce(*[F.when(length >= n, _pieces(F.col("_q"), n)) for n in reversed(_LENGTHS)])
    # saved, because four steps read them; cutting a value is dear for its bytes, so it is dealt out
    distinct = keep(asked.select("_q").distinct().repartition(asked.sparkSession.sparkContext.defaultParallelism))
    values = keep(distinct.select("_q", F.explode_outer(pieces).alias("piece")))
    # a piece that no page holds is the rarest of all
    sizes = index.join(values.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("_q").orderBy(F.coalesce("n", F.lit(0)), "piece")
    chosen = values.join(sizes, "piece", "left").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= _PIECES)
    chosen = chosen.withColumn("wanted", F.count("*").over(Window.partitionBy("_q"))).select("_q", "piece", "wanted")
    if len(keys) > 1:
        held = index.join(asked.select(*keys).distinct().join(chosen, "_q"), ["piece", "page_id"])
    else:
        held = spread_join(index, chosen, "piece")
    found = held.groupBy("_q", "page_id").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).where("n = wanted").select("_q", "page_id")
    found = keep(found)
    told = asked.join(found, keys).drop("_q")
    return find_values(told, docs, max_hits, preview_length, text_length)


def _searchable() -> Column:
    """What a search looks at, in its order: strings, then attributes; in small letters."""
    string = lambda s, j: F.struct(
        j.alias("text"), s["parent"].alias("elem"), F.lit(None).cast("string").alias("attribute"), F.lower(s["text"]).alias("low"),
        s["noise"].alias("noise"),
    )
    attribute = lambda name: F.transform(
        "elems",
        lambda e, i: F.struct(
            F.lit(None).cast("int").alias("text"), i.alias("elem"), F.lit(name).alias("attribute"),
            F.lower(F.try_element_at(e["attrs"], F.lit(name))).alias("low"), e["noise"].alias("noise"),
        ),
    )
    listed = F.concat(F.transform("texts", string), *[attribute(name) for name in SEARCHED_ATTRIBUTES])
    return F.filter(listed, lambda h: ~h["noise"] & h["low"].isNotNull())


def _hit(h: Column, preview_length: int | None, text_length: int | None) -> Column:
    elem = lambda i: F.get("elems", i)
    e = elem(h["elem"])
    place = lambda e: F.struct(e["tag"].alias("tag"), e["classes"].alias("classes"), F.coalesce(e["id"], F.lit("")).alias("id"))
    one = e["parent"]
    two = elem(one)["parent"]
    three = elem(two)["parent"]
    chain = F.transform(F.filter(F.array(one, two, three), lambda i: i >= 0), lambda i: place(elem(i)))
    marked = F.filter(chain, lambda p: (F.size(p["classes"]) > 0) | (p["id"] != "")).cast(_PLACE)
    in_text = h["attribute"].isNull()
    value = F.try_element_at(e["attrs"], h["attribute"])
    return F.struct(
        e["tag"].alias("tag"),
        e["classes"].alias("classes"),
        F.coalesce(e["id"], F.lit("")).alias("id"),
        F.when(in_text, marked).otherwise(F.array().cast(_PLACE)).alias("parent_chain"),
        F.when(in_text, cut(strip(F.get("texts", h["text"])["text"]), preview_length))
        .otherwise(F.concat(F.lit("["), h["attribute"], F.lit("] "), cut(value, preview_length)))
        .alias("text_preview"),
        _hint(e).alias("selector_hint"),
        h["attribute"].alias("attribute_found"),
        cut(F.when(in_text, F.array_join(strings_of(F.col("texts"), e, clean=True), "")).otherwise(value), text_length).alias("full_text"),
    )
