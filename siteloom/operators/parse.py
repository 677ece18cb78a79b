"""Pages to document trees: tokens are cut in Python, the tree is made of them in Spark.

``parse_pages`` gives one row per page with two flat arrays, so tree questions about one page
need no shuffle and questions over many pages explode just the columns they use:

* ``elems[i]`` is the i-th element in document order (0 is the document itself). ``last`` is the
  number of its last descendant, so ``b`` lies below ``a`` exactly if ``a < b <= a.last``.
* ``texts[j]`` is the j-th string. The strings below an element are ``texts[t0:t1]``, so its text
  is a slice of the array and no join.

Brackets are matched by a running fold over the tokens of a page, inside its row: what is open stands in a list with the
innermost first, an end tag closes up to the nearest open element of its name or is ignored, no start tag closes another one,
and the end of the page closes what is open. The fold goes over pieces of tokens and appends what a piece yields as one
value, so a long page costs time in proportion to its tokens.
"""

from __future__ import annotations

import math

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.columns import let
from siteloom.functions.text import SPACE_CLASS, collapse, strip
from siteloom.operators import tokens
from siteloom.session import per_session

# the helper travels with the job, so executors need no copy of this package
register_pickle_by_value(tokens)

# Elements whose strings are no page text, elements a summary leaves out, elements that keep blank
# strings as they are, and attributes that hold a list of words.
OWN_STRING_TAGS = ("script", "style", "template", "rt", "rp")
NOISE_TAGS = ("script", "style", "noscript")
BLANK_TAGS = ("pre", "textarea")
WORD_LISTS = {
    "class": "*", "accesskey": "*", "dropzone": "*", "rel": ("a", "link", "area"), "rev": ("a", "link"), "headers": ("td", "th"),
    "accept-charset": ("form",), "archive": ("object",), "sizes": ("icon",), "sandbox": ("iframe",), "for": ("output",),
}

ELEM = (
    "struct<parent:int,last:int,depth:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,"
    "idx:int,ridx:int,tidx:int,rtidx:int,prev:int,t0:int,t1:int,noise:boolean>"
)
TEXT = "struct<parent:int,before:int,kind:string,noise:boolean,text:string>"
DOC_SCHEMA = f"page_id bigint, url string, elems array<{ELEM}>, texts array<{TEXT}>, error string"

# Characters of HTML that one task parses.
CHARS_PER_TASK = 1_000_000

_TOKENS = "page_id bigint, url string, tokens array<struct<kind:string,value:string,attrs:map<string,string>>>, error string"
# Tokens of a piece of the fold.
_PIECE = 128
# an open element: what it passes down to its strings, and its children so far, in all and by tag
_OPEN = "struct<number:int,owner:string,noise:boolean,blank:boolean,kids:int,latest:int,kinds:array<struct<tag:string,n:int>>>"
_BEGUN = "struct<parent:int,depth:int,idx:int,tidx:int,prev:int,t0:int,noise:boolean,at:int>"
_CLOSED = "struct<number:int,last:int,t1:int,kids:int,kinds:array<struct<tag:string,n:int>>>"
_STRING = "struct<parent:int,before:int,kind:string,noise:boolean,blank:boolean,at:int>"
_PIECES = {"begun": _BEGUN, "closed": _CLOSED, "strings": _STRING}
_OUT = "struct<" + ",".join(f"{k}:array<{v}>" for k, v in _PIECES.items()) + ">"
_STATE = f"struct<names:array<string>,open:array<{_OPEN}>,n:int,n_texts:int,at:int,out:{_OUT}>"
_WHOLE = f"struct<names:array<string>,open:array<{_OPEN}>,n:int,n_texts:int,at:int,outs:array<{_OUT}>>"
_KEPT = ("names", "open", "n", "n_texts", "at")


def spread_pages(pages: DataFrame) -> DataFrame:
    """Pages dealt out evenly, in tasks of about ``CHARS_PER_TASK`` characters: more pages make more tasks and not longer ones.

    Parsing is dear for its bytes, so neither the files of a source nor the sizes of a shuffle tell how many tasks it needs. ``pages``
    are read twice, so they should be a saved table.
    """
    chars = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    return pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / CHARS_PER_TASK)))


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to one document row per page.

    Filter ``pages`` first: no predicate passes through this step. Save the result (Parquet) when
    more than one question is asked; parsing is the dear part and is then paid once.
    """
    cut = pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(tokens.tokenize_batches, _TOKENS)
    return cut.select("page_id", "url", F.inline(F.array(_tree())), "error").select("page_id", "url", "elems", "texts", "error")


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def _state(state: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(k, state[k]).alias(k) for k in (*_KEPT, "out")]).cast(_STATE)


def _emit(state: Column, name: str, more: Column) -> Column:
    return F.struct(*[(F.concat(state["out"][k], more) if k == name else state["out"][k]).alias(k) for k in _PIECES]).cast(_OUT)


def _closed(state: Column, opened: Column) -> Column:
    return F.struct(
        opened["number"].alias("number"), (state["n"] - 1).alias("last"), state["n_texts"].alias("t1"), opened["kids"].alias("kids"), opened["kinds"].alias("kinds")
    ).cast(_CLOSED)


def _starts(state: Column, token: Column) -> Column:
    def below(parent: Column) -> Column:
        tag = token["value"]
        same = F.filter(parent["kinds"], lambda k: k["tag"] == tag)
        tidx = F.coalesce(F.get(same, F.lit(0))["n"], _int(0)) + 1
        noise = parent["noise"] | tag.isin(*NOISE_TAGS)
        counted = F.concat(F.filter(parent["kinds"], lambda k: k["tag"] != tag), F.array(F.struct(tag.alias("tag"), tidx.alias("n"))))
        updated = F.struct(
            *[parent[k].alias(k) for k in ("number", "owner", "noise", "blank")],
            (parent["kids"] + 1).alias("kids"), state["n"].alias("latest"), counted.alias("kinds"),
        ).cast(_OPEN)
        opened = F.struct(
            state["n"].alias("number"), F.when(tag.isin(*OWN_STRING_TAGS), tag).otherwise(parent["owner"]).alias("owner"), noise.alias("noise"),
            (parent["blank"] | tag.isin(*BLANK_TAGS)).alias("blank"), _int(0).alias("kids"), _int(-1).alias("latest"), F.array().alias("kinds"),
        ).cast(_OPEN)
        begun = F.struct(
            parent["number"].alias("parent"), F.size(state["names"]).alias("depth"), (parent["kids"] + 1).alias("idx"), tidx.alias("tidx"),
            parent["latest"].alias("prev"), state["n_texts"].alias("t0"), noise.alias("noise"), state["at"].alias("at"),
        ).cast(_BEGUN)
        return _state(
            state, names=F.concat(F.array(tag), state["names"]), open=F.concat(F.array(opened, updated), _after(state["open"], _int(1))),
            n=state["n"] + 1, at=state["at"] + 1, out=_emit(state, "begun", F.array(begun)),
        )

    return let(F.get(state["open"], F.lit(0)), below)


def _after(values: Column, n: Column) -> Column:
    """The values without the first ``n``."""
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def _ends(state: Column, token: Column) -> Column:
    """Closes up to the nearest open element of the name; the document itself has none."""
    return let(
        F.array_position(state["names"], token["value"]).cast("int"),
        lambda n: F.when(n == 0, _state(state, at=state["at"] + 1)).otherwise(
            _state(
                state, names=_after(state["names"], n), open=_after(state["open"], n), at=state["at"] + 1,
                out=_emit(state, "closed", F.transform(F.slice(state["open"], F.lit(1), n), lambda o: _closed(state, o))),
            )
        ),
    )


def _string(state: Column, token: Column) -> Column:
    def inside(parent: Column) -> Column:
        kind = F.when(token["kind"] == "text", F.coalesce(parent["owner"], F.lit("text"))).otherwise(token["kind"])
        one = F.struct(
            parent["number"].alias("parent"), state["n"].alias("before"), kind.alias("kind"), parent["noise"].alias("noise"),
            parent["blank"].alias("blank"), state["at"].alias("at"),
        ).cast(_STRING)
        return _state(state, n_texts=state["n_texts"] + 1, at=state["at"] + 1, out=_emit(state, "strings", F.array(one)))

    return let(F.get(state["open"], F.lit(0)), inside)


def _step(state: Column, token: Column) -> Column:
    kind = token["kind"]
    return F.when(kind == "start", _starts(state, token)).when(kind == "end", _ends(state, token)).otherwise(_string(state, token))


def _folded() -> Column:
    """The fold over the pieces of a page's tokens."""
    nothing = F.struct(*[F.array().alias(k) for k in _PIECES]).cast(_OUT)
    root = F.struct(
        _int(0).alias("number"), F.lit(None).cast("string").alias("owner"), F.lit(False).alias("noise"), F.lit(False).alias("blank"),
        _int(0).alias("kids"), _int(-1).alias("latest"), F.array().alias("kinds"),
    ).cast(_OPEN)
    start = F.struct(
        F.array(F.lit("[document]")).alias("names"), F.array(root).alias("open"), _int(1).alias("n"), _int(0).alias("n_texts"), _int(0).alias("at"),
        F.array().alias("outs"),
    ).cast(_WHOLE)

    def piece(whole: Column, p: Column) -> Column:
        begin = F.struct(*[whole[k].alias(k) for k in _KEPT], nothing.alias("out")).cast(_STATE)
        done = F.aggregate(F.slice("tokens", p * _PIECE + 1, _PIECE), begin, _step)
        return let(
            done,
            lambda d: F.struct(*[d[k].alias(k) for k in _KEPT], F.concat(whole["outs"], F.array(d["out"])).alias("outs")).cast(_WHOLE),
        )

    pieces = F.sequence(F.lit(0), F.floor(F.size("tokens") / _PIECE).cast("int"))
    return F.aggregate(pieces, start, piece)


def _words(tag: Column, name: Column, value: Column) -> Column:
    """An attribute's value; of a list of words, the words with one blank between them."""
    listed = F.lit(False)
    for key, tags in WORD_LISTS.items():
        listed = listed | ((name == key) & (F.lit(True) if tags == "*" else tag.isin(*tags)))
    return F.when(listed & value.rlike(SPACE_CLASS), strip(collapse(value))).otherwise(value)


@per_session
def _tree() -> Column:
    """``elems`` and ``texts`` of a row of tokens."""

    def made(whole: Column) -> Column:
        pieces = lambda name: F.flatten(F.transform(whole["outs"], lambda o: o[name]))
        # by number: everything is closed once, at the end of the page at the latest
        rest = F.transform(whole["open"], lambda o: _closed(whole, o))
        closed = F.array_sort(F.concat(pieces("closed"), rest))
        return let(closed, lambda ends: F.struct(_elems(pieces("begun"), ends).alias("elems"), _texts(pieces("strings")).alias("texts")))

    return let(_folded(), made)


def _elems(begun: Column, ends: Column) -> Column:
    nothing = F.lit(None).cast("string")
    attrs = F.array().cast("array<string>")
    root = F.struct(
        _int(-1).alias("parent"), F.get(ends, F.lit(0))["last"].alias("last"), _int(0).alias("depth"), F.lit("[document]").alias("tag"), nothing.alias("id"),
        attrs.alias("classes"), F.map_from_arrays(attrs, attrs).alias("attrs"), *[_int(1).alias(k) for k in ("idx", "ridx", "tidx", "rtidx")],
        _int(-1).alias("prev"), _int(0).alias("t0"), F.get(ends, F.lit(0))["t1"].alias("t1"), F.lit(False).alias("noise"),
    ).cast(ELEM)

    def elem(b: Column, i: Column) -> Column:
        token, end, parent = F.get(F.col("tokens"), b["at"]), F.get(ends, i + 1), F.get(ends, b["parent"])
        tag = token["value"]
        same = F.get(F.filter(parent["kinds"], lambda k: k["tag"] == tag), F.lit(0))["n"]
        return let(
            F.transform_values(token["attrs"], lambda k, v: _words(tag, k, v)),
            lambda attrs: F.struct(
                b["parent"].alias("parent"), end["last"].alias("last"), b["depth"].alias("depth"), tag.alias("tag"),
                F.try_element_at(attrs, F.lit("id")).alias("id"),
                F.filter(F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), " "), lambda c: c != "").alias("classes"), attrs.alias("attrs"),
                b["idx"].alias("idx"), (parent["kids"] - b["idx"] + 1).alias("ridx"), b["tidx"].alias("tidx"), (same - b["tidx"] + 1).alias("rtidx"),
                b["prev"].alias("prev"), b["t0"].alias("t0"), end["t1"].alias("t1"), b["noise"].alias("noise"),
            ).cast(ELEM),
        )

    return F.concat(F.array(root), F.transform(begun, elem))


def _texts(strings: Column) -> Column:
    def text(s: Column) -> Column:
        value = F.get(F.col("tokens"), s["at"])["value"]
        blank = ~s["blank"] & value.rlike(r"^[ \n\t\f\r]*$")
        return F.struct(
            s["parent"].alias("parent"), s["before"].alias("before"), s["kind"].alias("kind"), s["noise"].alias("noise"),
            F.when(blank, F.when(value.contains("\n"), "\n").otherwise(" ")).otherwise(value).alias("text"),
        ).cast(TEXT)

    return F.transform(strings, text)


def dom_nodes(docs: DataFrame) -> DataFrame:
    """One row per node, elements and strings numbered together in document order."""
    elems = docs.select(
        "page_id",
        F.transform(
            "elems",
            lambda e, i: F.struct(
                (i + e["t0"]).alias("node"),
                F.when(e["parent"] >= 0, e["parent"] + F.get(F.col("elems"), e["parent"])["t0"]).alias("parent"),
                (e["last"] + e["t1"]).alias("last"),
                e["depth"].alias("depth"),
                F.lit("element").alias("kind"),
                e["tag"].alias("tag"),
                e["id"].alias("elem_id"),
                e["classes"].alias("classes"),
                e["attrs"].alias("attrs"),
                e["noise"].alias("noise"),
                F.lit(None).cast("string").alias("text"),
            ),
        ).alias("es"),
        F.transform(
            "texts",
            lambda s, j: F.struct(
                (j + s["before"]).alias("node"),
                (s["parent"] + F.get(F.col("elems"), s["parent"])["t0"]).alias("parent"),
                (j + s["before"]).alias("last"),
                (F.get(F.col("elems"), s["parent"])["depth"] + 1).alias("depth"),
                s["kind"].alias("kind"),
                F.lit(None).cast("string").alias("tag"),
                F.lit(None).cast("string").alias("elem_id"),
                F.lit(None).cast("array<string>").alias("classes"),
                F.lit(None).cast("map<string,string>").alias("attrs"),
                s["noise"].alias("noise"),
                s["text"].alias("text"),
            ),
        ).alias("ss"),
    )
    # the outer form computes the array once; there is always the document itself
    return elems.select("page_id", F.inline_outer(F.concat("es", "ss")))


def strings_of(texts: Column, elem: Column, clean: bool = False) -> Column:
    """Stripped, non-empty strings below an element; ``clean`` leaves script, style and noscript out."""
    wanted = F.when(elem["tag"].isin(*OWN_STRING_TAGS), elem["tag"]).otherwise("text")
    below = F.slice(texts, elem["t0"] + 1, elem["t1"] - elem["t0"])
    seen = (lambda s: (s["kind"] == wanted) & ~s["noise"]) if clean else (lambda s: s["kind"] == wanted)
    return F.filter(F.transform(F.filter(below, seen), lambda s: strip(s["text"])), lambda t: t != "")


def text_of(texts: Column, elem: Column, clean: bool = False) -> Column:
    """Strings below an element, one blank between them."""
    return F.array_join(strings_of(texts, elem, clean), " ")
