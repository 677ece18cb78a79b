"""Spans of pattern matches as native columns. Offsets count code points from 0; ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,stop:int,found:string>>"
TAGGED = "array<struct<start:int,number:int,kind:string,stop:int>>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once per row however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


PIECE = 128


def in_pieces(values: Column, start: Column, step: Callable[[Column, Column], Column], listed: str, kind: str) -> Column:
    """The list that a fold with state (at, ``listed``) appends to, over pieces of the values: no list is copied per value."""

    def piece(whole: Column, k: Column) -> Column:
        fresh = F.struct(whole["at"].alias("at"), start[listed].alias(listed))
        done = F.aggregate(F.slice(values, k * PIECE + 1, PIECE), fresh, step)
        return bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(whole["lists"], F.array(d[listed])).alias("lists")))

    pieces = F.sequence(F.lit(0), F.floor(F.size(values) / PIECE).cast("int"))
    return F.flatten(F.aggregate(pieces, F.struct(start["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("lists")), piece)["lists"])


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, stop, found). ``pattern`` never matches an empty text.

    Starts are running sums over the lengths of the gaps and matches, so the text is read twice and only if it matches. The sums
    are made in pieces, each of which is appended as one value: a text with very many matches takes time in proportion to them.
    """

    def place(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        stop = start + F.length(part["found"])
        one = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), part["found"].alias("found"))
        return F.struct(stop.cast("int").alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def spans(found: Column) -> Column:
        parts = F.zip_with(F.split(text, pattern, -1), found, lambda gap, x: F.struct(gap.alias("gap"), x.alias("found")))
        placed = bind(F.filter(parts, lambda p: p["found"].isNotNull()), lambda all_parts: in_pieces(all_parts, start, place, "spans", SPANS))
        return F.when(F.size(found) > 0, placed).otherwise(none)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def where(spans: Column, keep: Callable[[Column], Column]) -> Column:
    """The spans whose text passes."""
    return F.filter(spans, lambda s: keep(s["found"]))


def count_of(spans: Column, number: int) -> Column:
    """How many tagged spans are of the kind with this number."""
    return F.size(F.filter(spans, lambda s: s["number"] == number)).cast("long")


def tagged(spans: Column, number: int, kind: str) -> Column:
    """(start, number, kind, stop): sorts by start, then by the kinds' order."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))
    )


def listed(spans: Column) -> Column:
    """kind:start:stop of tagged spans in their order, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    )


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping tagged spans (sorted by start) replaced by ``mark``."""

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.concat(state["done"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(fresh, piece).otherwise(state["done"]).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    rest = F.aggregate(spans, start, cut, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
