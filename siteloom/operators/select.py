"""Selector matching over documents: one pass over the elements, then windows.

Only elements that pass some compound leave the document row. Combinators are settled by running
maxima in document order (an element lies below an earlier one exactly if the largest ``last`` of
the earlier ones reaches it), so no pairs of elements are formed. Nested lists (``:has``, ``:is``, ``:not``) are settled
first, level by level from the innermost: their matches are carried upward, in reverse document order, by the same maxima.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions.columns import let
from siteloom.functions.selectors import compile_selectors, step_holds
from siteloom.operators.skew import tasks_for
from siteloom.session import per_session

_FAR = 2147483647
DOCUMENT = "[document]"


_NESTED = ("sub", "level", "rel", "needs")


def candidates(
    tasks: DataFrame, keys: list[str], payload: Callable[[Column, Column], dict[str, Column]] | None = None, depth: int = 0
) -> DataFrame:
    """Elements that pass a compound of one of the row's ``steps``.

    ``tasks`` holds ``keys``, ``elems``, ``texts`` and ``steps`` (selector steps with a number
    ``sel``). ``payload(elem, step)`` names further columns to carry along. The page is searched
    inside its row; only the elements found become rows, so no page is copied per element. ``depth`` is that of
    ``steps_sizes``: selectors without nested lists carry nothing for them.
    """
    carried = ("sel", "alt", "step", "n", "comb", "next_comb", *(_NESTED if depth else ()))

    def entry(s: Column, e: Column, node: Column) -> Column:
        extra = payload(e, s) if payload else {}
        return F.struct(
            *[s[name].alias(name) for name in carried],
            node.alias("node"),
            *[e[name].alias(name) for name in ("last", "parent", "prev")],
            *[column.alias(name) for name, column in extra.items()],
        )

    found = F.flatten(
        F.transform("_passed", lambda p: F.transform(p["steps"], lambda s: entry(s, F.get("elems", p["node"]), p["node"])))
    )
    # the outer form, because the plain one tests the array for emptiness by computing it once more
    rows = tasks.withColumn("_passed", _passed(depth)).withColumn("_found", found).select(*keys, F.inline_outer("_found"))
    return rows.where(F.col("sel").isNotNull())


@per_session
def _passed(depth: int) -> Column:
    """Elements of the row with the steps they pass."""
    # the document itself is no element; only a whole-page scope asks for it by name
    real = lambda s, node: (node > 0) | (s["tag"] == DOCUMENT)
    passed = lambda e, node: F.filter("steps", lambda s: step_holds(s, node, e, F.col("texts")) & real(s, node))

    def useful(own: Column, rounds: int) -> Column:
        # what a list needs may be a list again, so there is a round for each level
        return own if rounds == 0 else let(own, lambda o: useful(F.filter(o, lambda s: _useful(s, o)), rounds - 1))

    each = F.transform("elems", lambda e, node: F.struct(node.alias("node"), useful(passed(e, node), depth).alias("steps")))
    return F.filter(each, lambda p: F.size(p["steps"]) > 0)


def _useful(s: Column, own: Column) -> Column:
    """Whether a step that an element passes can matter, as far as the element itself tells.

    A list like ``:is()`` is about the element itself: one of its alternatives must be among the steps it passes (``own``), and an
    alternative matters only where the compound that needs it passes. So ``:has(a)`` inside ``.x:is(:has(a), b)`` is no candidate everywhere.
    """
    passes = lambda sub: F.exists(own, lambda t: (t["sel"] == s["sel"]) & (t["sub"] == sub))
    answered = F.forall(
        s["needs"],
        lambda n: n["negate"] | (n["rel"] != "self") | F.exists(s["needs"], lambda m: (m["list"] == n["list"]) & passes(m["sub"])),
    )
    wanted = (s["sub"] < 0) | (s["rel"] != "self") | F.exists(
        own, lambda t: (t["sel"] == s["sel"]) & F.exists(t["needs"], lambda n: n["sub"] == s["sub"])
    )
    return answered & wanted


def _nested(found: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Candidates of the selectors themselves whose nested lists hold.

    Level by level, every candidate asks for each of its needs; the matches of lower levels answer. Both meet under one key
    (the element, its parent, its brother or the page), in document order or against it, and a running maximum over the
    answers before the question tells whether one of them reaches it. So a round is two windows, whatever the number of pairs.
    """
    candidate = ["sel", "alt", "step", "sub", "node"]
    own = F.struct(
        F.lit(0).alias("place"), F.lit(-1).alias("list"), F.lit(False).alias("negate"), F.col("rel").alias("rel"), F.col("sub").alias("asked")
    )
    rows = found
    for level in range(1, depth + 1):
        asks = (F.col("level") == level) & (F.size("needs") > 0)
        questions = F.transform(
            "needs",
            lambda n, i: F.struct(i.alias("place"), n["list"].alias("list"), n["negate"].alias("negate"), n["rel"].alias("rel"), n["sub"].alias("asked")),
        )
        role = F.when(asks, questions).otherwise(F.array(own))
        part = rows.withColumn("asks", asks).withColumn("role", F.explode(role))
        rel, node = F.col("role.rel"), F.col("node")
        answers = ~F.col("asks") & (F.col("level") < level) & (F.col("sub") >= 0)
        near = rel.isin("self", "child", "parent", "next", "prev")
        meet = (
            F.when(rel == "self", node)
            .when(rel.isin("earlier", "later"), F.col("parent"))
            .when(rel.isin("above", "below"), -1)
            .when(F.col("asks") & rel.isin("parent"), F.col("parent"))
            .when(F.col("asks") & rel.isin("prev"), F.col("prev"))
            .when(F.col("asks"), node)
            .when(rel == "child", F.col("parent"))
            .when(rel == "next", F.col("prev"))
            .otherwise(node)
        )
        against = rel.isin("below", "later")
        at = F.when(near, F.when(F.col("asks"), 0).otherwise(-_FAR)).when(against, -node).otherwise(node)
        reach = F.when(answers, F.when(rel == "above", F.col("last")).when(rel == "below", -node).otherwise(_FAR))
        goal = F.when(rel == "above", node).when(rel == "below", -F.col("last")).otherwise(0)
        before = Window.partitionBy(*keys, "sel", "role.asked", "meet").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
        together = Window.partitionBy(*keys, *candidate)
        met = part.withColumns({"meet": meet, "at": at, "reach": reach}).withColumn("reach", F.max("reach").over(before))
        held = F.collect_set(F.when(F.col("asks") & (F.col("reach") >= goal), F.col("role.list")))
        holds = F.forall("needs", lambda n: F.array_contains("held", n["list"]) != n["negate"])
        rows = (
            met.withColumn("held", held.over(together))
            .where((F.col("role.place") == 0) & (~F.col("asks") | holds))
            .drop("asks", "role", "meet", "at", "reach", "held")
        )
    return rows.where(F.col("sub") < 0).drop(*_NESTED)


def settle(found: DataFrame, keys: list[str], max_steps: int, max_alts: int, depth: int = 0) -> DataFrame:
    """Keeps the candidates whose whole selector holds; one row per selector and element."""
    if depth:
        found = _nested(found, keys, depth)
    step, comb, follow = F.col("step"), F.col("comb"), F.col("next_comb")
    helpers = ["alt", "step", "n", "comb", "next_comb", "parent", "prev", "alive", "meet"]
    rows = found.withColumn("alive", F.lit(True))
    for k in range(1, max_steps):
        # both sides of the combinator meet under one key: the document, the parent or the brother
        meet = (
            F.when((step == k) & comb.isin(">", "~"), F.col("parent"))
            .when((step == k) & (comb == "+"), F.col("prev"))
            .when((step == k - 1) & follow.isin(">", "+"), F.col("node"))
            .when((step == k - 1) & (follow == "~"), F.col("parent"))
            .when(step.isin(k - 1, k), -1)
            .otherwise(-2)
        )
        before = Window.partitionBy(*keys, "sel", "alt", "meet").orderBy("node").rangeBetween(
            Window.unboundedPreceding, -1
        )
        reach = F.when(step == k - 1, F.when(follow == " ", F.col("last")).otherwise(_FAR))
        rows = (
            rows.withColumn("meet", meet)
            .withColumn("reach", F.max(reach).over(before))
            .where((step != k) | (F.col("reach") >= F.col("node")))
            .drop("reach")
        )
    done = rows.where(step == F.col("n") - 1).drop(*helpers)
    if max_alts > 1:
        done = done.dropDuplicates([*keys, "sel", "node"])
    return done


def select(docs: DataFrame, selector: str, keys: list[str] | None = None) -> DataFrame:
    """All elements of each document that match ``selector``, as ``(page_id, node, last)`` rows."""
    return select_many(docs, {"": selector}, keys).drop("selector_id")


def select_many(docs: DataFrame, selectors: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Several selectors in one pass: ``(page_id, selector_id, node, last, tag, t0, t1)``. ``docs`` are counted, so they should be saved."""
    keys = keys or ["page_id"]
    compiled, max_steps, max_alts, depth = literal_steps(tuple(selectors.values()))
    pages = docs.select(*{"page_id": 0, **dict.fromkeys(keys), "elems": 0, "texts": 0})
    if max_steps > 1 or depth:
        # all windows of all steps stay inside a page, so this is the only exchange, and it moves pages, which are smaller than matches
        pages = pages.repartition(tasks_for(docs.count(), docs.sparkSession), "page_id")
    found = candidates(
        pages.withColumn("steps", compiled),
        keys,
        lambda e, s: {"tag": e["tag"], "t0": e["t0"], "t1": e["t1"]},
        depth,
    )
    named = F.element_at(F.array(*[F.lit(name) for name in selectors]), F.col("sel") + 1)
    return settle(found, keys, max_steps, max_alts, depth).withColumn("selector_id", named).drop("sel")


@per_session
def literal_steps(selectors: tuple[str, ...]) -> tuple[Column, int, int, int]:
    """Selectors given by the caller as one constant column, numbered from 0, and their sizes."""
    table = SparkSession.active().createDataFrame([(i, s) for i, s in enumerate(selectors)], "sel int, selector string")
    compiled = compile_selectors(table).withColumn(
        "steps", F.transform("steps", lambda s: s.withField("sel", F.col("sel")))
    )
    steps = compiled.select(F.explode("steps").alias("s"))
    rows = steps.select("s.n", "s.alt", "s.level", F.to_json("s").alias("s")).collect()
    constant = F.from_json(F.lit("[" + ",".join(r["s"] for r in rows) + "]"), compiled.schema["steps"].dataType)
    most = lambda name, least: max((r[name] for r in rows), default=least)
    return constant, most("n", 1), most("alt", 0) + 1, most("level", 0)


def steps_sizes(compiled: DataFrame) -> tuple[int, int, int]:
    """Most steps, most comma alternatives and deepest nesting, which decide how many windows are needed."""
    row = compiled.agg(
        F.max(F.array_max(F.transform("steps", lambda s: s["n"]))).alias("steps"),
        F.max(F.array_max(F.transform("steps", lambda s: s["alt"] + 1))).alias("alts"),
        F.max(F.array_max(F.transform("steps", lambda s: s["level"]))).alias("depth"),
    ).first()
    return row["steps"] or 1, row["alts"] or 1, row["depth"] or 0


def first_below(rows: DataFrame, keys: list[str], is_match: Column, hit: Column) -> Column:
    """For a scope row: the first match in document order that lies inside it, else null.

    Matches and scopes stand in one frame; the next match after the scope's own element is found by
    one window in reverse order and counts if the scope still reaches it. ``hit`` must hold ``node``.
    """
    after = Window.partitionBy(*keys).orderBy(F.col("node").desc()).rangeBetween(Window.unboundedPreceding, -1)
    nearest = F.last(F.when(is_match, hit), ignorenulls=True).over(after)
    return F.when(nearest["node"] <= F.col("last"), nearest)


def select_one(docs: DataFrame, scope: str, selector: str) -> DataFrame:
    """First match of ``selector`` inside each match of ``scope`` (null where there is none)."""
    both = select_many(docs, {"scope": scope, "match": selector})
    is_match = F.col("selector_id") == "match"
    hit = F.struct("node", "last", "tag", "t0", "t1")
    return (
        both.withColumn("hit", first_below(both, ["page_id"], is_match, hit))
        .where(~is_match)
        .select("page_id", "node", "last", "hit")
    )
