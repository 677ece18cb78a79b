r"""CSS selectors as data.

A selector string becomes an array of steps (one per compound, with the combinator before it), so
the selectors of all sites sit in a table and are matched by one job. The split is a handful of
regular expressions over the selector column; nothing is interpreted on the driver.

Supported: comma lists, ``tag``, ``*``, ``#id``, ``.class``, ``[attr]`` with ``= ~= ^= $= *= |= !=``,
descendant, ``>``, ``+``, ``~``, the ``first/last/only/nth/nth-last`` ``-child`` and ``-of-type``
family, ``:root``, ``:empty``, ``:link``, ``:contains("x")``, and, nested to any depth, ``:not(...)``, ``:is(...)``,
``:where(...)`` and ``:has(...)`` with whole selector lists (in ``:has`` also with a leading combinator). A leading
combinator elsewhere and any other selector compile to no steps and so match nothing; ``is_supported`` tells them apart.

A nested list becomes further entries, one per compound of the list. An entry *needs* others in a relation to it: the outer
compound needs one of the list's alternatives, the compounds of an alternative need each other along its combinators. The
entries of one selector form a tree whose leaves need nothing; ``level`` is the height of an entry in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.columns import let
from siteloom.functions.text import strip
from siteloom.operators.parse import strings_of
from siteloom.session import per_session

_LETTER = r"[_a-zA-Z\x{80}-\x{10ffff}]|\\[^\n]"
_IDENT = rf"(?:--|-?(?:{_LETTER}))(?:[-0-9]|{_LETTER})*+"
_STRING = r"""(?:"[^"\n]*+"|'[^'\n]*+')"""
_ATTR = rf"\[\s*{_IDENT}\s*(?:[~^$*|!]?=\s*(?:{_STRING}|{_IDENT})\s*(?:[iIsS]\s*)?)?\]"
_NTH = r"\(\s*(?:even|odd|[+-]?\d*n(?:\s*[+-]\s*\d+)?|[+-]?\d+)\s*\)"
_PSEUDO = (
    rf":(?:(?:first|last|only)-(?:child|of-type)|empty|root|(?:any-)?link|nth-(?:last-)?(?:child|of-type){_NTH}"
    rf"|(?:-soup-)?contains\(\s*(?:{_STRING}|{_IDENT})\s*\))"
)
_PART = rf"(?:#{_IDENT}|\.{_IDENT}|{_ATTR}|{_PSEUDO})"
_PLAIN = rf"(?:(?:{_IDENT}|\*){_PART}*+|{_PART}++)"
_NOT = rf":not\(\s*{_PLAIN}(?:\s*,\s*{_PLAIN})*+\s*\)"
# stands for the n-th nested list, once that is taken out
_MARK = r":\x{f8ff}\d+"
_COMPOUND = rf"(?:(?:{_IDENT}|\*)(?:{_PART}|{_NOT}|{_MARK})*+|(?:{_PART}|{_NOT}|{_MARK})++)"
_GAP = r"(?:\s*[>+~,]\s*|\s+)"
_LIST = rf"{_COMPOUND}(?:{_GAP}{_COMPOUND})*"
_WHOLE = rf"^{_LIST}$"
# in :has() every alternative may begin with a combinator
_RELATIVE_GAP = r"(?:\s*,\s*[>+~]?\s*|\s*[>+~]\s*|\s+)"
_RELATIVE = rf"^\s*[>+~]?\s*{_COMPOUND}(?:{_RELATIVE_GAP}{_COMPOUND})*$"
# before the first innermost nested list, its kind, its body and what follows; quoted text is skipped as a whole
_OPENS = r":(?:is|where|matches|not|has)\("
_INNERMOST = (
    rf"(?s)^((?:{_STRING}|{_NOT}|[^\"'])*?)(?!{_NOT}):(is|where|matches|not|has)\(\s*"
    rf"((?:{_STRING}|{_NOT}|{_PSEUDO}|[^()\"'])++)\)(.*)$"
)
_NEED = "struct<list:int,negate:boolean,rel:string,sub:int>"
_SUB = f"array<struct<kind:string,parts:array<struct<sign:string,body:string,pos:int,left:int>>,base:int,top:int>>"
# how a compound stands to the one that needs it, by the combinator between them
_DOWN = {" ": "below", ">": "child", "+": "next", "~": "later"}
_UP = {" ": "above", ">": "parent", "+": "prev", "~": "earlier"}
#: Numbers of the compounds of one nested list.
_WIDTH = 10_000


def _trimmed(selector: Column) -> Column:
    return F.regexp_replace(selector, r"^\s+|\s+$", "")


def _marks(text: Column) -> Column:
    """Numbers of the nested lists that stand in ``text``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r":\x{f8ff}(\d+)"), F.lit(1)), lambda m: m.cast("int"))


def _chained(text: Column) -> Column:
    """The compounds of a list: combinator before, text, place in its alternative and how many follow there."""
    token = lambda t: F.struct(
        F.when(F.regexp_extract(t, rf"^({_RELATIVE_GAP}?)", 1).rlike(r"^\s+$"), " ")
        .otherwise(F.regexp_replace(F.regexp_extract(t, rf"^({_RELATIVE_GAP}?)", 1), r"\s", ""))
        .alias("sign"),
        F.regexp_replace(t, rf"^{_RELATIVE_GAP}", "").alias("body"),
    )
    tokens = F.transform(F.regexp_extract_all(text, F.lit(rf"({_RELATIVE_GAP}?{_COMPOUND})"), F.lit(0)), token)

    def placed(tokens: Column) -> Column:
        starts = F.filter(
            F.transform(tokens, lambda t, i: F.when((i == 0) | t["sign"].startswith(","), i)), lambda i: i.isNotNull()
        )
        return F.transform(
            tokens,
            lambda t, i: F.struct(
                F.regexp_replace(t["sign"], ",", "").alias("sign"),
                t["body"].alias("body"),
                (i - F.array_max(F.filter(starts, lambda a: a <= i))).cast("int").alias("pos"),
                (F.coalesce(F.array_min(F.filter(starts, lambda a: a > i)), F.size(tokens)) - i - 1).cast("int").alias("left"),
            ),
        )

    return let(tokens, placed)


def _unnest(selector: Column) -> Column:
    """The selector with its nested lists taken out, innermost first: ``text`` and ``subs``. An unsupported list makes it null."""

    def step(state: Column, i: Column) -> Column:
        part = lambda k: F.regexp_extract(state["text"], _INNERMOST, k)
        kind, body = part(2), _trimmed(part(3))
        fits = F.when(kind == "has", body.rlike(_RELATIVE)).otherwise(body.rlike(_WHOLE))

        def added(parts: Column) -> Column:
            inner = F.transform(
                F.flatten(F.transform(parts, lambda p: _marks(p["body"]))), lambda m: F.get(state["subs"], m)["top"] + 1
            )
            base = F.coalesce(F.array_max(inner), F.lit(0))
            return F.struct(
                kind.alias("kind"), parts.alias("parts"), base.alias("base"),
                (base + F.array_max(F.transform(parts, lambda p: p["pos"]))).alias("top"),
            )

        more = F.struct(
            F.concat(part(1), F.lit(":"), F.size(state["subs"]).cast("string"), part(4)).alias("text"),
            F.concat(state["subs"], F.array(let(_chained(body), added))).cast(_SUB).alias("subs"),
        )
        none = F.struct(F.lit(None).cast("string").alias("text"), state["subs"].alias("subs"))
        return F.when(~state["text"].rlike(_INNERMOST), state).when(fits, more).otherwise(none)

    n = F.size(F.regexp_extract_all(selector, F.lit(rf"({_OPENS})"), F.lit(0)))
    rounds = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    start = F.struct(_trimmed(selector).alias("text"), F.array().cast(_SUB).alias("subs"))
    return F.aggregate(rounds, start, step)


def is_supported(selector: Column, nested: bool = True) -> Column:
    """Whether a selector matches anything here; without ``nested``, whether it does so without nested lists (plain ``:not()`` is none)."""
    text = _unnest(selector)["text"] if nested else _trimmed(selector)
    return F.coalesce(text.rlike(_WHOLE), F.lit(False))


def _plain_name(value: Column) -> Column:
    return F.regexp_replace(value, r"\\(.)", "$1")


def _unquoted(value: Column) -> Column:
    quoted = F.substr(value, F.lit(2), F.length(value) - 2)
    return F.when(value.startswith('"') | value.startswith("'"), quoted).otherwise(_plain_name(value))


def _attr_test(part: Column) -> Column:
    pattern = rf"^\[\s*({_IDENT})\s*(?:([~^$*|!]?=)\s*({_STRING}|{_IDENT})\s*([iIsS]?)\s*)?\]$"
    name = F.lower(_plain_name(F.regexp_extract(part, pattern, 1)))
    flag = F.lower(F.regexp_extract(part, pattern, 4))
    # the value of "type" ignores case in HTML
    ignore_case = (flag == "i") | ((name == "type") & (flag == ""))
    return F.struct(
        name.alias("name"),
        F.regexp_extract(part, pattern, 2).alias("op"),
        _unquoted(F.regexp_extract(part, pattern, 3)).alias("value"),
        ignore_case.alias("ignore_case"),
    )


def _pseudo_test(part: Column) -> Column:
    name = F.regexp_extract(part, r"^:([-a-z]+)", 1)
    arg = F.regexp_replace(F.regexp_extract(part, r"(?s)^:[-a-z]+\(\s*(.*?)\s*\)$", 1), r"^\s+|\s+$", "")
    nth = F.regexp_replace(arg, r"\s", "")
    times = F.regexp_extract(nth, r"^([+-]?\d*)n", 1)
    is_step = nth.rlike(r"^[+-]?\d*n")
    a = (
        F.when(nth.isin("even", "odd"), 2)
        .when(is_step & times.isin("", "+"), 1)
        .when(is_step & (times == "-"), -1)
        .when(is_step, times.try_cast("int"))
        .otherwise(0)
    )
    offset = F.regexp_extract(nth, r"n([+-]\d+)$", 1)
    b = (
        F.when(nth == "odd", 1)
        .when(is_step | (nth == "even"), F.coalesce(offset.try_cast("int"), F.lit(0)))
        .otherwise(F.coalesce(nth.try_cast("int"), F.lit(1)))
    )
    return F.struct(name.alias("name"), a.cast("int").alias("a"), b.cast("int").alias("b"), _unquoted(arg).alias("arg"))


def _plain_test(text: Column, negate: bool) -> Column:
    tag = F.lower(_plain_name(F.regexp_extract(text, rf"^({_IDENT})", 1)))
    parts = F.regexp_extract_all(F.regexp_replace(text, _MARK, ""), F.lit(rf"({_NOT}|{_PART})"), F.lit(0))
    rest = lambda start: F.filter(parts, lambda p: p.startswith(start) & ~p.startswith(":not("))
    return F.struct(
        F.lit(negate).alias("negate"),
        F.when(tag != "", tag).alias("tag"),
        F.transform(rest("#"), lambda p: _plain_name(F.substr(p, F.lit(2)))).alias("ids"),
        F.transform(rest("."), lambda p: _plain_name(F.substr(p, F.lit(2)))).alias("classes"),
        F.transform(rest("["), _attr_test).alias("attrs"),
        F.transform(rest(":"), _pseudo_test).alias("pseudos"),
    )


def _tests(text: Column) -> Column:
    """The compound itself and what its ``:not()`` parts exclude, as one list of tests."""
    excluded = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(f"({_NOT})"), F.lit(0)),
            lambda p: F.regexp_extract_all(F.substr(p, F.lit(6)), F.lit(f"({_PLAIN})"), F.lit(0)),
        )
    )
    return F.concat(F.array(_plain_test(text, False)), F.transform(excluded, lambda t: _plain_test(t, True)))


def compile_selectors(rows: DataFrame, column: str = "selector") -> DataFrame:
    """Adds ``steps`` to rows that hold a selector: one entry per compound of each alternative.

    An entry has ``alt`` (comma alternative), ``step`` of ``n``, the combinators on both sides and
    the tests of the compound; ``sub`` (-1, or the number of a compound of a nested list), ``level``, ``rel`` (how it
    stands to the compound that needs it) and ``needs``. The columns are built in stages so that each is computed once.
    """
    out = rows
    for name, value in _stages(column):
        out = out.withColumn(name, value)
    return out.drop("_nest", "_tokens", "_parts", "_alts", "_tests", "_inner")


def _needs_of_marks(body: Column) -> Column:
    """What a compound needs of the nested lists that stand in it: one of each list's alternatives."""

    def of(mark: Column) -> Column:
        sub = F.get(F.col("_nest")["subs"], mark)
        down = sub["kind"] == "has"
        heads = F.transform(sub["parts"], lambda p, i: F.when(F.when(down, p["pos"] == 0).otherwise(p["left"] == 0), mark * _WIDTH + i))
        return F.transform(
            F.filter(heads, lambda h: h.isNotNull()),
            lambda h: F.struct(
                mark.alias("list"), (sub["kind"] == "not").alias("negate"),
                F.get(sub["parts"], h - mark * _WIDTH).alias("part"), down.alias("down"), h.cast("int").alias("sub"),
            ),
        )

    found = F.flatten(F.transform(_marks(body), of))
    return F.transform(
        found,
        lambda f: F.struct(
            f["list"].alias("list"), f["negate"].alias("negate"),
            F.when(f["down"], _relation(_DOWN, F.when(f["part"]["sign"] == "", " ").otherwise(f["part"]["sign"]))).otherwise("self").alias("rel"),
            f["sub"].alias("sub"),
        ),
    ).cast(f"array<{_NEED}>")


def _relation(names: dict[str, str], sign: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), sign)


def _level_of_marks(body: Column) -> Column:
    tops = F.transform(_marks(body), lambda m: F.get(F.col("_nest")["subs"], m)["top"] + 1)
    return F.coalesce(F.array_max(tops), F.lit(0)).cast("int")


def _inner_entries() -> Column:
    """The entries of all nested lists of a row."""

    def entry(o: Column, sub: Column, p: Column, i: Column) -> Column:
        down = sub["kind"] == "has"
        number = lambda j: (o * _WIDTH + j).cast("int")
        chain = lambda ok, rel, j: F.when(
            ok, F.array(F.struct(F.lit(-1).alias("list"), F.lit(False).alias("negate"), rel.alias("rel"), number(j).alias("sub")))
        ).otherwise(F.array())
        after = F.get(sub["parts"], i + 1)["sign"]
        # inside :has() a compound needs the next one below or after it, elsewhere the one before it
        own = F.when(down, chain(p["left"] > 0, _relation(_DOWN, after), i + 1)).otherwise(chain(p["pos"] > 0, _relation(_UP, p["sign"]), i - 1))
        lead = F.when(p["sign"] == "", " ").otherwise(p["sign"])
        rel = F.when(down, _relation(_DOWN, lead)).when(p["left"] == 0, "self").otherwise(_relation(_UP, after))
        return F.struct(
            F.lit(-1).alias("alt"), F.lit(0).alias("step"), F.lit(1).alias("n"), F.lit("").alias("comb"), F.lit("").alias("next_comb"),
            F.get(_tests(p["body"]), F.lit(0))["tag"].alias("tag"), _tests(p["body"]).alias("tests"),
            number(i).alias("sub"), (sub["base"] + F.when(down, p["left"]).otherwise(p["pos"])).cast("int").alias("level"), rel.alias("rel"),
            F.concat(own.cast(f"array<{_NEED}>"), _needs_of_marks(p["body"])).alias("needs"),
        )

    return F.flatten(F.transform(F.col("_nest")["subs"], lambda sub, o: F.transform(sub["parts"], lambda p, i: entry(o, sub, p, i))))


@per_session
def _stages(column: str) -> list[tuple[str, Column]]:
    text = F.col("_nest")["text"]
    tokens = F.when(text.rlike(_WHOLE), F.regexp_extract_all(text, F.lit(rf"({_GAP}?{_COMPOUND})"), F.lit(0)))
    gap = lambda t: F.regexp_extract(t, rf"^({_GAP}?)", 1)
    split = lambda t: F.struct(
        F.when(gap(t).rlike(r"^\s+$"), " ").otherwise(F.regexp_replace(gap(t), r"\s", "")).alias("sign"),
        F.regexp_replace(t, rf"^{_GAP}", "").alias("body"),
    )
    entry = lambda p, i: F.struct(
        F.get("_alts", i).alias("alt"),
        (i + 1 - F.array_position("_alts", F.get("_alts", i))).cast("int").alias("step"),
        F.size(F.filter("_alts", lambda a: a == F.get("_alts", i))).alias("n"),
        F.when(p["sign"] == ",", "").otherwise(p["sign"]).alias("comb"),
        F.when(F.get("_alts", i) == F.get("_alts", i + 1), F.get("_parts", i + 1)["sign"]).otherwise("").alias("next_comb"),
        F.get(F.get("_tests", i), F.lit(0))["tag"].alias("tag"),
        F.get("_tests", i).alias("tests"),
        F.lit(-1).alias("sub"),
        _level_of_marks(p["body"]).alias("level"),
        F.lit("").alias("rel"),
        _needs_of_marks(p["body"]).alias("needs"),
    )
    # running number of the alternative, one entry per token
    comma = lambda p, i: F.size(F.filter(F.slice("_parts", 1, i + 1), lambda q: q["sign"] == ","))
    outer = F.transform("_parts", entry)
    return [
        ("_nest", _unnest(F.col(column))),
        ("_tokens", F.coalesce(tokens, F.array().cast("array<string>"))),
        ("_parts", F.transform("_tokens", split)),
        ("_alts", F.transform("_parts", comma)),
        ("_tests", F.transform("_parts", lambda p: _tests(p["body"]))),
        ("steps", outer),
        # an unsupported selector has no entries at all
        ("_inner", F.when(F.size("steps") > 0, _inner_entries())),
        ("steps", F.when(F.size("_inner") > 0, F.concat("steps", "_inner")).otherwise(F.col("steps"))),
    ]


def _nth(test: Column, rank: Column) -> Column:
    gap = rank - test["b"]
    return F.when(test["a"] == 0, gap == 0).otherwise((gap % test["a"] == 0) & (gap * F.signum(test["a"]) >= 0))


def _pseudo_holds(p: Column, number: Column, elem: Column, texts: Column) -> Column:
    name = p["name"]
    return (
        F.when(name == "first-child", elem["idx"] == 1)
        .when(name == "last-child", elem["ridx"] == 1)
        .when(name == "only-child", (elem["idx"] == 1) & (elem["ridx"] == 1))
        .when(name == "first-of-type", elem["tidx"] == 1)
        .when(name == "last-of-type", elem["rtidx"] == 1)
        .when(name == "only-of-type", (elem["tidx"] == 1) & (elem["rtidx"] == 1))
        .when(name == "nth-child", _nth(p, elem["idx"]))
        .when(name == "nth-last-child", _nth(p, elem["ridx"]))
        .when(name == "nth-of-type", _nth(p, elem["tidx"]))
        .when(name == "nth-last-of-type", _nth(p, elem["rtidx"]))
        .when(
            name == "root",
            (elem["parent"] == 0) & (elem["idx"] == 1) & (elem["ridx"] == 1)
            & ~F.exists(texts, lambda s: (s["parent"] == 0) & (s["kind"] == "text") & (strip(s["text"]) != "")),
        )
        .when(name.isin("link", "any-link"), elem["tag"].isin("a", "area") & F.map_contains_key(elem["attrs"], "href"))
        .when(name == "empty", (elem["last"] == number) & (F.size(strings_of(texts, elem)) == 0))
        .otherwise(
            F.contains(
                F.array_join(
                    F.transform(
                        F.filter(
                            F.slice(texts, elem["t0"] + 1, elem["t1"] - elem["t0"]), lambda s: s["kind"] == "text"
                        ),
                        lambda s: s["text"],
                    ),
                    "",
                ),
                p["arg"],
            )
        )
    )


def _attr_holds(t: Column, elem: Column) -> Column:
    raw = F.try_element_at(elem["attrs"], t["name"])
    fold = lambda v: F.when(t["ignore_case"], F.lower(v)).otherwise(v)
    have, want, op = fold(raw), fold(t["value"]), t["op"]
    some = want != ""
    return F.when(op == "!=", raw.isNull() | (have != want)).otherwise(
        raw.isNotNull()
        & F.when(op == "", F.lit(True))
        .when(op == "=", have == want)
        .when(op == "~=", some & F.array_contains(F.split(have, r"[ \t\r\n\f]+"), want))
        .when(op == "^=", some & F.startswith(have, want))
        .when(op == "$=", some & F.endswith(have, want))
        .when(op == "*=", some & F.contains(have, want))
        .otherwise((have == want) | F.startswith(have, F.concat(want, F.lit("-"))))
    )


def _test_holds(test: Column, number: Column, elem: Column, texts: Column) -> Column:
    nothing = lambda name: F.size(test[name]) == 0
    return (
        (test["tag"].isNull() | (test["tag"] == elem["tag"]))
        & (nothing("classes") | F.forall(test["classes"], lambda c: F.array_contains(elem["classes"], c)))
        & (nothing("ids") | F.forall(test["ids"], lambda i: F.coalesce(elem["id"] == i, F.lit(False))))
        & (nothing("attrs") | F.forall(test["attrs"], lambda t: _attr_holds(t, elem)))
        & (nothing("pseudos") | F.forall(test["pseudos"], lambda p: _pseudo_holds(p, number, elem, texts)))
    )


def step_holds(step: Column, number: Column, elem: Column, texts: Column) -> Column:
    """Whether element ``number`` passes the compound of ``step`` (its combinator is another matter)."""
    fits = step["tag"].isNull() | (step["tag"] == elem["tag"])
    return fits & F.forall(step["tests"], lambda t: _test_holds(t, number, elem, texts) != t["negate"])
