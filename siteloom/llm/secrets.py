"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: which trigrams a text must hold to match. Postings
(trigram, document) are made for the trigrams that the queries ask for, in lower case, and joined with the clauses of the
queries; a document that has all trigrams of a clause is a candidate of its rule, and only candidates are verified with
the expression itself. Rules from which no trigram follows scan every document.

Cases: a null text is empty and has no spans; documents with one id are candidates together (a wider candidate set) and
verified each; null ids are equal here; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import lookup, unused
from siteloom.llm.native import TAGGED, count_of, listed, masked, matches, tagged, where


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group that must have ``least`` characters
    least: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_any_case(w) for w in ("password", "passwd", "secret", "token")] + [_any_case("api") + "_?" + _any_case("key")])
#: A run that is long enough is matched as a whole, so the least lengths of access and hex can stand in the expressions.
BASE = (
    Rule("assign", "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Public token formats besides the base.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Most strings that a part of an expression may stand for and still be spelt out.
_SPELT = 64

Query = frozenset[frozenset[str]]  # any of these sets of trigrams; the empty set asks for nothing
_ALL: Query = frozenset([frozenset()])


def _grams(strings: set[str]) -> Query:
    found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return _least(found)


def _least(query: Query) -> Query:
    return frozenset(c for c in query if not any(d < c for d in query))


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x, y in product(a, b)))


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < _SPELT:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _spelt(op, value) -> set[str] | None:
    """All lower-case strings that a node stands for, if there are few."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        return _chars(value)
    if op is sre.SUBPATTERN:
        return _spelt_run(value[3])
    if op is sre.BRANCH:
        parts = [_spelt_run(b) for b in value[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] != sre.MAXREPEAT and value[1] <= 4:
        one = _spelt_run(value[2])
        if one is not None and len(one) ** value[1] <= _SPELT:
            return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
    return None


def _spelt_run(nodes) -> set[str] | None:
    out = {""}
    for op, value in nodes:
        one = _spelt(op, value)
        if one is None or len(out) * len(one) > _SPELT:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(nodes) -> Query:
    asked, run = _ALL, {""}
    for op, value in nodes:
        one = _spelt(op, value)
        if one is not None and len(run) * len(one) <= _SPELT:
            run = {a + b for a in run for b in one}
            continue
        asked, run = _both(asked, _grams(run)), {""} if one is None else one
        if one is None:
            if op is sre.SUBPATTERN:
                asked = _both(asked, _query(value[3]))
            elif op is sre.BRANCH:
                asked = _both(asked, _least(frozenset().union(*[_query(b) for b in value[1]])))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                asked = _both(asked, _query(value[2]))
    return _both(asked, _grams(run))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which is in the lower-case form of every text that matches ``pattern``."""
    return _query(_parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram), the inverted index of the trigrams asked for."""
    lower = docs.select("doc_id", F.lower("text").alias("lower"))
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lower.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the rules whose trigram query a document meets, without those that scan fully."""
    rows = [
        (rule.kind, number, len(clause), gram)
        for rule in rules
        for number, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
        for gram in clause
    ]
    clauses = docs.sparkSession.createDataFrame(
        rows or [("", 0, 0, "")],
        T.StructType([T.StructField(n, k) for n, k in (("rule", T.StringType()), ("clause", T.IntegerType()), ("needs", T.IntegerType()), ("trigram", T.StringType()))]),
    )
    trigrams = sorted({r[3] for r in rows}) or [""]
    # the clauses are those of the rule set, some hundred rows
    met = postings(docs, trigrams).join(F.broadcast(clauses), "trigram").groupBy("doc_id", "rule", "clause", "needs").agg(
        F.size(F.collect_set("trigram")).alias("held")
    )
    return met.where("held = needs").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _found(rule: Rule) -> Column:
    spans = matches(F.col("text"), rule.pattern)
    if rule.least > 1:
        spans = where(spans, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
    return spans


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` (all columns, a null text as it is) with ``spans_column(docs)``: start, number, kind, stop, sorted."""
    spans_name, rules_name = spans_column(docs), unused("_rules", docs)
    found = candidates(docs, rules).withColumnRenamed("rules", rules_name)
    open_rules = {r.kind for r in rules if trigram_query(r.pattern) == _ALL}
    # one id may own many rows, or none has one: such rows are spread, with copies of the rules found for it
    joined = lookup(docs, found, ["doc_id"], salts=8, spread=F.xxhash64("text"))
    spans = []
    for number, rule in enumerate(rules):
        own = tagged(_found(rule), number, rule.kind)
        if rule.kind not in open_rules:
            own = F.when(F.array_contains(rules_name, rule.kind), own)
        spans.append(F.coalesce(own, F.array().cast(TAGGED)))
    return joined.withColumn(spans_name, F.array_sort(F.concat(*spans))).drop(rules_name)


def spans_column(docs: DataFrame) -> str:
    """The name of the column that ``scan`` adds: ``_spans``, or longer where the table has that."""
    return unused("_spans", docs)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["number"] < len(BASE))
    counts = [count_of(F.col("_spans"), number).alias(f"n_{rule.kind}") for number, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with their secrets replaced in ``text``; ``n_chars`` follows if there is such a column."""
    spans = spans_column(docs)
    out = scan(docs).withColumn("text", masked(F.col("text"), F.coalesce(spans, F.array().cast(TAGGED)), mark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _sql_matches(pattern: str) -> str:
    """DuckDB: list of (start, stop, found) of all matches in ``text``."""
    p = pattern.replace("'", "''")
    return (
        f"(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(g[:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0), 'found': m[i]}}) "
        f"FROM (SELECT regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g))"
    )


def sql() -> str:
    parts = []
    for number, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        test = f"length(regexp_extract(s.found, '{p}', {rule.group})) >= {rule.least}" if rule.least > 1 else "true"
        parts.append(
            f"SELECT doc_id, t, {number} AS number, '{rule.kind}' AS kind, s.start AS start, s.start + length(s.found) AS stop "
            f"FROM (SELECT doc_id, t, unnest({_sql_matches(rule.pattern)}) AS s FROM d) WHERE {test}"
        )
    text = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({text}, ',' ORDER BY start, number) FILTER (number < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY start, number), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
