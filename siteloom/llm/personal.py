"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are the base spans (email, ip, card, phone by exact rules) and looser ones (local phone numbers, social
security numbers, bank accounts, spelt-out addresses). Three labelers vote on each candidate: a format labeler (checksums
and number ranges), gazetteers (domain endings, calling codes, card issuers, country codes) and a context labeler (words
before it). Votes and features of all candidates are counted by pattern, and there is a bounded number of patterns. On
these counts expectation-maximisation estimates how reliable each labeler is for each kind, without any true label, and
the resulting probabilities train a naive Bayes classifier over the features. Looser candidates that it takes for
personal data are added to the base spans, which always stay.

Only native functions touch the rows; the driver sees the table of pattern counts.

Cases: a null text is empty; an empty table gives an empty result; repeated rows each get their spans; candidates that
overlap a base span or an earlier added span are dropped. Other columns play no part.
"""

from __future__ import annotations

import math
from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import save
from siteloom.llm.native import TAGGED, count_of, listed, matches

# Fixed values of the contract: the base kinds in their order.
BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "ssn", "iban", "spelt_email")
KINDS = BASE + MORE
# The base expressions, written so that no text makes them slow: a run is entered at its start or where a match ended,
# and is not given back once read.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOCAL = r"(?<![+0-9A-Za-z.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?![0-9A-Za-z])"
_SPELT = r"(?<![0-9A-Za-z])[a-z0-9._]{2,40}\x20?[\[(](?:at|AT)[\])]\x20?[a-z0-9-]{2,40}\x20?[\[(](?:dot|DOT)[\])]\x20?[a-z]{2,6}(?![0-9A-Za-z])"
# Gazetteers, in natural order.
DOMAINS = "com edu gov info io net org uk de fr es it nl eu ch at be ca us au jp".split()
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
HINTS = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|mobile|call|fax|card|visa|credit|ip|address|host|ssn|social|iban|account|reach)\b[^\n]{0,12}$"
AGAINST = r"(?i)\b(?:version|release|section|isbn|order|invoice|figure|table|page|no)\b[^\n]{0,6}$"
BEFORE = 32


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled, is a multiple of ten. For up to 19 digits."""
    figures = F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), lambda d: d.cast("int"))
    twice = F.transform(figures, lambda d, i: F.when(i % 2 == 1, (2 * d) % 10 + F.floor(2 * d / 10).cast("int")).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def _ip_parts(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^0*([0-9]{1,3})$", 1).try_cast("int") <= 255, F.lit(False)))


def _valid(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "ip":
        return _ip_parts(found)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(kind: str) -> Column:
    """(start, stop, found) of a kind's candidates; cheap tests come first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "local_phone": _LOCAL, "ssn": _SSN, "iban": _IBAN, "spelt_email": _SPELT}[kind]
    some = {
        "email": F.contains(text, F.lit("@")),
        "phone": F.contains(text, F.lit("+")),
        "spelt_email": F.contains(F.lower(text), F.lit("dot")),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
    }.get(kind, text.rlike("[0-9]{2}"))
    return F.coalesce(F.when(some, matches(text, pattern)), F.array().cast("array<struct<start:int,stop:int,found:string>>"))


def _format_vote(kind: str, found: Column) -> Column:
    digits = _digits(found)
    good = {
        "email": found.rlike(r"\.[A-Za-z]{2,}$") & ~found.rlike(r"\.\."),
        "ip": ~found.rlike(r"^0|\.0[0-9]"),
        "card": F.length(digits).isin(14, 15, 16, 19),
        "phone": F.length(digits).between(10, 13),
        "local_phone": digits.rlike("^[2-9][0-9]{2}[2-9]"),
        "ssn": ~digits.rlike("^(?:000|666|9)|^...00|0000$"),
        "iban": F.length(F.replace(found, F.lit(" "))).between(15, 34),
        "spelt_email": F.lit(True),
    }[kind]
    return F.when(good, 1).otherwise(-1)


def _gazetteer_vote(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind in ("email", "spelt_email"):
        return F.when(F.lower(F.regexp_extract(found, "([A-Za-z]+)$", 1)).isin(DOMAINS), 1).otherwise(0)
    if kind == "ip":  # addresses of networks that lead to no person
        return F.when(found.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\."), -1).otherwise(0)
    if kind == "card":
        return F.when(digits.rlike("^(?:3[47]|4|5[1-5]|6(?:011|5)|2[2-7])"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(digits.rlike(f"^(?:{'|'.join(CALLING_CODES)})"), 1).otherwise(-1)
    if kind == "iban":
        return F.when(F.substring(found, 1, 2).isin(COUNTRIES), 1).otherwise(-1)
    return F.lit(0)


def _candidate(number: int, kind: str, s: Column) -> Column:
    found, text = s["found"], F.coalesce(F.col("text"), F.lit(""))
    from_ = F.greatest(s["start"] - BEFORE, F.lit(0))
    before = F.substring(text, from_ + 1, s["start"] - from_)
    context = F.when(before.rlike(HINTS), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    return F.struct(
        s["start"].alias("start"),
        F.lit(number).alias("number"),
        F.lit(kind).alias("kind"),
        s["stop"].alias("stop"),
        _format_vote(kind, found).alias("format"),
        _gazetteer_vote(kind, found).alias("gazetteer"),
        context.alias("context"),
        F.least(F.floor((s["stop"] - s["start"]) / 4), F.lit(8)).cast("int").alias("length"),
        F.when(before.rlike(r"[\s(\[:,;]$|^$"), 1).otherwise(0).alias("apart"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans with their votes and features, one narrow row per document."""
    lists = []
    for number, kind in enumerate(KINDS):
        valid = F.filter(_spans(kind), lambda s: _valid(kind, s["found"]))
        lists.append(F.transform(valid, lambda s: _candidate(number, kind, s)))
    return docs.select("doc_id", F.concat(*lists).alias("spans"))


VOTES = ("format", "gazetteer", "context")
FEATURES = (*VOTES, "length", "apart")


class Pattern(NamedTuple):
    kind: str
    values: tuple[int, ...]  # of FEATURES
    n: int


def patterns(found: DataFrame) -> list[Pattern]:
    """How often each combination of kind, votes and features occurs: at most some thousand rows, whatever the corpus."""
    one = found.select(F.explode("spans").alias("s"))
    counts = one.groupBy("s.kind", *[F.col(f"s.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"))
    return sorted(Pattern(r["kind"], tuple(int(r[f]) for f in FEATURES), r["n"]) for r in counts.collect())


def reliabilities(rows: list[Pattern], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over the votes of each kind: probability that a candidate with these votes is personal data.

    Labelers vote 1, -1 or 0 (no opinion), independently given the truth. It starts from labelers that are right in seven
    of ten votes and keeps their counts from vanishing, so a kind with few candidates stays near that start.
    """
    out = {}
    for kind in sorted({r.kind for r in rows}):
        counts: dict[tuple[int, ...], int] = {}
        for r in rows:
            if r.kind == kind:
                counts[r.values[:3]] = counts.get(r.values[:3], 0) + r.n
        share = 0.5
        start = {1: {1: 0.5, 0: 0.3, -1: 0.2}, 0: {1: 0.2, 0: 0.3, -1: 0.5}}
        table = [{t: dict(start[t]) for t in (0, 1)} for _ in VOTES]
        odds: dict[tuple[int, ...], float] = {}
        for _ in range(rounds):
            for votes in counts:
                yes = share * math.prod(table[i][1][v] for i, v in enumerate(votes))
                no = (1 - share) * math.prod(table[i][0][v] for i, v in enumerate(votes))
                odds[votes] = yes / (yes + no)
            total = sum(counts.values())
            share = min(0.98, max(0.02, (sum(n * odds[v] for v, n in counts.items()) + 5) / (total + 10)))
            for i in range(len(VOTES)):
                for t in (0, 1):
                    mass = {v: 10 * start[t][v] for v in (1, 0, -1)}
                    for votes, n in counts.items():
                        mass[votes[i]] += n * (odds[votes] if t else 1 - odds[votes])
                    table[i][t] = {v: m / sum(mass.values()) for v, m in mass.items()}
        out |= {(kind, v): p for v, p in odds.items()}
    return out


def classifier(rows: list[Pattern]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Naive Bayes over all features, trained on the probable labels: probability for each pattern that occurs."""
    soft = reliabilities(rows)
    sums: dict[tuple, float] = {}
    for r in rows:
        p = soft[r.kind, r.values[:3]]
        for t, mass in ((1, r.n * p), (0, r.n * (1 - p))):
            for key in chain([(t, r.kind)], [(t, r.kind, i, v) for i, v in enumerate(r.values)]):
                sums[key] = sums.get(key, 0.0) + mass
    out = {}
    for r in rows:
        logs = {}
        for t in (0, 1):
            total = sums[t, r.kind]
            logs[t] = math.log(total + 1) + sum(math.log((sums.get((t, r.kind, i, v), 0.0) + 1) / (total + 10)) for i, v in enumerate(r.values))
        out[r.kind, r.values] = 1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1]))))
    return out


def _add(state: Column, s: Column) -> Column:
    """Keeps a looser span if it overlaps none that is kept."""
    clash = F.exists(state, lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"]))
    return F.when(clash, state).otherwise(F.concat(state, F.array(s)))


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and ``spans``: start, number, kind, stop of base and added spans."""
    found = save(candidates(docs), "candidates")
    chances = classifier(patterns(found))
    key = lambda s: F.concat_ws(":", s["kind"], *[s[f].cast("string") for f in FEATURES])
    likely = sorted(":".join(map(str, (kind, *values))) for (kind, values), p in chances.items() if p >= least and kind in MORE)
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    # the list is that of the patterns, bounded like their table
    more = F.filter("spans", lambda s: (s["number"] >= len(BASE)) & key(s).isin(likely)) if likely else F.filter("spans", lambda s: F.lit(False))
    slim = lambda spans: F.transform(
        spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "number", "kind", "stop")])
    ).cast(TAGGED)
    both = F.when(F.size("more") > 0, F.aggregate("more", F.col("base"), _add)).otherwise(F.col("base"))
    return found.select("doc_id", slim(base).alias("base"), F.array_sort(slim(more)).alias("more")).select("doc_id", both.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document. Spans are listed by kind, then start."""
    order = lambda spans: F.array_sort(
        spans,
        lambda a, b: F.when(a["number"] != b["number"], a["number"] - b["number"]).otherwise(a["start"] - b["start"]),
    )
    found = find(docs).select("doc_id", order(F.col("spans")).alias("spans"))
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    counts = [count_of(F.col("spans"), number).alias(f"n_{kind}") for number, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
