"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, taken as the set of its words. It meets a template if it holds at least ``CONTAINED`` of the
template's words, the ``TELLING`` ones among them, which tell a license from its neighbours. The join is exact: words are ordered by how many blocks of the whole corpus hold them, rare ones first;
of each template only as many first words are indexed as a matching block cannot all lack, and of each block likewise
(prefix filter); blocks with too few words of any template (length filter) and pairs whose first common word leaves too
few words behind it (positional filter) are dropped before the sets are compared.

Fixed phrases are found besides, as places where their words stand one after the other, with any marks between them.

Cases: a null text is empty, has no words and score 0; texts are told apart by id and content, so rows with one id keep
their own results and repeated rows get the same one each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import save
from siteloom.llm.native import bind

# Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# License notices, each with its label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the software without restriction"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This work has been released into the public domain",
}
CONTAINED = 0.85
#: Words without which a block is another license than the template's, however much of the template it holds.
TELLING = {
    "apache-2.0": ["apache", "2"], "cc-by-nc-4.0": ["nc", "4"], "cc-by-sa-4.0": ["sa", "4"], "gpl-3.0": ["gnu", "3"], "mit": ["mit"],
    "mpl-2.0": ["mozilla", "2"],
}
#: Marks between words and, with A-Z kept, words.
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD = f"[^{_MARK}]+"


def tokens(text: str) -> list[str]:
    """Distinct words of a template."""
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())))


def needed(size: int) -> int:
    return math.ceil(CONTAINED * size - 1e-9)


def _lower(text: Column) -> Column:
    """``text`` in lower case, for comparison with template words: of all other letters only the Kelvin sign would become one of a-z."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def _places(lower: Column, words: Column, phrase: str) -> Column:
    """Numbers of the first words of a phrase's places, among the ``words`` of the text. Only texts that hold each of its words are searched."""
    wanted = phrase.split()

    def search(all_words: Column) -> Column:
        follow = lambda i: reduce(lambda a, k: a & (F.get(all_words, i + k) == wanted[k]), range(1, len(wanted)), F.lit(True))
        return F.array_compact(F.transform(all_words, lambda w, i: F.when((w == wanted[0]) & follow(i), i.cast("long"))))

    held = reduce(lambda a, w: a & F.contains(lower, F.lit(w)), wanted[1:], F.contains(lower, F.lit(wanted[0])))
    return F.when(held, bind(words, search)).otherwise(F.array().cast("array<long>"))


def blocks(docs: DataFrame) -> DataFrame:
    """One narrow row per text: its base places and, for each block, which template words it holds (the only ones that count)."""
    vocabulary = sorted({t for text in TEMPLATES.values() for t in tokens(text)})
    least = min(needed(len(tokens(t))) for t in TEMPLATES.values())
    text = F.coalesce(F.col("text"), F.lit(""))

    def facts(lower: Column, lines: Column) -> Column:
        known = F.transform(
            lines, lambda line, i: F.struct(i.alias("block"), F.array_distinct(F.filter(line, lambda w: w.isin(vocabulary))).alias("held"))
        )
        return F.struct(
            F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + F.size(line)).alias("n_words"),
            F.array(*[_places(lower, F.flatten(lines), p) for p in PHRASES]).alias("places"),
            # blocks without template words hold nothing to count or to find
            F.filter(known, lambda b: F.size(b["held"]) > 0).alias("blocks"),
        )

    # a text is cut into words once, line by line; all else is read from the words
    words_of = lambda lower: F.transform(F.split(lower, "\n"), lambda line: F.filter(F.split(line, _MARKS, -1), lambda w: w != ""))
    found = bind(_lower(text), lambda lower: bind(words_of(lower), lambda lines: facts(lower, lines)))
    return docs.select("doc_id", F.xxhash64(text).alias("content"), found.alias("_facts"), F.lit(least).alias("least")).select(
        "doc_id", "content", "_facts.n_words", "_facts.places", "_facts.blocks", "least"
    )


def frequency_order(found: DataFrame) -> list[str]:
    """Template words by the number of blocks that hold them, rare ones first. As long as the templates' vocabulary."""
    counts = found.select(F.explode("blocks.held").alias("held")).select(F.explode("held").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}
    return sorted({t for text in TEMPLATES.values() for t in tokens(text)}, key=lambda t: (seen.get(t, 0), t))


def similar_blocks(found: DataFrame) -> DataFrame:
    """doc_id, content, block, label, contained: every block and template that meet the threshold."""
    spark, order = found.sparkSession, frequency_order(found)
    rank = {t: i for i, t in enumerate(order)}
    sets = {label: sorted(tokens(text), key=rank.__getitem__) for label, text in TEMPLATES.items()}
    prefixes = [
        (word, label, i, len(s), needed(len(s)), s, TELLING.get(label, [])) for label, s in sets.items() for i, word in enumerate(s[: len(s) - needed(len(s)) + 1])
    ]
    # the templates' index has some words per template, so its broadcast is bounded by the parameter
    index = F.broadcast(spark.createDataFrame(prefixes, "word string, label string, i int, size int, need int, words array<string>, telling array<string>"))
    ranks = F.create_map(*[x for t, i in rank.items() for x in (F.lit(t), F.lit(i))])
    by_rank = lambda held: F.transform(
        F.array_sort(F.transform(held, lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word")))), lambda x: x["word"]
    )
    one = (
        found.select("doc_id", "content", "least", F.explode("blocks").alias("b"))
        .where(F.size("b.held") >= F.col("least"))
        .select("doc_id", "content", "b.block", by_rank(F.col("b.held")).alias("held"), "least")
    )
    first = F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1)
    pairs = one.select("*", F.posexplode(first).alias("j", "word")).join(index, "word")
    length = F.size("held") >= F.col("need")
    position = F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) >= F.col("need")
    overlap = F.size(F.array_intersect("held", "words"))
    telling = F.size(F.array_except("telling", "held")) == 0
    return (
        pairs.where(length & position & telling)
        .where(overlap >= F.col("need"))
        .select("doc_id", "content", "block", "label", (overlap / F.col("size")).alias("contained"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    found = save(blocks(docs), "blocks")
    met = similar_blocks(found).groupBy("doc_id", "content").agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))
    met = met.withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    all_places = F.flatten("places")
    base = reduce(
        lambda a, b: F.concat(a, b),
        [F.when(F.size(F.col("places")[i]) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, label in enumerate(PHRASES.values())],
    )
    slim = found.select(
        "doc_id", "content", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).alias("first_word"),
        F.array_max(all_places).alias("last_word"), base.alias("base"),
    )
    joined = slim.join(met, slim["doc_id"].eqNullSafe(met["_id"]) & (slim["content"] == met["_content"]), "left")
    both = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, notices: labels of the templates that each document holds, however its lines are wrapped. One narrow row per document.

    Blocks are paragraphs and, so that blank lines and comment marks in a notice do no harm, all windows of a template's length
    over the words of the text. A block meets a template if it holds ``CONTAINED`` of its words and all of its ``TELLING`` ones.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), upper, upper.lower())
    vocabulary = sorted({t for template in TEMPLATES.values() for t in tokens(template)})
    words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    known = F.array(*[F.lit(v) for v in vocabulary])
    paragraphs = F.transform(F.split(text, r"\n[ \t\r]*\n", -1), lambda p: F.array_intersect(F.split(p, _MARKS, -1), known))
    least = min(needed(len(tokens(t))) for t in TEMPLATES.values())
    rows = docs.select(
        "doc_id",
        F.filter(words, lambda x: x["word"].isin(vocabulary)).alias("placed"),
        F.filter(paragraphs, lambda p: F.size(p) >= least).alias("paragraphs"),
    )

    def held(label: str, template: str) -> Column:
        own = tokens(template)
        length, need = len(re.findall(_WORD, template)), needed(len(own))
        listed = F.array(*[F.lit(t) for t in own])

        def meets(block: Column) -> Column:
            enough = F.size(F.array_intersect(block, listed)) >= need
            return reduce(lambda a, t: a & F.array_contains(block, t), TELLING.get(label, []), enough)

        def windows(places: Column) -> Column:
            # a window holds at most ``length`` known words, so the next ones are all that can be in it
            near = lambda a, k: F.filter(F.slice(places, k + 1, F.lit(length)), lambda b: b["at"] < a["at"] + length)
            return F.exists(F.transform(places, lambda a, k: F.transform(near(a, k), lambda b: b["word"])), meets)

        # texts that lack too many of the words altogether need no windows
        found = F.exists("paragraphs", meets) | (
            meets(F.col("placed")["word"]) & bind(F.filter("placed", lambda x: x["word"].isin(own)), windows)
        )
        return F.when(found, F.lit(label))

    every = F.array_compact(F.array(*[held(label, template) for label, template in sorted(TEMPLATES.items())]))
    return rows.select("doc_id", F.array_join(every, ",").alias("notices"))


def sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places, labels = [], []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(0, len(w)), lambda i: {same})")
        labels.append(f"CASE WHEN len(list_filter(range(0, len(w)), lambda i: {same})) > 0 THEN ['{label}'] ELSE [] END")
    rows = ", ".join(
        f"('{label}', {tokens(text)!r}, {needed(len(tokens(text)))}, CAST({TELLING.get(label, [])!r} AS VARCHAR[]))" for label, text in TEMPLATES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, {lower} AS t, regexp_extract_all({lower}, '{word}') AS w FROM documents),
templates(label, words, need, telling) AS (VALUES {rows}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{word}')) AS b FROM d),
met AS (SELECT doc_id, list(DISTINCT label) AS more, max(len(list_intersect(b, words)) / len(words)) AS contained
        FROM lines, templates WHERE len(list_intersect(b, words)) >= need AND list_has_all(b, telling) GROUP BY doc_id),
p AS (SELECT doc_id, len(w) AS n_words, {' || '.join(places)} AS spots, {' || '.join(labels)} AS base FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
       CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0)::DOUBLE END AS score
FROM p LEFT JOIN met USING (doc_id)"""
