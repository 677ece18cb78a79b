"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source.

Measures are taken from each whole text inside its row. A sketch is a histogram over logarithmic buckets (each bucket
spans ``ACCURACY``, so any quantile is right to within that relative error); sketches merge by adding counts, so they
are one grouped count, pre-aggregated before the shuffle, and do not depend on the order of rows. Sketches of a language
and source with few documents are merged with those of the language, then of all documents.

Cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows each count and each get a verdict; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteloom.llm.common import as_bytes, flat_ids, lookup, mixed, save, slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Bytes that are no first byte of a character of a word: ASCII white space and continuation bytes.
_NO_WORD_CHAR = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_PLAIN = bytes(sorted(set(range(256)) - set(_UPPER)))

MEASURED = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, "
    "n_dup_lines long, n_repeat_words long, n_upper long"
)
#: The ratios that get a sketch: above, below, what is added below so that a single repeated line of a short text weighs
#: little, and the least distance of the quartiles that is told from none. All ratios rise with faults.
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 0, 0.01),
    "dup_lines": ("n_dup_lines", "n_lines", 5, 0.08),
    "repeats": ("n_repeat_words", "n_words", 0, 0.06),
    "upper": ("n_upper", "word_chars", 0, 0.05),
    "word_length": ("word_chars", "n_words", 0, 0.5),
}
ACCURACY = 1.02
SMALLEST = 1e-4


def _repeated_words(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text, the words in windows of WINDOW words that it has twice or more.

    Windows are compared by 64-bit hashes within one text.
    """
    n, doc = len(ids), np.repeat(np.arange(len(counts)), counts)
    if n < WINDOW:
        return np.zeros(len(counts), np.int64)
    words = mixed(ids + 1)
    starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    window = mixed(doc[starts])
    for k in range(WINDOW):
        window = window * np.uint64(0x100000001B3) + words[starts + k]
    window = mixed(window)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=len(counts)).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        texts = as_bytes(rows.column("text"))
        ids, counts, _ = flat_ids([t.split() for t in texts])
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
        numbers = {
            "n_words": counts,
            "word_chars": [len(t.translate(None, _NO_WORD_CHAR)) for t in texts],
            "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
            "n_lines": [len(x) for x in lines],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": _repeated_words(ids, counts),
            "n_upper": [len(t.translate(None, _PLAIN)) for t in texts],
        }
        yield pa.RecordBatch.from_arrays(
            [rows.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(v, pa.int64()) for v in numbers.values()],
            names=["doc_id", "lang", "source", *numbers],
        )


def measures(docs: DataFrame) -> DataFrame:
    """One narrow row per document: counts over its whole text."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")
    ).mapInArrow(_measure, MEASURED)


def _ratio(name: str) -> Column:
    top, bottom, more, _ = RATIOS[name]
    return F.coalesce(F.col(top) / F.nullif(F.col(bottom) + more, F.lit(0)), F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, docs: the mergeable sketches, one row per filled bucket."""
    values = F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r).alias("value")) for r in RATIOS])
    bucket = F.when(
        F.col("value") > SMALLEST, F.ceil(F.log(F.col("value") / SMALLEST) / float(np.log(ACCURACY))).cast("int")
    ).otherwise(0)
    return (
        measured.where("n_words > 0")
        .select("lang", "source", F.explode(values).alias("_"))
        .select("lang", "source", "_.rule", "_.value")
        .groupBy("lang", "source", "rule", bucket.alias("bucket"))
        .agg(F.count("*").alias("docs"))
    )


def quantiles(merged: DataFrame, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """The named quantiles of each sketch. A sketch has at most some hundred buckets, whatever the number of documents."""
    running = Window.partitionBy(*keys, "rule").orderBy("bucket")
    whole = Window.partitionBy(*keys, "rule")
    value = F.when(F.col("bucket") > 0, F.lit(SMALLEST) * F.pow(F.lit(ACCURACY), F.col("bucket") - 0.5)).otherwise(0.0)
    ranked = merged.withColumns({"upto": F.sum("docs").over(running), "n": F.sum("docs").over(whole), "value": value})
    return ranked.groupBy(*keys, "rule").agg(
        F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("value"))).alias(c) for c, q in levels.items()]
    )


def thresholds(sketch: DataFrame, least_docs: int = 200, reach: float = 4.0) -> DataFrame:
    """One row per language and source with the highest value that each rule allows.

    A rule allows up to the upper quartile plus ``reach`` times the distance of the quartiles, measured on the group's own
    sketch if it holds ``least_docs`` documents, else on its language's, else on that of all documents. Where most
    documents have nothing of a fault the quartiles fall together; the rule's least distance then keeps a single mark from
    rejecting a text.
    """
    levels = {"q25": 0.25, "q75": 0.75}
    own = quantiles(sketch, ["lang", "source"], levels)
    lang = quantiles(sketch.groupBy("lang", "rule", "bucket").agg(F.sum("docs").alias("docs")), ["lang"], levels)
    every = quantiles(sketch.groupBy("rule", "bucket").agg(F.sum("docs").alias("docs")), [], levels)
    names = ["n", *levels]
    lang = lang.select("lang", "rule", F.struct(*names).alias("of_lang"))
    every = every.select("rule", F.struct(*names).alias("of_all"))
    joined = lookup(own.select("lang", "source", "rule", F.struct(*names).alias("own")), lang, ["lang", "rule"], salts=4).join(every, "rule")
    chosen = (
        F.when(F.col("own.n") >= least_docs, F.col("own")).when(F.col("of_lang.n") >= least_docs, F.col("of_lang")).otherwise(F.col("of_all"))
    )
    least = F.element_at(F.create_map(*[F.lit(x) for r, v in RATIOS.items() for x in (r, v[3])]), F.col("rule"))
    spread = F.greatest(F.col("s.q75") - F.col("s.q25"), least)
    limit = joined.withColumn("s", chosen).select("lang", "source", "rule", (F.col("s.q75") + reach * spread).alias("most"))
    return limit.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col("most"))).alias(f"most_{r}") for r in RATIOS])


def judge(docs: DataFrame, least_words: int = 20, most_repeats: int = 30, **settings) -> DataFrame:
    """The measures of each document, ``base_failed``, ``failed`` (the adaptive rules it breaks) and ``kept``."""
    measured = save(measures(docs), "measures")
    limits = thresholds(sketches(measured), **settings)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    joined = lookup(measured, limits, ["lang", "source"])
    failed = F.filter(
        F.array(*[F.when(_ratio(r) > F.col(f"most_{r}"), F.lit(r)) for r in RATIOS]), lambda x: x.isNotNull()
    )
    return (
        joined.withColumns({"base_failed": base, "failed": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .drop(*[f"most_{r}" for r in RATIOS])
    )
