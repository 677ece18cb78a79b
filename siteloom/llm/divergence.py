"""Source divergence audit: how far the word counts of every two sources of a language are apart, over run-length columns.

1. Every task counts the terms of its documents by language and source (occurrences and documents with the term) and emits
   combined counts; sums over (lang, source, term) follow.
2. A kept term (in ``least`` documents of its language) has one count in each source of the language: its vector, kept sparse.
   Terms of equal vectors are one class with a multiplicity, so the vocabulary shrinks before anything else.
3. Classes are dealt to blocks of bounded size by the hash of their vector. In a block they are sorted by their vectors, which
   clusters equal counts; each source becomes a column of runs (count, where the run ends, in terms). For a pair of sources the
   run boundaries of both are intersected and f of the two counts is multiplied by the length of each piece. Blocks add up.
4. The leading terms of a source come from the same vectors, by a ranked window that Spark cuts to ``top`` before the shuffle.

All arithmetic is exact: p is a long division in steps that stay below 2**63 as long as a source has fewer than 9 * 10**15
words, (p - q)**2 is at most 10**18. Results are of the size of their definition: all pairs of sources within a language.
A vector or the totals of a language have one entry a source; the number of sources of a language is what it returns pairs of.

Cases: null text, lang or source are empty strings; a group without terms has no counts and all its terms' p are equal; with no
kept term in a language all values are 0; a language of one source has no pairs; repeated rows count each time; an empty table
gives an empty result. Other columns, doc_id among them, play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteloom.llm.common import as_bytes, lookup, save, slices

LEAST, TOP, SCALE = 10, 10, 10**9
#: Classes of a block, and entries that a task's counters hold before they are emitted.
BLOCK, HELD = 1 << 13, 1 << 18
#: ASCII but letters is blank, capitals become small; other bytes belong to terms.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for rows in slices(batches, "text", 1 << 20):
        for lang, source, text in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), as_bytes(rows.column("text"))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_TERMS).split(b" ")
            n.update(words)
            docs.update(set(words))
            del n[b""], docs[b""]
        if sum(len(n) for n, _ in held.values()) >= HELD:
            yield from emit()
    yield from emit()


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, n, counts: the kept terms, with one (source, n) for each source that has the term, ordered."""
    counted = docs.select(_empty("lang"), _empty("source"), F.col("text").cast("string").alias("text")).mapInArrow(_count, _COUNTED)
    # the tasks have combined their rows already, so one exchange serves the sums by source and those by term
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = summed.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    )
    return terms.where(F.col("docs") >= least).select("lang", "term", "n", "counts")


def share(count: np.ndarray | int, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly; total is below 9 * 10**15."""
    rest = np.asarray(count, np.int64)
    out = rest // total
    for _ in range(3):
        rest = rest % total * 1000
        out = out * 1000 + rest // total
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def columns_of_runs(at: np.ndarray, row: np.ndarray, count: np.ndarray, weight: np.ndarray, n_columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column its runs (ends, counts) over rows of ``weight`` terms each, from its sparse entries ordered by row."""
    ends = np.cumsum(weight)
    out = []
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(n_columns + 1))
    for a, b in zip(edges, edges[1:]):
        own = order[a:b]
        full = np.zeros(len(weight), np.int64)
        full[row[own]] = count[own]
        last = np.flatnonzero(np.append(full[1:] != full[:-1], True))
        out.append((ends[last], full[last]))
    return out


def _meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of f over two columns of runs (ends, p)."""
    ends = np.union1d(a[0], b[0])
    length = np.diff(ends, prepend=0)
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    # sums stay below 2 * SCALE * (number of terms)
    return int((distance(p, q) * length).sum())


def _block_pairs(key: tuple, classes: pa.Table, totals: pa.Table) -> pa.Table:
    """Partial values of all pairs a < b of one language over one block of classes."""
    own = totals.column("totals").to_pylist()[0]
    names = [x["source"] for x in own]
    place = {name: i for i, name in enumerate(names)}
    found: list[tuple[str, str, int]] = []
    if classes.num_rows:
        # sorted by the vectors, source by source: equal counts stand together
        counts = classes.column("counts").combine_chunks()
        entries = list(zip(map(place.__getitem__, counts.flatten().field("source").to_pylist()), counts.flatten().field("n").to_pylist()))
        ends = np.cumsum(counts.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        vectors = [entries[a:b] for a, b in zip([0, *ends], ends)]
        order = sorted(range(len(vectors)), key=vectors.__getitem__, reverse=True)
        row = np.repeat(np.arange(len(order)), [len(vectors[i]) for i in order])
        at = np.array([x for i in order for x, _ in vectors[i]], np.int64)
        count = np.array([n for i in order for _, n in vectors[i]], np.int64)
        runs = columns_of_runs(at, row, count, classes.column("terms").to_numpy()[order], len(own))
        shares = [(stops, share(c + 2, x["total"])) for (stops, c), x in zip(runs, own)]
        found = [(names[a], names[b], _meet(shares[a], shares[b])) for a in range(len(own)) for b in range(a + 1, len(own))]
    columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), *columns], names=["lang", "a", "b", "value"])


def pairs(words: DataFrame, totals: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, a, b, value for all sources a < b of each language."""
    classes = save(words.groupBy("lang", "counts").agg(F.count("*").alias("terms")), "classes")
    blocks = classes.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = lookup(classes, blocks, ["lang"], salts=8, spread=F.xxhash64("counts")).withColumn("block", F.pmod(F.xxhash64("counts", F.lit(1)), "blocks").cast("int"))
    known = totals.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = (
        dealt.select("lang", "block", "counts", "terms")
        .groupBy("lang", "block")
        .cogroup(known.select("lang", "block", "totals").groupBy("lang", "block"))
        .applyInArrow(_block_pairs, "lang string, a string, b string, value long")
    )
    return met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(count: Column, total: Column) -> Column:
    """``share`` as a column."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(SCALE), 10) * wide(count, 19), wide(total, 19))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: every other source, and the leading terms, of each source."""
    groups = save(docs.select(_empty("lang"), _empty("source")).distinct(), "groups")
    words = save(vocabulary(docs, least), "vocabulary")
    entries = words.select("lang", "term", F.col("n").alias("n_lang"), F.explode("counts").alias("own")).select("lang", "own.source", "term", "n_lang", "own.n")
    sizes = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    # one row a group: total is what the counts of the group and twice the kept terms add up to
    known = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    twice = 2 * F.coalesce("v", F.lit(0))
    known = save(known.select("lang", "source", (F.coalesce("sum", F.lit(0)) + twice).alias("total"), (F.coalesce("all", F.lit(0)) + twice).alias("total_lang")), "totals")

    totals = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("totals"))
    found = pairs(words, totals, block)
    both = found.union(found.select("lang", "b", "a", "value")).toDF("lang", "source", "item", "value")
    every = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source != item")
    valued = every.join(both, ["lang", "source", "item"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_source = valued.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(order))

    p, q = F.col("p"), F.col("q")
    placed = lookup(entries, known, ["lang", "source"], spread=F.xxhash64("term"))
    leads = placed.withColumns({"p": _share(F.col("n") + 2, F.col("total")), "q": _share(F.col("n_lang") + 2, F.col("total_lang"))}).where("n > 0 and p > q")
    leads = leads.select("lang", "source", F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    by_term = leads.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(by_source, "pair").union(part(by_term, "term"))


def sql() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_n AS (
  SELECT g.lang, g.source, k.term, k.n_lang, coalesce(n.n, 0) AS n, s.v, s.total, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (own + 2 * v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (n_lang + 2)) // (total + 2 * v))::HUGEINT AS q
  FROM full_n),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
