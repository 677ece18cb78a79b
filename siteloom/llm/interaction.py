"""Filter interaction audit: what each filter removes, under every order in which the filters could run.

1. Each document's five failures become a mask; documents of one part and mask are one cell with its weights (documents, good
   ones, toxic ones). There are at most 32 cells a part, whatever the number of documents.
2. A cell is folded over the array of all orders: ``transform`` over the orders, ``aggregate`` over the letters of each. That
   gives 600 weighted structs a cell, which are merged by elementwise sums.

The array of orders is a constant (120 strings of five letters) that comes with the plan. Copies are found by the SHA-256 of
the text: the smallest id of each text that occurs twice or more is looked up by its digest, with salted keys.

Cases: a null text is an empty one (it fails A; all empty texts are copies of each other); a null source is the empty string; a
row without an id is no copy of anything and makes no other row a copy, and has no labels; rows that share id and text are not
copies of each other, for neither id is smaller; of several labels of one id any that says 1 counts; null labels say nothing; an
empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import lookup, save

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least percentage of distinct words, most percentage of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
_BLANK = r"[\x20\x09-\x0D]+"
#: What is summed. All but ``unique_fails`` depend on the order.
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_ROW = "struct<alive:boolean,rows:array<struct<" + ",".join(f"{k}:bigint" for k in SUMS) + ">>>"


def orders() -> list[str]:
    return sorted("".join(p) for p in permutations(FILTERS))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, mask: bit i is set if the text alone fails FILTERS[i] (all but E)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", _BLANK, -1), lambda w: w != "")
    rows = rows.withColumn("words", F.size(words)).withColumn("distinct", F.size(F.array_distinct(words)))
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        # capitals are what is missing once they are taken out
        100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > MOST_CAPITALS * F.length("text"),
        F.col("text").rlike(SYMBOLS),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: the documents of each part by what they fail."""
    rows = save(failures(docs), "failures")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    spread = F.xxhash64("doc_id", "digest")
    rows = lookup(rows, first.where("first < last").select("digest", "first"), ["digest"], salts=16, spread=spread, shuffled=True)
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0))
    rows = lookup(rows.select("doc_id", "part", "mask", "digest"), marks, ["doc_id"], salts=16, spread=F.xxhash64("digest"), shuffled=True)
    weight = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), weight("good"), weight("toxic"))


def fold(mask: Column, docs: Column, good: Column, toxic: Column) -> Column:
    """Array of one struct of SUMS for each order and step, orders as in ``orders()``."""
    none = F.lit(0).cast("long")
    bits = F.create_map(*[F.lit(x) for i, k in enumerate(FILTERS) for x in (k, 1 << i)])

    def step(state: Column, letter: Column) -> Column:
        bit = F.element_at(bits, letter)
        fails = mask.bitwiseAND(bit) != 0
        alive = state["alive"]
        one = F.struct(
            F.when(alive & ~fails, docs).otherwise(none).alias("kept"),
            F.when(alive & fails, docs).otherwise(none).alias("removed"),
            F.when(~alive & fails, docs).otherwise(none).alias("redundant"),
            F.when(mask == bit, docs).otherwise(none).alias("unique_fails"),
            F.when(alive & fails, good).otherwise(none).alias("good_lost"),
            F.when(alive & fails, toxic).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["rows"], F.array(one)).alias("rows"))

    start = F.struct(F.lit(True).alias("alive"), F.array().alias("rows")).cast(_ROW)
    all_orders = F.array(*[F.lit(o) for o in orders()])
    return F.flatten(F.transform(all_orders, lambda order: F.aggregate(F.split(order, ""), start, step, lambda s: s["rows"])))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[k] + y[k]).alias(k) for k in SUMS]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter, SUMS and shapley for every part, order and step."""
    folded = cells(docs, labels).select("part", fold(F.col("mask"), F.col("docs"), F.col("good"), F.col("toxic")).alias("rows"))
    # a part has 32 cells at most, so its list is short
    parts = folded.groupBy("part").agg(F.collect_list("rows").alias("cells"))
    merged = parts.select("part", F.aggregate(F.slice("cells", 2, 31), F.col("cells")[0], _add).alias("rows"))
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(k).alias("filter")) for o in orders() for i, k in enumerate(o)])
    placed = merged.select(
        "part", F.zip_with("rows", plan, lambda r, p: F.struct(*[p[k].alias(k) for k in ("filter_order", "step", "filter")], *[r[k].alias(k) for k in SUMS])).alias("rows")
    )
    share = lambda k: F.aggregate(
        F.filter("rows", lambda r: r["filter"] == k), F.lit(0).cast("long"), lambda s, r: s + r["removed"]
    )
    shares = F.create_map(*[x for k in FILTERS for x in (F.lit(k), share(k))])
    rows = placed.withColumn("shares", shares).select("part", "shares", F.explode("rows").alias("row"))
    return rows.select("part", "row.*", F.element_at("shares", F.col("row.filter")).alias("shapley"))


def sql() -> str:
    return r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT w.part, m.good, m.toxic,
    map {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
      'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM words w LEFT JOIN marks m ON m.doc_id = w.doc_id),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
orders AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(list_aggregate(list_distinct([a.k, b.k, c.k, d.k, e.k]), 'string_agg', '')) = 5),
steps AS (
  SELECT part, o, i AS step, o[i] AS k, n, good, toxic, f[o[i]] AS failed,
    len(list_filter(range(1, i), lambda j: f[o[j]])) > 0 AS gone,
    len(map_keys(f)) - len(list_filter(map_values(f), lambda x: NOT x)) = 1 AND f[o[i]] AS alone
  FROM cells, orders, range(1, 6) t(i)),
counted AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, k,
    coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT * EXCLUDE k, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM counted
"""
