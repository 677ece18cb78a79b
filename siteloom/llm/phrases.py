"""Lempel-Ziv phrase fingerprints: texts that compress alike share dictionary phrases.

1. A text is parsed into dictionary phrases from left to right: the shortest piece not yet in the dictionary is the next
   phrase and enters it. A phrase's hash is a polynomial over its code points, so the hashes of all phrases of a text are one
   segmented sum.
2. The ``SIZE`` smallest distinct phrase hashes are the signature (all of them, if there are fewer). The likeness of two
   signatures is the share of values in both among the ``SIZE`` smallest of their union: an estimate of the Jaccard
   similarity of the phrase sets, with a standard error of at most 0.5 / sqrt(SIZE), exact for short texts.
3. An edited text ends with the beginning of the next document. Documents are dealt by ranges of doc_id to buckets of some
   thousand rows, sorted there and streamed; the first row of each bucket is also sent to the bucket before it (that of
   the first bucket to the last one), so each text meets the next one in one shuffle. The parse of the part that both the
   text and its edited form begin with is shared. Only one text and its neighbour are in memory.

The ends of the ranges are quantiles of doc_id (a mergeable sketch); they and the first rows of the buckets are at most
``MOST`` numbers each, which may reach the driver and are broadcast. Beyond that, buckets get larger and are streamed all the same.

Cases: a null text is an empty one; it has no phrases and an empty fingerprint, and two empty signatures have likeness 1, an empty
and another one 0. Rows are ordered by doc_id (nulls last), then by the text's hash, so rows that share an id have a defined
order; rows equal in both are interchangeable. An id that many rows share, or none, gets several buckets by that hash. The only row of a
table is its own next one. Texts of fewer than four code points are not edited. An empty table gives an empty result. Other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import as_bytes, mixed, slices

#: Values of a signature and hexadecimal digits of each.
SIZE, DIGITS = 64, 12
#: Rows of a bucket, and the most buckets.
ROWS, MOST = 4096, 1 << 14
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FACTOR = 0x9E3779B97F4A7C15


def _parse(text: str, seen: set[str], start: str, ends: list[int], at: int) -> str:
    """Parses ``text``, which begins at code point ``at``, after the unfinished phrase ``start``; phrases enter ``seen``, their
    ends ``ends``. Returns the phrase that is unfinished at the end, which is in the dictionary already."""
    now, add, end = start, seen.add, ends.append
    for at, c in enumerate(text, at + 1):  # noqa: B020
        now += c
        if now not in seen:
            add(now)
            end(at)
            now = ""
    return now


def _parse_over(text: str, below: set[str], start: str, ends: list[int], at: int) -> None:
    """Like ``_parse``, but the dictionary ``below`` stays as it was."""
    now, seen = start, set()
    for at, c in enumerate(text, at + 1):  # noqa: B020
        now += c
        if now not in below and now not in seen:
            seen.add(now)
            ends.append(at)
            now = ""


def _powers(n: int, made: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:
    """_FACTOR ** 0 ... _FACTOR ** (n - 1) modulo 2**64."""
    if len(made[0]) < n:
        with np.errstate(over="ignore"):
            made[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _FACTOR, np.uint64))])
    return made[0][:n]


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest distinct hashes of the phrases that end at ``ends``, ascending."""
    if not ends:
        return np.zeros(0, np.uint64)
    stops = np.array(ends, np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = stops - starts
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(codes * _powers(int(lengths.max()))[place], starts)
        hashes = mixed(sums ^ mixed(lengths)) >> np.uint64(64 - 4 * DIGITS)
    return np.unique(hashes)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets with these signatures."""
    both = np.union1d(a, b)[:SIZE]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).mean()) if len(both) else 1.0


def written(values: np.ndarray) -> str:
    """A signature as text: its values in hexadecimal digits, one after the other."""
    return "".join(f"{x:0{DIGITS}x}" for x in values.tolist())


class _Document:
    """A text, parsed up to where its edited form differs and, on its own, to the end."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 4
        self.seen: set[str] = set()
        self.ends: list[int] = []
        self.open = _parse(text[: self.cut], self.seen, "", self.ends, 0)
        ends = list(self.ends)
        _parse_over(text[self.cut :], self.seen, self.open, ends, self.cut)
        self.signature = signature(text, ends)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The edited text and its signature. The dictionary is used up."""
        tail = following[: len(self.text) - self.cut]
        text = self.text[: self.cut] + tail
        if text == self.text:
            return text, self.signature
        ends = list(self.ends)
        _parse(tail, self.seen, self.open, ends, self.cut)
        return text, signature(text, ends)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, a bucket's own rows in order and then the first row of the next one."""
    before: _Document | None = None
    bucket, done = None, False
    for rows in slices(batches, "text", 1 << 20):
        out = []
        for own, guest, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("bucket", "guest", "doc_id")), as_bytes(rows.column("text"))):
            if own != bucket:
                bucket, before, done = own, None, False
            if done:
                continue  # of several guests that are equal the first one has served
            now = _Document(doc_id, text.decode("utf-8", "surrogatepass"))
            if before is not None:
                edited, other = before.edited(now.text)
                out.append(
                    (
                        before.doc_id, len(before.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(before.signature),
                        written(other), likeness(before.signature, other), likeness(before.signature, now.signature),
                    )
                )
            before, done = now, guest
        if out:
            names = [x.split(" ")[0] for x in RESULT.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def _hash(text: Column) -> Column:
    """63 bits, so that it sorts as its leading bits do."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def _bucket(edges: list[int], n_null: int) -> Column:
    """Number of the bucket of ``doc_id`` and ``hash``: how many edges are below, and for an id that is an edge several times, or
    null, a share of its buckets by the hash. Edges are searched by halving."""
    n = len(edges)
    part = lambda k: F.shiftright(F.shiftright("hash", 32) * k, 31).cast("int")
    if not n:
        return F.when(F.col("doc_id").isNull(), 1 + part(F.lit(n_null))).otherwise(0)
    all_edges = F.array(*[F.lit(e).cast("long") for e in edges])
    halvings = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def below(orequal: bool) -> Column:
        def step(at: Column, size: Column) -> Column:
            edge = F.get(all_edges, at + size - 1)
            return F.when((at + size <= n) & ((edge <= F.col("doc_id")) if orequal else (edge < F.col("doc_id"))), at + size).otherwise(at)

        return F.aggregate(halvings, F.lit(0), step)

    # an edge that occurs once begins its bucket; one that occurs k times has k buckets
    low, high = below(False), below(True)
    filled = F.when(high == low, low).otherwise(low + 1 + part(high - low))
    return F.when(F.col("doc_id").isNull(), n + 1 + part(F.lit(n_null))).otherwise(filled)


def fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    counted = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("n_null")).first()
    n_edges = min(counted["n"] // rows, MOST)
    n_null = max(1, min(counted["n_null"] // rows, MOST))
    edges: list[int] = []
    if n_edges:
        levels = [k / (n_edges + 1) for k in range(1, n_edges + 1)]
        edges = sorted(docs.agg(F.percentile_approx("doc_id", levels, max(10_000, 4 * n_edges))).first()[0])
    placed = docs.withColumn("hash", _hash(F.col("text"))).withColumn("bucket", _bucket(edges, n_null))
    # nulls are last: a struct of (is null, id, hash) sorts as the rows do
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "hash")
    firsts = [(r["bucket"], r["key"]) for r in placed.groupBy("bucket").agg(F.min(key).alias("key")).orderBy("bucket").collect()]
    guests = [(k["doc_id"], k["hash"], firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    sent = spark.createDataFrame(guests, "_id long, _hash long, _to int")
    # one row a bucket, so of bounded size
    placed = placed.join(F.broadcast(sent), placed["doc_id"].eqNullSafe(sent["_id"]) & (placed["hash"] == sent["_hash"]), "left")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("guest")))
    dealt = placed.withColumn("place", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())))
    dealt = dealt.select("place.bucket", "place.guest", "doc_id", "hash", "text").repartition("bucket")
    streamed = dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "hash")
    return streamed.mapInArrow(_compare, RESULT)
