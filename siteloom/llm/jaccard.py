"""N-gram Jaccard join: exact links between texts of similar shingle sets, with a count-vector R-tree.

1. Every text becomes a set of 64-bit hashes of its word shingles. Texts with one set are one node.
2. Nodes that may link are dealt together. For sizes in a band, two sets over the threshold differ in at most d shingles;
   shingles are hashed into more than d groups, so at least one group holds the same shingles in both. The hash of each
   group's contents is a key. A task combines the keys of its texts before the shuffle, which carries packed rows of one
   hash bucket each; equal keys that meet give an edge. Small sets, whose groups would often be empty, are keyed by their
   rarest shingles instead (prefix filter with counts over all small sets). Nodes connected by edges are a cluster.
   With ``rare`` all sets are keyed by their rarest shingles: at low thresholds a group holds so few shingles that texts which
   only share a passage would meet. Shingles are counted in packed hash buckets; a set whose prefix nobody shares sends no key.
   No link is lost: both are pigeonhole arguments, not sampling. Edges are between the top 40 bits of node hashes; nodes that
   share these come into one cluster, which costs a check and changes no result.
3. In a cluster, shingles are hashed into groups and the counts per group are points of an R-tree. For a point and a tree
   node, the sum of the coordinates' minima (with the node's largest counts) bounds the overlap from above; pairs that
   survive the bound are verified on the sets. Two nodes that are already connected need no check, so a family of near
   copies costs about one check each.
   Clusters are cut into tiles of bounded size, which are joined within; then some nodes of each connected part look for other
   parts, and at last every two pieces of different parts meet. No task holds a cluster, and no link is left out.
4. Links are connected to components by alternating star contractions.

Cases: a null text or one without words has no shingles and no links; a text with fewer words than a shingle is one
shingle; repeated rows are one node and are connected; rows without an id belong to the component of their text, whose id is the
smallest id in it (null if there is none); an empty table gives an empty result. Other columns play no part. Hashes are taken
as equal only for equal shingles (chance of 2**-64 a pair).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from siteloom.llm.common import as_bytes, flat_ids, lookup, mixed, save, slices, tidy, unused

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Nodes of a tile, coordinates of a point, points or nodes below a tree node.
TILE, GROUPS, FAN = 1024, 256, 16
#: Sets of up to so many shingles are keyed by their rarest shingles.
SMALL = 128
#: Shingles for each hash bucket of the key shuffle (about as many keys at most); keys that a task combines at a time; bytes
#: of text that it cuts into words at a time.
PER_BUCKET, HELD, SLICE = 1 << 20, 1 << 19, 1 << 20
#: How many sets of a slice of text a key must be in to be called common there, and how many common keys are treated apart.
OFTEN, COMMON = 6, 4096
#: Nodes of each connected part of a tile that look for the parts of other tiles, before all nodes of different parts meet.
SOME = 8
#: Rows (whole texts, packed buckets, sets) that go to Python at once, and entries that come back at once.
ROWS, ENTRIES = 512, 1 << 16
_BITS = 24  # what an edge leaves out of a node's hash


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_sets(texts: list[bytes], words: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ids, counts, distinct = flat_ids([t.translate(_LOWER).split() for t in texts])
    codes = np.array([xxh64_intdigest(w) for w in distinct], np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
    out = []
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            own = codes[a:b]
            size = min(words, len(own))
            if not size:
                out.append(own)
                continue
            n = len(own) - size + 1
            value = np.full(n, size, np.uint64)
            for k in range(size):
                value = value * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
            out.append(np.unique(mixed(value)))
    return out


class Bands:
    """Sizes in bands, and the keys of a set. ``top`` / ``bottom`` is the threshold."""

    def __init__(self, top: int = 9, bottom: int = 10, small: int = SMALL):
        self.top, self.bottom, self.small = top, bottom, small
        self.edges = [small + 1]
        while self.edges[-1] < 1 << 32:
            self.edges.append(int(self.edges[-1] * (bottom / top) ** (2 if bottom < 1.15 * top else 1)) + 2)
        self.groups = [self._groups(k) for k in range(len(self.edges) - 1)]

    def differ(self, band: int) -> int:
        """Most shingles in which two linked sets differ, the larger of which is in the band."""
        most = self.edges[band + 1] - 1
        return 2 * most * (self.bottom - self.top) // (self.bottom + self.top)

    def _groups(self, band: int) -> tuple[int, int]:
        """(groups, slack): beyond those that differ there are more groups than the smallest set of the band is likely to leave empty."""
        differ, least = self.differ(band), self.edges[band] * self.top / self.bottom
        slack = 2
        for _ in range(60):
            empty = (differ + 1 + slack) * math.exp(-least / (differ + 1 + slack))
            need = math.ceil(empty + 3.5 * math.sqrt(empty) + 1)
            if slack >= need or slack >= 4 * differ + 8:
                break
            slack = need
        return differ + 1 + slack, slack

    def prefix(self, size: int) -> int:
        """How many of a set's first shingles, in any common order, a linked set cannot all lack."""
        return size - -(-size * self.top // self.bottom) + 1

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys for all pairs whose larger set is not small."""
        n = len(shingles)
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = []
        for k in (band, band + 1):
            if k < 0 or k > band and n * self.bottom < self.edges[k] * self.top:
                continue  # too small for any set of the next band
            groups, slack = self.groups[k]
            group = (mixed(shingles ^ np.uint64(k + 1)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            filled, starts = np.unique(group[order], return_index=True)
            content = np.bitwise_xor.reduceat(mixed(shingles[order]), starts)
            out.append(mixed(content ^ mixed(filled + (k << 32))))
            if groups - len(filled) > slack:  # both sets of a pair that only shares empty groups have so many
                missing = np.setdiff1d(np.arange(groups), filled)
                out.append(mixed(mixed(missing + (k << 32)) ^ np.uint64(0xE)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_hash(shingles: np.ndarray) -> int | None:
    return xxh64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def _mark() -> Column:
    """16 bytes that stand for a row's id and text: copies of a row are told apart from all other rows, whatever the ids."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.col("text").cast("string"))))


def _short(shingles: np.ndarray) -> np.ndarray:
    """Distinct 40-bit keys of a set's shingles."""
    return np.unique(shingles >> np.uint64(_BITS))


def _common(sets: list[np.ndarray]) -> list[int]:
    """Keys in many of these sets, copies of a set counting once."""
    distinct = {s.tobytes(): s for s in sets if len(s)}
    if len(distinct) < OFTEN:
        return []
    keys, counts = np.unique(np.concatenate([_short(s) for s in distinct.values()]), return_counts=True)
    often = np.flatnonzero(counts >= max(OFTEN, len(distinct) // 50))
    return keys[often[np.argsort(-counts[often], kind="stable")][:COMMON]].tolist()


def nodes_of(docs: DataFrame, words: int, bands: Bands, rare: bool = False) -> DataFrame:
    """doc_id, mark, n_shingles, node (hash of the set, null if it is empty), grams (the set, if it is small).

    With ``rare`` no grams, but beyond: the length of the set's prefix less its keys, and common: keys that are frequent near by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            sets = shingle_sets(as_bytes(rows.column("text")), words)
            grams = [_long(s) if not rare and 0 < len(s) <= bands.small else None for s in sets]
            beyond = [bands.prefix(len(s)) - len(_short(s)) if rare else None for s in sets]
            common = [_common(sets) if rare else None, *[None] * (len(sets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_hash(s) for s in sets], pa.int64()),
                    pa.array(grams, pa.list_(pa.int64())),
                    pa.array(beyond, pa.int64()),
                    pa.array(common, pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "n_shingles", "node", "grams", "beyond", "common"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark")).mapInArrow(
        tidy(run), "doc_id long, mark binary, n_shingles long, node long, grams array<long>, beyond long, common array<long>"
    )


def _five(numbers: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the first entry of each key, and edges from every other node of a key to the first one."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    hub = nodes[np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))]
    other = nodes != hub
    pairs = np.unique(np.stack([nodes[other], hub[other]], axis=1), axis=0)
    return order[fresh], pairs[:, 0], pairs[:, 1]


_KEYED = "bucket int, keys binary, nodes binary, a binary, b binary"


def large_edges(docs: DataFrame, words: int, bands: Bands, buckets: int) -> DataFrame:
    """(a, b): top bits of nodes that share a key, for pairs whose larger set is not small. ``buckets`` is a power of 2."""
    low = np.uint64(64 - buckets.bit_length() + 1)

    def packed(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        first, a, b = _stars(key, node)
        key, node = key[first], node[first]
        bucket = (key >> low).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        at = [(k, order[x:y]) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in at], pa.int32()),
                pa.array([_five(key[i]) for _, i in at], pa.binary()),
                pa.array([_five(node[i]) for _, i in at], pa.binary()),
                # edges found here go along with the first row
                pa.array([_five(a)] + [b""] * (len(at) - 1), pa.binary()),
                pa.array([_five(b)] + [b""] * (len(at) - 1), pa.binary()),
            ],
            names=["bucket", "keys", "nodes", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for rows in slices(batches, "text", SLICE):
            for s in shingle_sets(as_bytes(rows.column("text")), words):
                own = bands.keys(s)
                if len(own):
                    keys.append(own)
                    nodes.append(np.full(len(own), (node_hash(s) + (1 << 63)) >> _BITS, np.uint64))
                    held += len(own)
                if held >= HELD:
                    yield packed(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield packed(keys, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket; a bucket holds its share of the keys
        now, keys, nodes = None, [], []

        def close() -> pa.RecordBatch:
            _, a, b = _stars(np.concatenate(keys), np.concatenate(nodes))
            return pa.RecordBatch.from_arrays([pa.array(_long(a)), pa.array(_long(b))], names=["a", "b"])

        for batch in batches:
            for bucket, key, node, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "nodes", "a", "b"))):
                if bucket != now and keys:
                    yield close()
                    keys, nodes = [], []
                now = bucket
                keys.append(_from_five(key))
                nodes.append(_from_five(node))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(_long(_from_five(a))), pa.array(_long(_from_five(b)))], names=["a", "b"])
        if keys:
            yield close()

    keyed = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), _KEYED)
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "a long, b long")


def small_edges(nodes: DataFrame, bands: Bands) -> DataFrame:
    """The same for pairs of small sets: nodes that share one of their rarest shingles."""
    small = nodes.where("grams is not null")
    grams = small.select("node", "n_shingles", F.explode("grams").alias("key"))
    # most shingles occur once; only the others' counts are looked up
    counts = grams.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "key")
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * bands.top / bands.bottom - 1e-9) + 1
    ranked = lookup(grams, counts, ["key"], salts=8).withColumn("rank", F.row_number().over(order))
    return _met(save(ranked.where((F.col("rank") <= first) & F.col("n").isNotNull()).select("node", "key"), "rare"))


def _met(keyed: DataFrame) -> DataFrame:
    """(a, b): top bits of each node and of the first node with the same key. ``keyed`` has node, key."""
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("key", "hub")
    met = lookup(keyed, hubs, ["key"], salts=8).where("hub is not null and node != hub")
    top = lambda c: F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-(1 << 63))), _BITS)
    return met.select(top("node").alias("a"), top("hub").alias("b"))


def shared_keys(docs: DataFrame, words: int, common: list[int], buckets: int) -> DataFrame:
    """node, key, n: keys that several sets hold, and in how many; common ones come last in the order of n, whatever their count.

    Entries go in packed rows of one hash bucket each. Common keys are not counted, so no bucket gets all rows of a frequent passage.
    """
    low = np.uint64(40 - buckets.bit_length() + 1)
    known = np.unique(np.array(common, np.uint64))

    def packed(keys: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        key, at = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        node = np.array(nodes, np.int64)
        often = np.isin(key, known)
        rows = [(nodes[0] % buckets, True, key[often], at[often])] if often.any() else []
        key, at = key[~often], at[~often]
        bucket = (key >> low).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows += [(k, False, key[order[x:y]], at[order[x:y]]) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        held = [np.unique(own, return_inverse=True) for _, _, _, own in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.bool_()),
                pa.array([_five(r[2]) for r in rows], pa.binary()),
                pa.array([i.astype("<u2").tobytes() for _, i in held], pa.binary()),
                pa.array([node[u].tobytes() for u, _ in held], pa.binary()),
            ],
            names=["bucket", "often", "keys", "at", "nodes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held, seen = [], [], 0, set()
        for rows in slices(batches, "text", SLICE):
            for s in shingle_sets(as_bytes(rows.column("text")), words):
                node = node_hash(s)
                if node is None or node in seen:  # a copy that is met again counts once; those of other tasks are left out later
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(node)
                keys.append(_short(s))
                nodes.append(node)
                held += len(keys[-1])
                if held >= HELD or len(keys) == 1 << 16:
                    yield from packed(keys, nodes)
                    keys, nodes, held = [], [], 0
        if keys:
            yield from packed(keys, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, nodes = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[fresh], node[fresh]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lengths = np.diff(np.append(starts, len(key)))
            n = np.repeat(lengths, lengths)
            yield from entries(node[n > 1], key[n > 1], n[n > 1])

        def entries(node: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(node), ENTRIES):
                some = slice(k, k + ENTRIES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(_long(key[some])), pa.array(n[some].astype(np.int64))], names=["node", "key", "n"]
                )

        for batch in batches:
            for bucket, often, key, at, node in zip(*(batch.column(c).to_pylist() for c in ("bucket", "often", "keys", "at", "nodes"))):
                if bucket != now and keys:
                    yield from close()
                    keys, nodes = [], []
                now = bucket
                key, node = _from_five(key), np.frombuffer(node, np.int64)[np.frombuffer(at, "<u2")]
                if often:
                    yield from entries(node, key, np.full(len(key), 1 << 40))
                else:
                    keys.append(key)
                    nodes.append(node)
        if keys:
            yield from close()

    keyed = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "bucket int, often boolean, keys binary, at binary, nodes binary")
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "node long, key long, n long")


def rare_edges(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, buckets: int) -> DataFrame:
    """(a, b): top bits of nodes that share a key of their prefixes, in the order of how many sets hold a key."""
    # a bounded list of keys that are treated apart for their frequency; which ones changes no result
    often = rows.select(F.explode("common").alias("key")).groupBy("key").count().orderBy(F.desc("count"), "key").limit(COMMON).collect()
    # copies of a set in several tasks send its common keys more than once
    shared = shared_keys(docs, words, [r["key"] for r in often], buckets)
    shared = shared.repartition("node").dropDuplicates(["node", "n", "key"])
    own = Window.partitionBy("node")
    ranked = shared.withColumns({"rank": F.row_number().over(own.orderBy("n", "key")), "shared": F.count("*").over(own)})
    beyond = nodes.select("node", "beyond")
    first = F.col("rank") <= F.col("beyond") + F.col("shared")
    return _met(save(ranked.join(beyond, "node").where(first).select("node", "key"), "rare", ROWS))


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b) that has a neighbour: root is the smallest node it is connected with.

    Large-star and small-star steps in turn; each halves long ways, and edges are written to the shared folder between
    rounds. A node with very many neighbours is joined with copies of its row.
    """
    now = save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", ROWS)
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = lookup(both.where("b > a"), least, ["a"], salts=8).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        first = down.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(down, first, ["a"], salts=8)
        now = save(
            small.select("b", F.col("m")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(first.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == state or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen


def _points(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of each set fall into each group."""
    out = np.zeros((len(sets), GROUPS), np.uint16)
    for i, s in enumerate(sets):
        out[i] = np.minimum(np.bincount((mixed(s ^ np.uint64(0x5A)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS), 65535)
    return out


class RTree:
    """Points in the order given (by size), packed into nodes of FAN; a node keeps the largest counts and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FAN:
            top, low, high = self.levels[-1]
            starts = np.arange(0, len(top), FAN)
            self.levels.append(
                (np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts))
            )

    def search(self, point: np.ndarray, size: int, bands: Bands) -> np.ndarray:
        """Points whose overlap with this one can be large enough."""
        top, bottom = bands.top, bands.bottom
        at = np.arange(len(self.levels[-1][0]))
        for level, (most, low, high) in reversed(list(enumerate(self.levels))):
            at = at[at < len(most)]
            at = at[(low[at] * top <= size * bottom) & (high[at] * bottom >= size * top)]
            bound = np.minimum(most[at], point).sum(axis=1, dtype=np.int64)
            at = at[bound * (bottom + top) >= top * (size + np.maximum(low[at], -(-size * top // bottom)))]
            if level:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
        return at


def _linked(a: np.ndarray, b: np.ndarray, bands: Bands) -> bool:
    overlap = len(np.intersect1d(a, b, assume_unique=True))
    return bands.bottom * overlap >= bands.top * (len(a) + len(b) - overlap)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def _join_tiles(rows: pa.Table, bands: Bands, across: bool) -> pa.Table:
    """Links (a, b) within a tile, or across two tiles (within one, if there is one) of nodes whose components are known. Only links
    that connect more are checked."""
    order = pc.sort_indices(rows, sort_keys=[("n_shingles", "ascending"), ("node", "ascending")])
    rows = rows.take(order)
    names, sizes = rows.column("node").to_pylist(), rows.column("n_shingles").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    union, found = _Union(len(names)), []
    side = rows.column("tile").to_pylist()
    one_side = len(set(side)) == 1
    if across:
        first: dict[int, int] = {}
        for i, root in enumerate(rows.column("root").to_pylist()):
            union.join(i, first.setdefault(root, i))
    if len({union.root(i) for i in range(len(names))}) > 1:
        points = _points(sets)
        tree = RTree(points, sizes)
        for i in range(len(names)):
            for j in tree.search(points[i], int(sizes[i]), bands).tolist():
                if j > i and (not across or one_side or side[i] != side[j]) and union.root(i) != union.root(j) and _linked(sets[i], sets[j], bands):
                    union.join(i, j)
                    found.append((names[i], names[j]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def links(docs: DataFrame, nodes: DataFrame, words: int, bands: Bands, tile: int = TILE, rows: DataFrame | None = None) -> DataFrame:
    """(a, b): links between nodes that connect all that any link connects. ``nodes`` has node, n_shingles, mark (of one of its rows), grams.
    ``rows`` of ``nodes_of`` with ``rare``, if nodes are dealt together by their rarest shingles."""
    shingles = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 1 << max(6, (shingles // PER_BUCKET).bit_length())
    if rows is None:
        edges = large_edges(docs, words, bands, buckets).union(small_edges(nodes, bands))
    else:
        edges = rare_edges(docs, rows, nodes, words, buckets)
    clusters = components(edges)
    clusters = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "top")
    top = F.shiftrightunsigned(F.col("node").bitwiseXOR(F.lit(-(1 << 63))), _BITS)
    placed = nodes.select("node", "mark", top.alias("top")).join(clusters, "top")
    placed = save(placed.select("node", "mark", F.col("root").alias("cluster")), "placed")
    counts = placed.groupBy("cluster").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    spread = F.pmod(F.xxhash64(F.col("node")), F.col("tiles")).cast("int").alias("tile")
    tiles = lookup(placed, counts, ["cluster"], salts=8).select("node", "mark", "cluster", spread, F.col("tiles").cast("int").alias("tiles"))
    # repeated rows are one; the distinct and the join share an exchange
    texts = docs.select(_mark().alias("mark"), F.col("text").cast("string").alias("text")).dropDuplicates(["mark"])
    # a merge join whatever the sizes: a broadcast of the wanted rows would grow with the corpus
    rows = texts.join(tiles.hint("merge"), "mark").select("node", "cluster", "tile", "tiles", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(as_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("node", "cluster", "tile", "tiles")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["node", "cluster", "tile", "tiles", "n_shingles", "shingles"],
            )

    kinds = "node long, cluster long, tile int, tiles int, n_shingles long, shingles binary"
    sets = save(rows.mapInArrow(tidy(run), kinds), "sets", ROWS)
    within = save(
        sets.groupBy("cluster", "tile").applyInArrow(lambda rows: _join_tiles(rows, bands, False), "a long, b long"), "links", ROWS
    )
    large = sets.where("tiles > 1")
    if large.isEmpty():
        return within
    # what is connected inside the tiles of a cluster is connected with each other by some nodes of each, as far as these link
    rooted = _rooted(large, components(within))
    some = Window.partitionBy("cluster", "tile", "root").orderBy("node")
    first = rooted.withColumn("place", F.row_number().over(some)).where(F.col("place") <= SOME).drop("root", "place")
    counts = first.groupBy("cluster").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = lookup(first, counts, ["cluster"], salts=8, spread=F.xxhash64("node")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "parts"))
    met = dealt.drop("parts").groupBy("cluster", "part").applyInArrow(lambda rows: _join_tiles(rows, bands, False), "a long, b long")
    known = save(within.union(met), "links", ROWS)
    return known.union(_across(_rooted(large, components(known)), bands, tile))


def _rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``sets`` with the root of each node, itself if it has no link."""
    own = roots.withColumnRenamed("node", "_node")
    return sets.join(own, sets["node"] == own["_node"], "left").withColumn("root", F.coalesce("root", "node")).drop("_node")


def _across(rooted: DataFrame, bands: Bands, tile: int) -> DataFrame:
    """Links between the components of a cluster: (a, b). A cluster of one component is done.

    Large components are cut in pieces, small ones packed together, both by size of sets. Two pieces meet if sets of their sizes
    can be linked and they are not of one component, so a family of near copies, which is one component by now, meets only what
    else there is of its size in its cluster.
    """
    sizes = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    several = sizes.groupBy("cluster").agg(F.count("*").alias("roots")).where("roots > 1").select("cluster")
    owned = sizes.join(several, "cluster").select("root", F.when(F.col("n") > tile, F.col("root")).alias("own"), F.lit(True).alias("open"))
    placed = lookup(rooted, owned, ["root"], salts=8, spread=F.xxhash64("node")).where("open").drop("open", "tile", "tiles")
    # sizes of linked sets differ by less than two bands; the base is a little larger, so that rounding loses none
    base = math.log(bands.bottom / bands.top) * 1.0001
    placed = placed.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / base).cast("int"))
    cuts = placed.groupBy("cluster", "own", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    placed = lookup(placed, cuts, ["cluster", "own", "band"], salts=8, spread=F.xxhash64("node", F.lit(1)))
    name = lambda own, band, chunk: F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("")), band, chunk)
    placed = placed.withColumn("tile", name(F.col("own"), F.col("band"), F.pmod(F.xxhash64("node", F.lit(3)), "chunks"))).drop("chunks")
    # some entries for about ``tile`` nodes of the cluster
    listed = cuts.select("cluster", "own", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    listed = listed.select("cluster", F.struct(name(F.col("own"), F.col("band"), F.col("chunk")).alias("tile"), "own", "band").alias("piece"))
    pieces = listed.groupBy("cluster").agg(F.collect_list("piece").alias("pieces"))
    rows = lookup(placed, pieces, ["cluster"], salts=8, spread=F.xxhash64("node", F.lit(2)))
    same = lambda q: F.coalesce(q["own"] == F.col("own"), F.lit(False))
    meets = F.filter("pieces", lambda q: (F.abs(q["band"] - F.col("band")) <= 1) & ~same(q))
    pairs = rows.select("*", F.explode(meets).alias("other")).drop("pieces", "own", "band")
    pairs = pairs.withColumns({"low": F.least("tile", "other.tile"), "high": F.greatest("tile", "other.tile")}).drop("other")
    return pairs.groupBy("cluster", "low", "high").applyInArrow(lambda rows: _join_tiles(rows, bands, True), "a long, b long")


def join(docs: DataFrame, words: int = 3, percent: int = 90, tile: int = TILE, rare: bool = False) -> DataFrame:
    """doc_id, mark, n_shingles, node, root, component_id of every row of ``docs``. ``root`` is the component itself: the smallest node in it.
    ``rare`` chooses how candidates are found, not what is found."""
    bands = Bands(percent, 100)
    rows = save(nodes_of(docs, words, bands, rare), "nodes", ROWS)
    nodes = save(
        rows.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.min("mark").alias("mark"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"),
            F.any_value("grams").alias("grams"), F.max("beyond").alias("beyond"),
        ),
        "distinct",
    )
    roots = components(links(docs, nodes, words, bands, tile, rows if rare else None))
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    known = nodes.select(F.col("node").alias("_node"), "least", "copies").join(roots, F.col("_node") == roots["node"], "left")
    known = known.withColumn("root", F.coalesce("root", "_node")).select("_node", "root", "least", "copies")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # single texts without copies are their own component and need no look-up
    named = lookup(known, smallest, ["root"], salts=8).where("n > 1 or copies > 1").select(
        F.col("_node").alias("node"), "root", "component_id", F.lit(True).alias("joined")
    )
    out = lookup(rows.drop("grams", "beyond", "common"), named, ["node"], salts=16, spread=F.xxhash64("mark"))
    component_id = F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "mark", "n_shingles", "node", F.coalesce("root", "node").alias("root"), component_id)


def one_of_each(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays, of equal rows one.

    Components are told apart by their root, not by an id: ids may be missing or shared by texts that have nothing in common.
    """
    name = unused("_mark", docs)
    found = join(docs, words, percent, rare=True).where("node is not null")
    # a row without an id stays only where no row of the component has one
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "mark"))
    kept = found.groupBy("root").agg(least.alias("least")).select(F.col("least.mark").alias(name))
    # a text without words is linked with nothing and stays; marks are one key, so join and distinct share an exchange
    with_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = docs.where(with_words).withColumn(name, _mark()).join(kept.hint("merge"), name, "left_semi").dropDuplicates([name])
    return first.drop(name).union(docs.where(~with_words)).select(*docs.columns)
