"""Byte-level BPE over a global table of distinct words.

Texts are cut into pre-tokens ("words") by Spark's regular expressions. Blocks of documents are turned into the distinct
words of the block and the sequence of their numbers, which is where each word stands. The words of all blocks are
shuffled by word (in hash buckets), so that each distinct word is encoded once in the whole job however often it occurs; a
word that is everywhere comes once per block, not once per occurrence. Ids go back to their block, where the sequence puts them in
their places. Decoding looks token ids up in the token-byte table, whose size is that of the vocabulary file, many at once.
``round_trip`` decodes a block's ids in the task that has put them in their places.

Cases: a null or empty text has no tokens; one very long word is encoded in n log n; repeated rows are encoded each;
null ids stay null; an empty table gives an empty result. Other columns play no part. Letters that Java does not know yet
are cut by the ``regex`` library; for those newer than both that and the tokenizer's engine the cuts may differ. Blocks are made twice, for words
and for sequences; both carry a digest of the block's contents, and the job fails if they do not fit together (which
can only happen if ``docs`` changes between two reads).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64

from siteloom.llm.common import give_back, tidy

#: Words per block. A block's sequence and its ids are one row and one group, so this bounds a task's memory.
BLOCK_WORDS = 1 << 21
#: Hash buckets of the word shuffle. The distinct words of one bucket are held in memory, so a corpus with more distinct
#: words takes more buckets: 1024 serve some hundred million.
BUCKETS = 1024
#: Words or tokens that are handled at once; what a step needs besides its block is bounded by this (and by one document).
PIECE = 1 << 17
#: White space as Unicode has it, in Java's spelling.
_SPACE = r"\t-\r\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def native_pattern(pattern: str) -> str:
    """``pattern`` for Java, whose white space is ASCII unless it is spelt out."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S":
            out.append(f"[^{_SPACE}]")
        else:
            two = two if two.startswith("\\") else pattern[i]
            inside = two == "[" or (inside and two != "]")
            out.append(two)
        i += 2 if pattern[i] == "\\" else 1
    return "".join(out)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file: one line per token, its bytes in base 64 and its id. It is bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of neighbours with the lowest rank, the leftmost of equals, is joined until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2]) for i in range(len(word) - 1)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end of the part that starts at i; start of the part before it
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end or middle == end:
            continue
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            r = ranks.get(word[i : ends[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if i:
            r = ranks.get(word[before[i] : end])
            if r is not None:
                heapq.heappush(heap, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, size: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(block id, doc ids, words per document, numbers of the words in order, distinct words) of runs of documents."""
    part = TaskContext.get().partitionId()
    waiting: list[tuple[pa.Array, np.ndarray, pa.Array]] = []

    def close(n: int):
        ids = pa.concat_arrays([w[0] for w in waiting])
        counts = np.concatenate([w[1] for w in waiting])
        coded = pa.concat_arrays([w[2] for w in waiting]).dictionary_encode()
        sequence = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        digest = xxh64(sequence.tobytes(), seed=part)
        digest.update(repr((part, n, ids.to_pylist())).encode())
        for buffer in coded.dictionary.buffers():
            digest.update(memoryview(buffer) if buffer is not None else b"")
        return digest.intdigest() - (1 << 63), ids, counts, sequence, coded.dictionary

    held = n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # as many rows as the block has room for, one at least
            lists = batch.column("words").slice(at)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            take = max(1, int(np.searchsorted(np.cumsum(lengths), size - held, side="right")))
            rows = batch.slice(at, take)
            counts, words = lengths[:take].astype(np.int64), rows.column("words").flatten().cast(pa.large_binary())
            odd = rows.column("odd")
            if odd.null_count < take:  # texts with characters that Java does not know
                counts, words = _with_odd(rows, pattern)
            waiting.append((rows.column("doc_id"), counts, words))
            held += int(counts.sum())
            at += take
            if held >= size:
                yield close(n)
                waiting, held, n = [], 0, n + 1
        if waiting:  # the next batch comes when this one is gone: what waits of it, its last part, is a copy
            ids, counts, words = waiting[-1]
            waiting[-1] = pa.concat_arrays([ids]), counts, pa.concat_arrays([words])
        batch = lists = rows = ids = words = odd = None
    if waiting:
        yield close(n)


def _with_odd(rows: pa.RecordBatch, pattern: str) -> tuple[np.ndarray, pa.Array]:
    import regex

    cut = regex.compile(pattern)
    lists = [
        [w.encode() for w in cut.findall(odd)] if odd is not None else (words or [])
        for odd, words in zip(rows.column("odd").to_pylist(), rows.column("words").cast(pa.list_(pa.binary())).to_pylist())
    ]
    return np.array([len(x) for x in lists], np.int64), pa.array([w for x in lists for w in x], pa.large_binary())


def _small(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2**21 or so in 7 bits a byte, the last byte of each marked; frequent ones are small."""
    return b"".join(_small_piece(numbers[i : i + PIECE]) for i in range(0, len(numbers), PIECE))


def _small_piece(numbers: np.ndarray) -> bytes:
    x = numbers.astype(np.uint32)
    width = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21) + (x >= 1 << 28)
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = width > k
        out[ends[has] - 1 - k] = ((x[has] >> np.uint32(7 * k)) & np.uint32(0x7F)) | (0x80 if k == 0 else 0)
    return out.tobytes()


def _unsmall(data: bytes, kind: type = np.int64) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b & 0x80)
    out = np.empty(len(ends), kind)
    before = -1  # where the number before ends
    for i in range(0, len(ends), PIECE):
        last = ends[i : i + PIECE]
        starts = np.concatenate([[before], last[:-1]]) + 1
        numbers = np.zeros(len(last), np.int64)
        for k in range(5):
            at = last - k
            has = at >= starts
            numbers[has] |= (b[at[has]] & 0x7F).astype(np.int64) << (7 * k)
        out[i : i + PIECE] = numbers
        before = last[-1]
    return out


def _runs(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``size`` elements together at most, or of one row."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_words: int = BLOCK_WORDS, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id and ids (array of token ids) of every document."""

    def as_they_are(doc_ids: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, ids], names=["doc_id", "ids"])

    return _encoded(docs, ranks, pattern, block_words, buckets, as_they_are, "doc_id long, ids array<int>")


def round_trip(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False, with_ids: bool = False,
    block_words: int = BLOCK_WORDS, buckets: int = BUCKETS,
) -> DataFrame:
    """What ``decode`` gives of the rows of ``encode``, made in the same tasks: ids go to the JVM only if they are asked for."""
    tables: Broadcast = docs.sparkSession.sparkContext.broadcast(TokenTable(ranks))

    def decoded(doc_ids: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        return _decoded(doc_ids, ids, tables.value, digests, with_ids)

    return _encoded(docs, ranks, pattern, block_words, buckets, decoded, _decoded_kinds(digests, with_ids))


def _encoded(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_words: int, buckets: int,
    finish: Callable[[pa.Array, pa.ListArray], pa.RecordBatch], kinds: str,
) -> DataFrame:
    """What ``finish`` makes of doc ids and their token ids, for all documents.

    A row of the word shuffle holds one block's words of one hash bucket, and its numbers there; the words of a bucket meet
    in one task, which remembers the ids of the bucket's distinct words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary file's size
    text = F.coalesce(F.col("text"), F.lit(""))
    unknown = text.rlike(r"\p{Cn}")
    words = F.when(~unknown, F.regexp_extract_all(text, F.lit(native_pattern(pattern)), F.lit(0)))
    cut = docs.select(F.col("doc_id").cast("long"), words.alias("words"), F.when(unknown, text).alias("odd"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, sequence, distinct in _blocks(batches, pattern, block_words):
            rank = _by_frequency(sequence, len(distinct))
            words = distinct.to_pylist()
            bucket = np.array([xxh32_intdigest(w) % buckets for w in words], np.int64)
            order = np.lexsort((rank, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            filled = [(k, order[x:y]) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            lists = [[words[i] for i in at.tolist()] for _, at in filled]
            columns = [
                pa.array([block] * len(filled), pa.int64()),
                pa.array([k for k, _ in filled], pa.int32()),
                pa.array([_small(np.diff(rank[at], prepend=0)) for _, at in filled], pa.binary()),
                pa.array([_small(np.array([len(w) for w in x])) for x in lists], pa.binary()),
                pa.array([b"".join(x) for x in lists], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "numbers", "lengths", "words"])

    def sequences_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, counts, sequence, distinct in _blocks(batches, pattern, block_words):
            place = _by_frequency(sequence, len(distinct))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts.tolist()], pa.list_(pa.int64())),
                    pa.array([_small(place[sequence])], pa.binary()),
                    pa.array([len(distinct)], pa.int64()),
                ],
                names=["block", "ids", "counts", "sequence", "n_distinct"],
            )

    found = cut.mapInArrow(tidy(words_of), "block long, bucket int, numbers binary, lengths binary, words binary")
    sequences = cut.mapInArrow(tidy(sequences_of), "block long, ids array<long>, counts array<long>, sequence binary, n_distinct long")
    kind = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket, so what is known of a bucket's words can be dropped at its end
        ranks, now, known = shared.value, None, {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                counts, tokens = [], []
                for bucket, lengths, words in zip(*(rows.column(c).to_pylist() for c in ("bucket", "lengths", "words"))):
                    if bucket != now:
                        now, known = bucket, {}
                    ends = np.cumsum(_unsmall(lengths)).tolist()
                    ids = []
                    for x, y in zip([0, *ends], ends):
                        word = words[x:y]
                        one = known.get(word)
                        if one is None:
                            one = known[word] = merge(word, ranks)
                        ids.append(one)
                    counts.append(_small(np.array([len(x) for x in ids])))
                    tokens.append(np.array([i for x in ids for i in x], kind).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("block"), rows.column("numbers"), pa.array(counts, pa.binary()), pa.array(tokens, pa.binary())],
                    names=["block", "numbers", "counts", "tokens"],
                )

    encoded = (
        found.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(tidy(encode_words), "block long, numbers binary, counts binary, tokens binary")
    )

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, sizes = [], []
        for n, c in zip(right.column("numbers").to_pylist(), right.column("counts").to_pylist()):
            numbers.append(np.cumsum(_unsmall(n)))
            sizes.append(_unsmall(c))
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        if left.num_rows != 1 or len(number) != left.column("n_distinct")[0].as_py():
            raise ValueError("a block and its words do not fit together: the documents changed between two reads")
        flat = np.frombuffer(b"".join(right.column("tokens").to_pylist()), kind)
        size, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        each = np.concatenate(sizes) if sizes else number
        size[number], start[number] = each, np.cumsum(each) - each
        sequence = _unsmall(left.column("sequence")[0].as_py(), np.int32)
        counts, ids = np.array(left.column("counts")[0].as_py(), np.int64), pa.array(left.column("ids")[0].as_py(), pa.int64())
        edges, parts = np.concatenate([[0], np.cumsum(counts)]), []
        for a, b in _runs(counts, PIECE):
            words = sequence[edges[a] : edges[b]]
            per_word = size[words]
            ends = np.concatenate([[0], np.cumsum(per_word)])
            take = np.repeat(start[words] - ends[:-1], per_word)
            take += np.arange(len(take))
            within = ends[edges[a : b + 1] - edges[a]].astype(np.int32)
            parts.append(finish(ids[a:b], pa.ListArray.from_arrays(pa.array(within), pa.array(flat[take].astype(np.int32)))))
        give_back()
        return pa.Table.from_batches(parts)

    return sequences.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(reassemble, kinds)


def _by_frequency(sequence: np.ndarray, n: int) -> np.ndarray:
    """New numbers of the words: the most frequent is 0."""
    place = np.empty(n, np.int32)
    place[np.argsort(-np.bincount(sequence, minlength=n), kind="stable")] = np.arange(n, dtype=np.int32)
    return place


class TokenTable:
    """Bytes of each token id, and its decimal form with a blank after it."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        pieces = [b""] * size
        for piece, i in ranks.items():
            pieces[i] = piece
        self.pieces = pa.array(pieces, pa.large_binary())
        self.numbers = pa.array([b"%d " % i for i in range(size)], pa.large_binary())


def _joined(table: pa.Array, tokens: pa.Array, edges: np.ndarray, tail: int = 0) -> list[memoryview]:
    """The entries of ``tokens``, joined from edge to edge, without the last ``tail`` bytes of each."""
    taken = table.take(tokens)
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1][edges].tolist()
    view = memoryview(data if data is not None else b"")
    return [view[x : max(x, y - tail)] for x, y in zip(at, at[1:])]


def _decoded_kinds(digests: bool, with_ids: bool) -> str:
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, decoded binary"
    return kinds + ", ids array<int>" * with_ids


def _decoded(doc_ids: pa.Array, ids: pa.ListArray, table: TokenTable, digests: bool, with_ids: bool) -> pa.RecordBatch:
    """Rows of ``decode``; tokens are looked up some PIECE at a time."""
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = ids.flatten(), np.concatenate([[0], np.cumsum(counts)])
    if flat.null_count:
        raise ValueError("a token id is null")
    ids_sha256, decoded = [], []
    for a, b in _runs(counts, PIECE):
        tokens, edges = flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        texts = _joined(table.pieces, tokens, edges)
        if digests:
            decoded += [hashlib.sha256(x).hexdigest() for x in texts]
            ids_sha256 += [hashlib.sha256(x).hexdigest() for x in _joined(table.numbers, tokens, edges, tail=1)]
        else:
            decoded += [x.tobytes() for x in texts]
    if digests:
        columns = {"doc_id": doc_ids, "n_tokens": pa.array(counts), "ids_sha256": pa.array(ids_sha256, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
    else:
        columns = {"doc_id": doc_ids, "decoded": pa.array(decoded, pa.binary())}
    columns |= {"ids": ids} if with_ids else {}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def decode(encoded: DataFrame, ranks: dict[bytes, int], digests: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id and the decoded bytes of every row of doc_id, ids; also the ids if asked for.

    The join with the token-byte table is a broadcast one, made in the tasks: the table has one row per vocabulary entry.
    With ``digests`` the bytes and the ids are given as their SHA-256 instead (doc_id, n_tokens, ids_sha256, decoded_sha256).
    """
    tables: Broadcast = encoded.sparkSession.sparkContext.broadcast(TokenTable(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                yield _decoded(rows.column("doc_id"), rows.column("ids"), tables.value, digests, with_ids)

    return encoded.mapInArrow(tidy(run), _decoded_kinds(digests, with_ids))
