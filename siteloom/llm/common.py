"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files of a query go when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to Python at once. A task holds such a batch in the JVM, with room to grow, and in Python.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def save(df: DataFrame, what: str = "table", batch: int | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends there, lost executors lose nothing.

    Its shuffle files are of no further use then, so they are given up with the write. ``batch`` is for rows of whole texts: as
    many go to Python at once, and not what the session says.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    held = {_CLEANUP: "true"} | ({} if batch is None else {_BATCH: str(batch)})
    before = {key: spark.conf.get(key, None) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that Python has freed goes back to the system; allocators keep it else, as long as a worker waits for tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some systems have it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a ``mapInArrow`` whose worker holds no memory of a task that has ended, while the JVM goes on."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def lookup(
    many: DataFrame, small: DataFrame, on: list[str], salts: int = 32, spread: Column | None = None, shuffled: bool = False
) -> DataFrame:
    """Left join to a table with one row per key, null keys equal; each of its rows is copied ``salts`` times.

    A key that holds a third of ``many`` is thereby dealt to ``salts`` tasks. With ``shuffled`` no side goes through the driver. It
    is for a ``small`` that grows with the input: Spark judges it by its files, packed and without the copies, and would broadcast it.
    """
    spread = F.xxhash64(*[c for c, kind in many.dtypes if "map<" not in kind]) if spread is None else spread
    salt, copy = unused("_salt", many, small), unused("_copy", many, small)
    left = many.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    names = {c: unused(f"_key_{i}", many, small) for i, c in enumerate(on)}
    right = small.withColumnsRenamed(names).withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = left[salt] == right[copy]
    for c, k in names.items():
        same = same & left[c].eqNullSafe(right[k])
    return left.join(right.hint("merge") if shuffled else right, same, "left").drop(salt, copy, *names.values())


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of the tables has it: for columns that an operator adds for its own use."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def flat_ids(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all words, one after the other, the length of each list, and the distinct words by number."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    numbers: dict[bytes, int] = {}
    for w in words:
        numbers.update(dict.fromkeys(w))
    for i, w in enumerate(numbers):
        numbers[w] = i
    ids = np.empty(int(counts.sum()), np.int64)
    at = 0
    get = numbers.__getitem__
    for w in words:
        ids[at : at + len(w)] = list(map(get, w))
        at += len(w)
    return ids, counts, list(numbers)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: near inputs give unrelated outputs."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
