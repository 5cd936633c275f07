"""Helpers shared by the operators: staged tables, packed arrays, connected components."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one numpy step works on; longer Arrow batches are cut into several steps.
STEP_BYTES = 12_000_000
# The same for steps that hold several 64-bit numbers per byte.
SMALL_STEP_BYTES = 4_000_000
# White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged").rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; the file system removes it when the session ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor then costs one read."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def worker_state() -> types.ModuleType:
    """State that a reused Python worker keeps between tasks; only caches belong here."""
    return sys.modules.setdefault("_bidlake_llm_worker", types.ModuleType("_bidlake_llm_worker"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Give freed memory back to the system: a worker lives on, and its executor has a limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple]:
    """Slices of Arrow batches as (batch slice, bytes of all texts, start of each text plus the end).

    A null text has no bytes. One text longer than ``step_bytes`` forms a step of its own.
    """
    for batch in batches:
        array = batch.column(column).cast(pa.large_binary())
        n = len(array)
        if not n:
            continue
        ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + n + 1]
        data = array.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(ends, ends[first] + step_bytes, side="right")) - 1
            last = min(max(last, first + 1), n)
            yield batch.slice(first, last - first), data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
            first = last
        del array, ends, data
        tidy()


def words_of(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every run of word bytes; runs end where a text ends.

    ``is_word`` is a 256-entry table of flags.
    """
    flags = np.zeros(len(data) + 2, bool)
    flags[1:-1] = is_word[data]
    begin = flags[1:] & ~flags[:-1]
    end = flags[:-1] & ~flags[1:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[flags[inner] & flags[inner + 1]]  # a word touches the border of two texts
    begin[cut] = True
    end[cut] = True
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return begins, ends, np.searchsorted(starts, begins, side="right") - 1


def byte_strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[begins:ends] as one Arrow array."""
    lengths = ends - begins
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.repeat(begins - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member number of the component of each of n nodes linked by edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for ids that have an edge.

    Alternates large-star and small-star rounds until no edge changes. A hub is one row of the
    side of minima; its edges are an ordinary join side, which AQE can split. Loops and null ends
    are ignored; an empty table gives no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = stage(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stage(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == seen:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = now


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch reduced to stars of the components inside the batch."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[local_roots(len(nodes), index[:len(a)], index[len(a):])]
        far = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])
