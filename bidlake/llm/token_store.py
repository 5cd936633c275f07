"""Token-id files as directly addressable codes.

A segment holds the ids of consecutive documents. An id is split into chunks of ``CHUNK_BITS`` bits,
lowest first. Level 0 holds the first chunk of every id; a bitmap says which ids continue, and level
l + 1 holds the next chunk of those alone. A rank directory counts the set bits before every block of
``RANK_BLOCK`` bits, so any id is read by one lookup per level, without decoding its neighbours.

Layout of a segment, little-endian: magic, documents, ids, levels (int64 each); document ids (int64)
and their null flags (bytes); ids before each document plus the total (int64); per level its length
(int64), its chunks, its bitmap and its rank directory (uint32).

Segments are one binary column of a Parquet table: Spark's committer publishes them, so a repeated
task leaves no second copy. Rows: part, segment_no, n_docs, n_ids, segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm.common import fresh_folder, shuffle_partitions, text_steps
from bidlake.llm.tokens import Encoder

CHUNK_BITS = 8
RANK_BLOCK = 512
END_ID = 2
MAGIC = b"DACODES1"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_segment(doc_ids: np.ndarray, null_ids: np.ndarray, before: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment; ``before`` holds the ids before each document plus the total."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        low = (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(CHUNK_BITS)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bitmap) * 8 // RANK_BLOCK) * RANK_BLOCK // 8, np.uint8)
        padded[:len(bitmap)] = bitmap
        counts = _POPCOUNT[padded].reshape(-1, RANK_BLOCK // 8).sum(axis=1, dtype=np.uint32)
        rank = (np.cumsum(counts) - counts).astype("<u4")
        levels.append((len(low), low, padded, rank))
        rest = rest[more]
        if not len(rest):
            break
    head = MAGIC + np.array([len(doc_ids), len(ids), len(levels)], "<i8").tobytes()
    body = [doc_ids.astype("<i8").tobytes(), null_ids.astype(np.uint8).tobytes(), before.astype("<i8").tobytes()]
    for n, low, bitmap, rank in levels:
        body += [np.array([n], "<i8").tobytes(), low.tobytes(), bitmap.tobytes(), rank.tobytes()]
    return head + b"".join(body)


class Segment:
    """A read view of one segment."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment of token ids")
        n_docs, self.n_ids, n_levels = (int(x) for x in np.frombuffer(raw, "<i8", 3, 8))
        at = 32
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        self.null_ids = np.frombuffer(raw, np.uint8, n_docs, at).astype(bool)
        at += n_docs
        self.before = np.frombuffer(raw, "<i8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(raw, "<i8", 1, at)[0])
            at += 8
            low = np.frombuffer(raw, np.uint8, n, at)
            at += n
            blocks = -(-n // RANK_BLOCK)
            bitmap = np.frombuffer(raw, np.uint8, blocks * RANK_BLOCK // 8, at)
            at += len(bitmap)
            rank = np.frombuffer(raw, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((low, bitmap, rank))

    def ids_at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions of the segment, by rank lookups alone."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_ids):
            raise IndexError("position outside the segment")
        out, alive = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (low, bitmap, rank) in enumerate(self.levels):
            out[alive] |= low[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            more = (bitmap[at >> 3] >> (at & 7)) & 1 == 1
            alive, at = alive[more], at[more]
            if not len(at):
                break
            block = at // RANK_BLOCK
            inside = bitmap.reshape(-1, RANK_BLOCK // 8)[block]
            bits = np.unpackbits(inside, axis=1, bitorder="little").cumsum(axis=1, dtype=np.uint16)
            offset = at % RANK_BLOCK
            at = rank[block].astype(np.int64) + np.where(offset > 0, bits[np.arange(len(at)), offset - 1], 0)
        return out

    def all_ids(self) -> np.ndarray:
        """Every id in order, level by level."""
        out = None
        for low, bitmap, _ in reversed(self.levels):
            here = low.astype(np.uint32)
            if out is not None:
                more = np.unpackbits(bitmap, count=len(low), bitorder="little").view(bool)
                here[more] |= out << np.uint32(CHUNK_BITS)
            out = here
        return out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write segments in ascending doc_id order to ``path``.

    Documents are dealt out by ranges of doc_id, so part numbers follow the order; null ids come
    first, repeated ids stand together, and a null text is an empty one. Other columns are not read.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or shuffle_partitions(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for no, (batch, data, starts) in enumerate(text_steps(batches)):
            ids, before = encoder.encode(data, starts)
            if end_id is not None:
                ids = np.insert(ids, before[1:], np.uint32(end_id))
                before = before + np.arange(len(before))
            keys = batch.column("doc_id")
            raw = encode_segment(keys.fill_null(0).to_numpy(zero_copy_only=False),
                                 keys.is_null().to_numpy(zero_copy_only=False), before, ids)
            yield pa.RecordBatch.from_pydict({
                "segment_no": pa.array([no], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "segment": pa.array([raw], pa.binary())})

    ordered = kept.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(segments, "segment_no int, n_docs long, n_ids long, segment binary")
    out.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments of ``path``."""
    return spark.read.parquet(path)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files of ``path`` to one row per document: doc_id, start (ids of all documents
    before it), n_tokens and ids_crc32 (unsigned, of little-endian 32-bit ids).

    The only thing gathered is one row per part and segment number: its count of ids.
    """
    files = read_tokens(spark, path)
    # as many rows as segments, each of some megabytes; summed here so that no task needs them all
    counts = sorted(files.select("part", "segment_no", "n_ids").toLocalIterator())
    firsts, total = {}, 0
    for part, no, n_ids in counts:
        firsts[part, no] = total
        total += n_ids
    base = spark.createDataFrame(
        [(p, n, s) for (p, n), s in firsts.items()], "part int, segment_no int, first long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = Segment(batch.column("segment")[i].as_buffer().to_pybytes())
                ids = held.all_ids().astype("<u4") if held.n_ids else np.zeros(0, "<u4")
                view = memoryview(ids).cast("B")
                ends = (held.before * 4).tolist()
                crc = [zlib.crc32(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(held.doc_ids, pa.int64(), mask=held.null_ids),
                    "start": pa.array(held.before[:-1] + batch.column("first")[i].as_py(), pa.int64()),
                    "n_tokens": pa.array(np.diff(held.before), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.join(base, ["part", "segment_no"]).select("segment", "first").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_index(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a fresh shared folder and read the document index back from the files."""
    path = fresh_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return document_index(docs.sparkSession, path)
