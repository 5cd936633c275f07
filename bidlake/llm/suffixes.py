"""Suffix-array dedup: bytes covered by strings of ``WINDOW`` bytes that start more than once.

1. Every window of the corpus belongs to an anchor, a content-defined place inside it, so equal
   windows have equal anchors. Tasks send packed arrays of anchors, dealt by hash.
2. An anchor met once owns no repeated window. The bytes that an anchor's windows span are its
   context. A context met twice repeats every window in it, and needs no bytes.
3. Distinct contexts of one anchor may still share windows. Their bytes go to buckets of about
   BUCKET_BYTES by anchor, each with one suffix array that marks what is equal over WINDOW bytes. Only
   a bucket above BATCH_BYTES is taken in batches; their arrays are joined by ranking them anew.
   An anchor with more than ``HOT_CONTEXTS`` distinct contexts is dealt out window by window instead.
4. The marked spans return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.anchors import anchors, span_hashes
from bidlake.llm.common import SMALL_STEP_BYTES, byte_strings, ranges, shuffle_partitions, stage, text_steps, tidy

WINDOW = 200
BATCH_BYTES = 2_000_000
BUCKET_BYTES = 1_500_000
HOT_CONTEXTS = 50_000


def suffix_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Lexicographic rank of the ``window`` bytes from every place, by prefix doubling."""
    if len(data) < window:
        return np.zeros(0, np.int64)
    length = min(5, window)
    value = np.zeros(len(data) - length + 1, np.uint64)
    for k in range(length):
        value = (value << np.uint64(8)) | data[k:len(data) - length + 1 + k]
    rank, bits = _dense(value, 8 * length), max(len(data).bit_length(), 1)
    while length < window:
        step = min(length, window - length)
        n = len(rank) - step
        rank = _dense((rank[:n].astype(np.uint64) << np.uint64(bits)) | rank[step:].astype(np.uint64), 2 * bits)
        length += step
    return rank


def _order(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ascending order of ``value``, the values in that order); ties by place."""
    at = max(len(value).bit_length(), 1)
    if bits + at <= 64:  # sorting value and place in one word is much faster than sorting places
        packed = np.sort((value.astype(np.uint64) << np.uint64(at)) | np.arange(len(value), dtype=np.uint64))
        return (packed & np.uint64((1 << at) - 1)).astype(np.int64), packed >> np.uint64(at)
    order = np.argsort(value, kind="stable")
    return order, value[order]


def _dense(value: np.ndarray, bits: int) -> np.ndarray:
    order, ordered = _order(value, bits)
    rank = np.empty(len(value), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return rank


class Level:
    """A suffix array over the windows of some contexts, in order of their bytes, with marks."""

    def __init__(self, data: np.ndarray, places: np.ndarray, numbers: np.ndarray, batches: int, window: int):
        self.data, self.batches, self.window = data, batches, window
        rank = suffix_ranks(data, window)[places] if len(places) else places
        order, ordered = _order(rank, max(len(data).bit_length(), 1))
        self.suffixes, self.numbers = places[order], numbers[order]
        same = ordered[1:] == ordered[:-1]
        self.repeated = np.zeros(len(places), bool)
        self.repeated[1:] |= same
        self.repeated[:-1] |= same

    def merged(self, other: Level) -> Level:
        return Level(np.concatenate([self.data, other.data]), np.concatenate([self.suffixes, other.suffixes + len(self.data)]),
                     np.concatenate([self.numbers, other.numbers]), self.batches + other.batches, self.window)


class Family:
    """Levels of 1, 2, 4, ... batches. Every pair of batches ends in one level, so no match is lost."""

    def __init__(self, window: int):
        self.levels: list[Level] = []
        self.window = window

    def add(self, data: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> None:
        level = Level(data, places, numbers, 1, self.window)
        while self.levels and self.levels[-1].batches == level.batches:
            level = self.levels.pop().merged(level)
        self.levels.append(level)

    def marks(self, n: int) -> np.ndarray:
        """Whether each of the n windows added is met twice."""
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)
        out = np.zeros(n, bool)
        for level in self.levels:
            out[level.numbers] = level.repeated
        return out


def repeated_windows(lengths: np.ndarray, data: np.ndarray, window: int, batch_bytes: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(context, place in it) of every window of the contexts that is met twice among them."""
    first = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - window + 1, 0)
    family, at, base = Family(window), 0, 0
    while at < len(lengths):
        to = max(int(np.searchsorted(first, first[at] + batch_bytes)), at + 1)
        rows = np.arange(at, min(to, len(lengths)))
        begin, end = first[rows[0]], first[rows[-1]] + lengths[rows[-1]]
        places = ranges(first[rows] - begin, windows[rows])
        family.add(data[begin:end], places, base + np.arange(len(places)))
        base += len(places)
        at = rows[-1] + 1
    marked = np.flatnonzero(family.marks(base))
    context = np.repeat(np.arange(len(lengths)), windows)[marked]
    return context, marked - (np.cumsum(windows) - windows)[context]


def _keyed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns of the caller in one struct ``row``, the text, and the key of a row; rows
    of one doc_id and text share it."""
    return docs.select(
        F.struct(*(docs[f"`{c}`"] for c in carried)).alias("row"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string")).alias("k2"))


_ANCHOR = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("length", "<u2")])


def _found(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """k1, k2, start, length, anchor, single, hot: the contexts of anchors met more than once, each
    occurrence of those met twice (anchor null) and one of every distinct one that needs its bytes."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in text_steps(batches, step_bytes=SMALL_STEP_BYTES):
            text, first, last, hashed = anchors(data, starts, window)
            if not len(text):
                continue
            rows = np.zeros(len(text), _ANCHOR)
            rows["anchor"], rows["context"] = hashed, span_hashes(data, first, last + window)
            rows["start"], rows["length"] = first - starts[text], last + window - first
            bucket = (hashed >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, text, bucket = rows[order], text[order], bucket[order]
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1))), len(bucket))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                used, place = np.unique(text[a:b], return_inverse=True)
                part = rows[a:b]
                part["doc"] = place
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket[a]], pa.int32()), "k1": pa.array([k1[used].tobytes()], pa.binary()),
                    "k2": pa.array([k2[used].tobytes()], pa.binary()), "rows": pa.array([part.tobytes()], pa.binary())})

    def count(key: tuple, table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(r, _ANCHOR)) for a, b, r in zip(
            *(table.column(c).to_pylist() for c in ("k1", "k2", "rows")), strict=True)]
        rows = np.concatenate([r for _, _, r in parts])
        doc = np.concatenate([r["doc"] + np.int64(n) for n, (_, _, r) in zip(np.cumsum([0] + [len(a) for a, _, _ in parts]), parts, strict=False)])
        k1, k2 = np.concatenate([a for a, _, _ in parts]), np.concatenate([b for _, b, _ in parts])
        order = np.lexsort((rows["context"], rows["anchor"]))
        rows, doc = rows[order], doc[order]
        new_anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])
        new_context = new_anchor | np.concatenate([[True], rows["context"][1:] != rows["context"][:-1]])
        context = np.cumsum(new_context) - 1
        anchor = np.cumsum(new_anchor) - 1
        times = np.bincount(context)
        kinds = np.bincount(anchor[new_context])
        twice = times[context] > 1
        bytes_needed = new_context & (kinds[anchor] > 1)
        chosen = np.concatenate([np.flatnonzero(twice), np.flatnonzero(bytes_needed)])
        need = np.arange(len(chosen)) >= twice.sum()
        return pa.table({
            "k1": k1[doc[chosen]], "k2": k2[doc[chosen]], "start": rows["start"][chosen].astype(np.int64),
            "length": rows["length"][chosen].astype(np.int32),
            "anchor": pa.array(rows["anchor"][chosen].view(np.int64), pa.int64(), mask=~need),
            "single": pa.array(~twice[chosen]), "hot": pa.array(kinds[anchor[chosen]] > HOT_CONTEXTS)})

    packed = docs.select("k1", "k2", "text").mapInArrow(scan, "bucket int, k1 binary, k2 binary, rows binary")
    return packed.groupBy("bucket").applyInArrow(
        count, "k1 long, k2 long, start long, length int, anchor long, single boolean, hot boolean")


def repeated_spans(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """k1, k2, spans (array of start, end in bytes; may overlap) of every keyed row with a repeat."""
    spark = docs.sparkSession
    found = stage(_found(docs, window, 4 * shuffle_partitions(spark)), "contexts")
    marks = found.filter("anchor is null").select("k1", "k2", "start", (F.col("start") + F.col("length")).alias("end"))
    wanted = found.filter("anchor is not null")
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    buckets = max(-(-total // bucket_bytes), 1)
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "length", "anchor", "single", "hot")).alias("w"))
    texts = docs.select("k1", "k2", "text").join(lists, ["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in text_steps(batches):
            lists = batch.column("w")
            each = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(each)), each)
            start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy().astype(np.int64)
            begin = starts[doc] + start
            rows = pa.array(doc)
            yield pa.RecordBatch.from_pydict({
                "k1": batch.column("k1").take(rows), "k2": batch.column("k2").take(rows), "start": flat.field("start"),
                "bucket": pa.array((flat.field("anchor").to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int32)),
                "single": flat.field("single"), "hot": flat.field("hot"),
                "bytes": byte_strings(data, begin, begin + length).cast(pa.binary())})

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        raw = table.column("bytes").combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        context, place = repeated_windows(np.diff(ends), data, window)
        single = table.column("single").to_numpy(zero_copy_only=False)
        keep = single[context]
        context, place = context[keep], place[keep]
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(context))[:len(first)] - 1
        at = context[first]
        tidy()
        start = table.column("start").to_numpy()[at] + place[first]
        return pa.table({"k1": table.column("k1").to_numpy()[at], "k2": table.column("k2").to_numpy()[at],
                         "start": start, "end": start + (place[last] - place[first]) + window})

    pieces = texts.select("k1", "k2", "text", "w").mapInArrow(
        cut, "k1 long, k2 long, start long, bucket int, single boolean, hot boolean, bytes binary")
    # equal rows give equal pieces; these are never single, so their repeats mark nothing
    pieces = stage(pieces, "pieces")
    near = pieces.filter("not hot").groupBy("bucket").applyInArrow(scan, "k1 long, k2 long, start long, end long")
    windows = pieces.filter("hot").select("k1", "k2", "start", "single", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("bytes") - window + 1), lambda i: F.substring(F.col("bytes"), i, F.lit(window)))).alias("at", "w"))
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    hot = windows.join(twice, "w").filter("single").select(
        "k1", "k2", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + window).alias("end"))
    spans = marks.unionByName(near).unionByName(hot)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts anywhere else.

    ``docs`` has doc_id and text; a null text is empty, repeated rows repeat each other, and matches
    never cross rows. Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 per row; with
    ``texts`` the columns of ``docs`` instead, whatever their names, with the text that is left. There
    a span grows to whole characters, so that what is left is valid text; a null text stays null, and
    so does a null doc_id. An empty table gives no rows.
    """
    carried = [c for c in docs.columns if c != "text"] if texts else ["doc_id"]
    keyed = _keyed(docs, carried)
    spans = repeated_spans(keyed, window)
    joined = keyed.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in text_steps(batches):
            lists = batch.column("spans")
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                raw = data[a:b]
                begin, end = _union(lists[i])
                if texts and len(begin):
                    begin, end = _whole_characters(raw, begin, end)
                keep = np.ones(len(raw), bool)
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    keep[s:e] = False
                left = (raw[keep] if len(begin) else raw).tobytes()
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(left))
                out["n_spans"].append(len(begin))
                out["kept"].append(left if texts else hashlib.sha256(left).hexdigest())
            if texts:
                text = batch.column("text")
                left = pa.array([None if text[i].as_py() is None else x.decode("utf-8", "replace") for i, x in enumerate(out["kept"])], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row"), left], ["row", "text"])
            else:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                    "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()),
                    "kept_sha256": pa.array(out["kept"], pa.string())})

    if not texts:
        joined = joined.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "spans")
        return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    left = joined.mapInArrow(apply, joined.select("row", "text").schema)
    return left.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _union(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, in order, that cover the same bytes."""
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = spans.values.field("start").to_numpy(), spans.values.field("end").to_numpy()
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


def _whole_characters(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = (raw & 0xC0) == 0x80
    begin, end = begin.copy(), end.copy()
    for _ in range(3):
        begin -= inner[begin]
        end += np.where(end < len(raw), inner[np.minimum(end, len(raw) - 1)], False)
    return begin, end
