"""Alignment of two tokenizers over the same texts by products of incidence matrices.

Tokenizer A (byte-level BPE) encodes a blank and the text, tokenizer B (piece BPE with byte fallback)
the text, to which it adds the blank itself. Strings of special tokens inside a text are plain text.
A text whose joined A or B bytes differ from blank and text, or that is null or empty, has no tokens.

All texts of a step form one byte axis. The token-byte incidence of A and the transposed one of B are
CSR matrices built by hand; their product, row by row after Gustavson, has one entry per overlapping
pair of tokens: a link, whose value is the number of shared bytes. Offsets at which tokens of both end
cut the axis into groups; the product of the token-group incidences has an entry for every pair of
tokens of one group. Those pairs are summed by a product with the vector of ones instead of being
listed, since one group can hold a whole text.

An id pair's count is the number of documents that hold it linked. Counts are summed on Spark; at most
``FREQUENT_PAIRS`` pairs, the most frequent ones, are broadcast to the documents, and all others meet
them in a join, where none of them is hot.

Defined cases: every row is a document of its own, also where doc_ids are null or repeat; an empty
table gives no rows; further columns of the caller are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.llm.common import ranges, stage, text_steps, worker_state
from bidlake.llm.tokens import Encoder

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
# Text bytes of one step; a step holds some 25 numbers of 64 bits per byte at its widest point.
STEP = 1_500_000
FREQUENT_PAIRS = 1 << 19
_BLANK = 0x20

ALIGNED = ("doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>, "
           "link_a array<int>, link_b array<int>, link_bytes array<int>")
SUMMED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
          "pairs array<long>, times array<int>")


def _place(name: str) -> str:
    """A vocabulary file: a path, or a name that the machine which runs the task resolves itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens(Encoder):
    """Tokenizer A: strings of its special tokens are plain text; ``bytes_of`` gives the bytes of its ids."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.added = []
        back = {letter: byte for byte, letter in self.letters.items()}
        entries = {i: bytes(back[x] for x in entry) for entry, i in self.library.get_vocab(with_added_tokens=False).items()
                   if all(x in back for x in entry)}
        self.bytes_of = _Table([entries.get(i, b"") for i in range(max(entries) + 1)])


class PieceTokens(Encoder):
    """Tokenizer B. A text is cut before a blank that follows no blank, where no piece can reach across
    (checked against the vocabulary), and equal parts are encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.lone_blank = self.library.piece_to_id("▁")
        self.bytes_of = _Table([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                                for i, p in enumerate(pieces)])
        self._forget()

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        if not self.whole:
            blank = data == _BLANK
            cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[starts] = True
        return np.flatnonzero(cut)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [x[1:].decode("utf-8", "replace") for x in words.to_pylist()]
        ids = [x or [self.lone_blank] for x in self.library.encode(texts, num_threads=1)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


class _Table:
    """Byte strings by number, flat."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def join(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.first[numbers], self.sizes[numbers])]


def _tokens(kind: type, name: str) -> Encoder:
    held = worker_state().__dict__.setdefault("aligned_encoders", {})
    key = (kind.__name__, name)
    if key not in held:
        held[key] = kind(_place(name))
    return held[key]


def gustavson(left: tuple, right: tuple, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of two CSR matrices of ones, (row starts, column numbers) each, as CSR with values.

    Row by row: the rows of ``right`` that a row of ``left`` names are joined and equal columns summed.
    """
    (starts, columns), (inner_starts, inner_columns) = left, right
    sizes = np.diff(inner_starts)[columns]
    row = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), sizes)
    entry = row * n_columns + inner_columns[ranges(inner_starts[columns], sizes)]
    del row, sizes
    if (entry[1:] < entry[:-1]).any():
        entry = np.sort(entry)
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
    values = np.diff(np.append(first, len(entry)))
    rows, found = np.divmod(entry[first], max(n_columns, 1))
    return np.searchsorted(rows, np.arange(len(starts))), found, values


def _exact(ids: np.ndarray, before: np.ndarray, table: _Table, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts the joined bytes of their tokens equal."""
    sizes = table.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    same = np.diff(ends[before]) == np.diff(starts)
    joined = table.join(ids[np.repeat(same, np.diff(before))])
    expected = np.repeat(same, np.diff(starts))
    wrong = np.flatnonzero(joined != data[expected])
    if len(wrong):
        same[np.searchsorted(starts, np.flatnonzero(expected)[wrong], side="right") - 1] = False
    return same


class _Aligned:
    """The alignment of the texts of one step; tokens and links of all its texts lie one after another."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, a: Encoder, b: Encoder):
        n = len(starts) - 1
        begins = starts + np.arange(n + 1)
        spaced = np.full(len(data) + n, _BLANK, np.uint8)
        spaced[ranges(begins[:-1] + 1, np.diff(starts))] = data
        ids_a, before_a = a.encode(spaced, begins)
        ids_b, before_b = b.encode(spaced, begins)
        kept = (np.diff(starts) > 0) & _exact(ids_a, before_a, a.bytes_of, spaced, begins) & _exact(
            ids_b, before_b, b.bytes_of, spaced, begins)
        del spaced
        self.a, self.before_a = _kept(ids_a, before_a, kept)
        self.b, self.before_b = _kept(ids_b, before_b, kept)
        ends_a, ends_b = np.cumsum(a.bytes_of.sizes[self.a]), np.cumsum(b.bytes_of.sizes[self.b])
        width = int(ends_a[-1]) if len(ends_a) else 0
        of_byte_b = np.repeat(np.arange(len(self.b)), b.bytes_of.sizes[self.b])
        row_starts, self.link_b, self.link_bytes = gustavson(
            (np.append(0, ends_a), np.arange(width)), (np.arange(width + 1), of_byte_b), len(self.b))
        self.link_a = np.repeat(np.arange(len(self.a)), np.diff(row_starts))
        self.before_links = row_starts[self.before_a]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_of_a, self.group_of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.group_a = np.bincount(self.group_of_a, minlength=len(common))
        self.group_b = np.bincount(self.group_of_b, minlength=len(common))
        self.before_groups = np.searchsorted(common, np.append(0, ends_a)[self.before_a], side="right")
        # (A x group) . (group x B) . ones: how many B tokens share the group of each A token
        self.shared = self.group_b[self.group_of_a]

    def groups_text(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, starts): per text its groups ``a1,a2|b1;...`` in decimal, a separator after each token."""
        n_a, n_b = len(self.a), len(self.b)
        ahead_b = np.cumsum(self.group_b) - self.group_b
        through_a = np.cumsum(self.group_a)
        place_a = np.arange(n_a) + ahead_b[self.group_of_a]
        place_b = np.arange(n_b) + through_a[self.group_of_b]
        ids = np.zeros(n_a + n_b, np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        mark = np.full(n_a + n_b, ord(","), np.uint8)
        mark[place_a[through_a - 1]] = ord("|")
        mark[place_b[np.cumsum(self.group_b) - 1]] = ord(";")
        digits = np.ones(len(ids), np.int64)
        power = 10
        while len(ids) and power <= ids.max():
            digits += ids >= power
            power *= 10
        after = np.cumsum(digits + 1)
        out = np.zeros(int(after[-1]) if len(after) else 0, np.uint8)
        out[after - 1] = mark
        at, rest, todo = after - 2, ids, digits
        while len(rest):
            out[at] = ord("0") + rest % 10
            more = todo > 1
            at, rest, todo = at[more] - 1, rest[more] // 10, todo[more] - 1
        return out, np.append(0, after)[self.before_a + self.before_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A id << 32 | B id, links that hold it, start per text) of the distinct linked id pairs of each text."""
        n_a, n_b = int(self.a.max(initial=0)) + 1, int(self.b.max(initial=0)) + 1
        text = np.repeat(np.arange(len(self.before_a) - 1), np.diff(self.before_links))
        key, times = np.unique((text * n_a + self.a[self.link_a]) * n_b + self.b[self.link_b], return_counts=True)
        key, id_b = np.divmod(key, n_b)
        text, id_a = np.divmod(key, n_a)
        return (id_a << 32) | id_b, times, np.searchsorted(text, np.arange(len(self.before_a)))


def _kept(ids: np.ndarray, before: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(before)
    return ids[np.repeat(kept, sizes)].astype(np.int64), np.concatenate([[0], np.cumsum(np.where(kept, sizes, 0))])


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values).cast(kind))


def _steps(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[tuple[pa.RecordBatch, _Aligned]]:
    one, two = _tokens(ByteTokens, a), _tokens(PieceTokens, b)
    for part, data, starts in text_steps(batches, step_bytes=STEP):
        yield part, _Aligned(data, starts, one, two)


def alignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> DataFrame:
    """Per row of ``docs``: its token ids in ``a`` and ``b``, how many of each fill every group, and the
    links as token numbers (from 0) with the bytes that both cover. ``a`` and ``b`` are paths, or names
    that the executors resolve."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _steps(batches, a, b):
            links = np.diff(x.before_links)
            columns = [(x.a, x.before_a), (x.b, x.before_b), (x.group_a, x.before_groups), (x.group_b, x.before_groups),
                       (x.link_a - np.repeat(x.before_a[:-1], links), x.before_links),
                       (x.link_b - np.repeat(x.before_b[:-1], links), x.before_links), (x.link_bytes, x.before_links)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(_lists(v, s, pa.int32()) for v, s in columns)],
                ["doc_id", "a", "b", "group_a", "group_b", "link_a", "link_b", "link_bytes"])

    return _input(docs, doc_id, text).mapInArrow(task, ALIGNED)


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _summaries(docs: DataFrame, a: str, b: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _steps(batches, a, b):
            said, starts = x.groups_text()
            view = memoryview(said)
            hashes = [hashlib.sha256(view[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(starts[:-1], starts[1:], strict=True)]
            pairs, times, before = x.pairs()
            shared = np.concatenate([[0], np.cumsum(x.shared)])[x.before_a]
            counts = [np.diff(v).astype(np.int64) for v in (x.before_a, x.before_b, x.before_groups, x.before_links, shared)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, counts), pa.array(hashes, pa.string()),
                 _lists(pairs, before, pa.int64()), _lists(times, before, pa.int32())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"])

    return docs.mapInArrow(task, SUMMED)


def pair_counts(summaries: DataFrame) -> DataFrame:
    """(pair, docs, best): the documents that hold each id pair linked, and whether no pair of its A id has more."""
    counts = summaries.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("docs") == most)


def _frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """``counts`` split into its most frequent rows, ``limit`` at most, and the others (None: there are none)."""
    level = F.floor(8 * F.log2("docs"))
    sizes = counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect()  # some 8 rows per doubling
    taken, cut = 0, None
    for row in sizes:
        if taken + row["count"] > limit:
            break
        taken, cut = taken + row["count"], row["level"]
    if taken == sum(row["count"] for row in sizes):
        return counts, None
    if cut is None:
        return counts.limit(0), counts
    return counts.filter(level >= cut), counts.filter(level < cut)


def _where(known: np.ndarray, links: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """links * values[at] where ``known``, else 0."""
    out = np.zeros(len(links), np.int64)
    out[known] = links[known] * values[at[known]]
    return out


def alignment_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B,
                     frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_shared per row of ``docs``.

    n_best counts the links whose pair is the most frequent one of its A id (or ties with it), count_sum
    adds the counts of all links, n_shared the pairs of tokens that lie in one group.
    """
    spark: SparkSession = docs.sparkSession
    found = stage(_summaries(_input(docs, doc_id, text), a, b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(found), "pair-counts")
    frequent, others = _frequent(counts, frequent_pairs)
    table = frequent.toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "docs", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_of, best_of = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            sizes = np.diff(pairs.offsets.to_numpy())
            key, links = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (
                _where(known, links, best_of, at), _where(known, links, docs_of, at))]
            before = np.concatenate([[0], np.cumsum(~known)])[ends]
            same = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*same, *map(pa.array, sums), _lists(key[~known], before, pa.int64()), _lists(links[~known], before, pa.int64())],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum", "rest", "rest_times"])

    known = found.mapInArrow(look_up, (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
        "n_best long, count_sum long, rest array<long>, rest_times array<long>"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
    if others is None:
        return known.select(*columns)
    known = stage(known, "aligned-known")
    rest = known.select("row", F.explode(F.arrays_zip(F.col("rest").alias("pair"), F.col("rest_times").alias("links"))).alias("e"))
    added = rest.select("row", "e.*").join(others, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more"))
    return known.join(added, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}).select(*columns)
