"""Conversation repair: the cheapest edits that give a conversation a legal order of roles.

Roles are legal if their initials read ``(s?(ua)+)?``. Rows are kept (K, 0), given the role user or
assistant (R, 1) or deleted (D, 2; blank rows and repetitions must be), and empty rows of a user or
assistant are inserted (I, 5). A truncated row that stays costs 5 more. Of the cheapest edit scripts
the one whose letters are least in ASCII order is taken.

The automaton of that pattern has four states: nothing yet, after s, after u, after a. A row is a 4 x 4
matrix of costs between the states before and after it, with the rank of its least script beside each
cost; inserts belong to the row they precede, so scripts over the same rows never begin one another and
ranks decide between them. Hirschberg's method finds the states between the rows: a forward vector
from the first state and a backward vector from the last one meet in the middle, the state where the
summed cost, then the left rank, then the right rank is least is the crossing, and both halves are
solved alike. Only two vectors are held at a time.

On Spark, rows are sorted over the cluster by conversation and turn, so that a long conversation spans
many tasks. Each task multiplies the matrices of at most ``CHUNK`` rows; the same method over these
products gives the states at the borders of the chunks, and every chunk is then solved by itself. Last,
the rows of a conversation pass in order through one task, because a hash of its text has to be
taken in order; that task holds its edit letters, which the result carries anyway, and no texts.

Defined cases: rows are taken by turn (nulls first), those of one turn by role and text; a null
conversation is one conversation; null texts and roles are one blank; conversations without rows have no
edits; an empty table gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import shuffle_partitions, stage
from bidlake.llm.lines import frequent_keys

# Costs of the edits, and what a truncated row that stays adds.
EDIT_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
CHUNK = 1024
REMEMBERED = 50_000
_START, _S, _U, _A = range(4)
_STATES = range(4)
_OUTPUT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}}
# The letters of a row: its role's initial (o: any other), in upper case if truncated; b blank, d duplicate.
_PRINTING = "[^\\x20\\x09-\\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()
_PAIRS = 16


def _spoken(state: int) -> str:
    """The initial that an inserted or re-roled row takes in ``state``."""
    return "a" if state == _U else "u"


@functools.cache
def _row_scripts(letter: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after): (cost, least cheapest script) of one row and the inserts before it."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    late = TRUNCATED_COST if letter.isupper() else 0
    for before in _STATES:
        state, inserts, seen = before, 0, set()
        while state not in seen:
            seen.add(state)
            options = [(state, EDIT_COST["D"], "D")]
            if letter not in "bd":
                options.append((_OUTPUT[_spoken(state)][state], EDIT_COST["R"] + late, "R"))
                kept = _OUTPUT.get(letter.lower(), {}).get(state)
                if kept is not None:
                    options.append((kept, EDIT_COST["K"] + late, "K"))
            for after, cost, edit in options:
                script = (cost + inserts * EDIT_COST["I"], "I" * inserts + edit)
                found[before, after] = min(found.get((before, after), script), script)
            state, inserts = _OUTPUT[_spoken(state)][state], inserts + 1
    return found


def end_of(state: int) -> str:
    """The inserts that end a conversation in ``state``."""
    return {_START: "", _S: "II", _U: "I", _A: ""}[state]


# A matrix is a dict (state before, state after) -> (cost, rank of the least script).
Matrix = dict[tuple[int, int], tuple[int, int]]


def _ranked(found: dict) -> Matrix:
    """Costs with comparable keys as costs with dense ranks."""
    order = {key: i for i, key in enumerate(sorted({key for _, key in found.values()}))}
    return {place: (cost, order[key]) for place, (cost, key) in found.items()}


@functools.cache
def row_matrix(letter: str) -> Matrix:
    return _ranked(_row_scripts(letter))


def product(left: Matrix, right: Matrix) -> Matrix:
    """The matrix of the rows of ``left`` followed by those of ``right``."""
    found: dict = {}
    for (a, b), (cost, rank) in left.items():
        for c in _STATES:
            step = right.get((b, c))
            if step is not None:
                script = (cost + step[0], (rank, step[1]))
                if (a, c) not in found or script < found[a, c]:
                    found[a, c] = script
    return _ranked(found)


def _forward(matrices: list[Matrix], first: int, last: int, state: int) -> Matrix:
    """Costs from ``state`` before matrix ``first`` to all states before matrix ``last``."""
    vector: Matrix = {(state, state): (0, 0)}
    for i in range(first, last):
        vector = product(vector, matrices[i])
    return vector


def _backward(matrices: list[Matrix], first: int, last: int, state: int) -> Matrix:
    """Costs from all states before matrix ``first`` to ``state`` before matrix ``last``."""
    vector: Matrix = {(state, state): (0, 0)}
    for i in range(last - 1, first - 1, -1):
        vector = product(matrices[i], vector)
    return vector


def crossings(matrices: list[Matrix], start: int, end: int) -> list[int]:
    """The states before, between and after ``matrices`` on the least cheapest script, by Hirschberg's method."""
    states = [start] * len(matrices) + [end]
    open_ = [(0, len(matrices))]
    while open_:
        first, last = open_.pop()
        if last - first < 2:
            continue
        middle = (first + last) // 2
        ahead = _forward(matrices, first, middle, states[first])
        behind = _backward(matrices, middle, last, states[last])
        meet = [(ahead[states[first], c][0] + behind[c, states[last]][0], ahead[states[first], c][1], behind[c, states[last]][1], c)
                for c in _STATES if (states[first], c) in ahead and (c, states[last]) in behind]
        states[middle] = min(meet)[3]
        open_ += [(first, middle), (middle, last)]
    return states


@functools.lru_cache(REMEMBERED)
def chunk_matrix(letters: str) -> Matrix:
    return functools.reduce(product, map(row_matrix, letters))


@functools.lru_cache(REMEMBERED)
def chunk_script(letters: str, start: int, end: int) -> str:
    """The least cheapest script over the rows ``letters`` between two states."""
    states = crossings([row_matrix(x) for x in letters], start, end)
    return "".join(_row_scripts(x)[states[i], states[i + 1]][1] for i, x in enumerate(letters))


def last_state(whole: Matrix) -> int:
    """The state in which the least cheapest script of a conversation ends before its closing inserts."""
    ends = [(cost + EDIT_COST["I"] * len(end_of(c)), rank, c) for (a, c), (cost, rank) in whole.items() if a == _START]
    return min(ends)[2]


def repair_script(letters: str) -> str:
    """The least cheapest script of a whole conversation."""
    if not letters:
        return ""
    end = last_state(_forward([row_matrix(x) for x in letters], 0, len(letters), _START))
    return chunk_script(letters, _START, end) + end_of(end)


def _pack(matrix: Matrix) -> list[int]:
    flat = [-1] * (2 * _PAIRS)
    for (a, b), (cost, rank) in matrix.items():
        flat[4 * a + b], flat[_PAIRS + 4 * a + b] = cost, rank
    return flat


def _unpack(flat: list[int]) -> Matrix:
    return {(i // 4, i % 4): (flat[i], flat[_PAIRS + i]) for i in range(_PAIRS) if flat[i] >= 0}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text): ``rows`` with the faults that the hash of conversation and turn deals them."""
    blank = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), blank)
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    dealt = rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("fault"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return dealt.withColumn("times", F.explode(F.array_repeat(F.lit(0), times))).drop("fault", "times")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``pos``, which rises with conversation, turn, role and text."""
    content = F.substring(F.concat("role", F.lit("\x00"), "text"), 1, 80)  # as long as range borders need to be
    spread = rows.withColumn("content", content).repartitionByRange(shuffle_partitions(rows.sparkSession), "conv", "turn", "content").drop("content")
    ordered = spread.sortWithinPartitions("conv", "turn", "role", "text")
    return stage(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _letter() -> Column:
    """The letter of a row but for repetitions."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    return F.when(~F.col("text").rlike(_PRINTING), "b").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial))


def lettered(turns: DataFrame) -> DataFrame:
    """(conv, pos, letter) of every row, repetitions of role and text in a conversation marked ``d``.

    A role and text that fills much of a conversation is not gathered: its first place is aggregated in
    every task and sent to its rows (see ``lines.frequent_keys``).
    """
    content = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    rows = turns.select("conv", "pos", _letter().alias("letter"), F.struct("conv", content.alias("content")).alias("key"))
    rows = stage(rows, "letters")
    hot = frequent_keys(rows)
    is_hot = F.xxhash64("key").isin(hot) if hot else F.lit(False)
    cold = rows.filter(~is_hot).withColumn("first", F.min("pos").over(Window.partitionBy("key")))
    if hot:
        firsts = rows.filter(is_hot).groupBy("key").agg(F.min("pos").alias("first")).withColumn("hash", F.xxhash64("key"))
        firsts = F.broadcast(firsts.select("hash", F.col("key").alias("same"), "first"))
        met = rows.filter(is_hot).join(firsts, (F.xxhash64("key") == F.col("hash")) & F.col("key").eqNullSafe(F.col("same")))
        cold = cold.unionByName(met.select(*cold.columns))
    again = (F.col("pos") > F.col("first")) & (F.col("letter") != "b")
    return cold.select("conv", "pos", F.when(again, "d").otherwise(F.col("letter")).alias("letter"))


def _groups(conv: pa.Array) -> tuple[np.ndarray, list]:
    """Starts of the runs of equal values in ``conv`` (nulls are equal), and their values."""
    null = conv.is_null().to_numpy(zero_copy_only=False)
    value = conv.fill_null(0).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))
    return starts, [None if null[i] else int(value[i]) for i in starts]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order as (conv, pos of the first, letters, matrix) of at most ``CHUNK`` rows."""
    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string()),
             pa.array([_pack(chunk_matrix(d[2])) for d in done], pa.list_(pa.int64()))], ["conv", "pos", "letters", "matrix"])

    open_: list = []  # one chunk: conversation, first place, letters
    for batch in batches:
        if not batch.num_rows:
            continue
        done: list = []
        starts, convs = _groups(batch.column("conv"))
        letters = "".join(batch.column("letter").to_pylist())
        places = batch.column("pos").to_numpy()
        for conv, i, j in zip(convs, starts, [*starts[1:], len(letters)], strict=True):
            while i < j:
                if open_ and open_[0] == conv and len(open_[2]) < CHUNK:
                    taken = min(j, i + CHUNK - len(open_[2]))
                    open_ = [conv, open_[1], open_[2] + letters[i:taken]]
                else:
                    if open_:
                        done.append(open_)
                    taken = min(j, i + CHUNK)
                    open_ = [conv, int(places[i]), letters[i:taken]]
                i = taken
        if done:
            yield rows(done)
    if open_:
        yield rows([open_])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, start, end, last) of every chunk from the matrices of each conversation, in order."""
    def solved(places: list[int], flats: list) -> pa.RecordBatch:
        matrices = [_unpack(f) for f in flats]
        states = crossings(matrices, _START, last_state(_forward(matrices, 0, len(matrices), _START)))
        n = len(places)
        return pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()),
             pa.array([i == n - 1 for i in range(n)])], ["pos", "start", "end", "last"])

    conv: object = _chunks  # stands for no conversation
    places, flats = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, convs = _groups(batch.column("conv"))
        where, what = batch.column("pos").to_pylist(), batch.column("matrix").to_pylist()
        out = []
        for key, i, j in zip(convs, starts, [*starts[1:], len(where)], strict=True):
            if key != conv:
                if places:
                    out.append(solved(places, flats))
                conv, places, flats = key, [], []
            places += where[i:j]
            flats += what[i:j]
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if places:
        yield solved(places, flats)


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edit script of every chunk between its two states."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("letters", "start", "end", "last")]
        script = [chunk_script(x, a, b) + (end_of(b) if last else "") for x, a, b, last in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "pos", "letters")), pa.array(script, pa.string())],
                                         ["conv", "pos", "letters", "script"])


def edit_scripts(turns: DataFrame) -> DataFrame:
    """(conv, pos, letters, script): the edits of every chunk of rows of ``in_order``."""
    parts = shuffle_partitions(turns.sparkSession)
    ordered = lettered(turns).repartitionByRange(parts, "pos").sortWithinPartitions("pos")
    chunks = stage(ordered.mapInArrow(_chunks, "conv long, pos long, letters string, matrix array<long>"), "chunks")
    borders = chunks.select("conv", "pos", "matrix").repartition(parts, "conv").sortWithinPartitions("conv", "pos")
    borders = borders.mapInArrow(_borders, "pos long, start int, end int, last boolean")
    return chunks.drop("matrix").join(borders, "pos").mapInArrow(_scripts, "conv long, pos long, letters string, script string")


class _Conversation:
    """What has passed of one conversation: counts, edit letters and the hash of the repaired rows."""

    def __init__(self, conv: int | None):
        self.conv, self.hash, self.first_out = conv, hashlib.sha256(), True
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.initial = None
        self.script: list[str] = []
        self.after_user = False
        self.edits = self.letters = ""
        self.at = self.row = 0

    def take_script(self, letters: str, script: str) -> None:
        self.edits, self.letters, self.at, self.row = script, letters, 0, 0
        self.script.append(script)

    def _say(self, role: str, text: str, initial: str) -> None:
        self.hash.update(f"{'' if self.first_out else chr(10)}{role}:{text}".encode())
        self.first_out = False
        self.after_user = initial == "u"

    def _insert(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.cost += EDIT_COST["I"]
            role = "assistant" if self.after_user else "user"
            self._say(role, "", role[0])
            self.at += 1

    def take(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        letter, initial = self.letters[self.row], role[:1]
        self.row += 1
        self.blank += letter == "b"
        self.duplicate += letter == "d"
        self.truncated += letter.isupper()
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self._insert()
        edit = self.edits[self.at]
        self.at += 1
        self.cost += EDIT_COST[edit] + (TRUNCATED_COST if letter.isupper() and edit != "D" else 0)
        if edit == "K":
            self._say(role, text, initial)
        elif edit == "R":
            role = "assistant" if self.after_user else "user"
            self._say(role, text, role[0])
        if self.row == len(self.letters):
            self._insert()

    def result(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.script), self.hash.hexdigest())


_RESULT = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; scripts come before the rows they are for."""
    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), _RESULT, strict=True)], schema=_RESULT)

    open_ = None
    for batch in batches:
        done = []
        for conv, turn, role, text, letters, script in zip(
                *(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "letters", "script")), strict=True):
            if open_ is None or open_.conv != conv:
                if open_ is not None:
                    done.append(open_.result())
                open_ = _Conversation(conv)
            if script is not None:
                open_.take_script(letters, script)
            else:
                open_.take(turn, role, text)
        if done:
            yield rows(done)
    if open_ is not None:
        yield rows([open_.result()])


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Repair (conv, turn, role, text): per conversation gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    turns = in_order(rows)
    scripts = edit_scripts(turns)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("letters", "script")]
    stream = turns.select("conv", "pos", F.lit(1).alias("kind"), "turn", "role", "text", *nothing).unionByName(
        scripts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "pos", "kind")
    return stream.mapInArrow(_repaired, (
        "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` after damage and repair; those without rows left have zeros."""
    found = repair_conversations(damaged(conversations)).alias("r")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    joined = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("r.conv")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(_EMPTY_HASH)).alias("repaired_sha256"))
