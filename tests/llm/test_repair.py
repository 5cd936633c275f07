"""Conversation repair against every script of small conversations and a plain reading of the contract."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from bidlake.llm import repair

ROWS = "conv_id long, turn int, role string, text string, pos long, script string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_script(letters):
    """The least cheapest script by search over all scripts in order of cost, then letters."""
    best = {}
    heap = [(0, "", 0, "")]
    while heap:
        cost, script, at, tail = heapq.heappop(heap)
        if at == len(letters) and LEGAL.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[tail]):
            return script
        key = (at, tail)
        if key in best:
            continue
        best[key] = script
        turn = "a" if tail == "u" else "u"
        heapq.heappush(heap, (cost + 5, script + "I", at, turn))
        if at < len(letters):
            letter = letters[at]
            late = 5 * letter.isupper()
            heapq.heappush(heap, (cost + 2, script + "D", at + 1, tail))
            if letter not in "bd":
                heapq.heappush(heap, (cost + 1 + late, script + "R", at + 1, turn))
                initial = letter.lower()
                if initial == turn or (initial == "s" and tail == ""):
                    heapq.heappush(heap, (cost + late, script + "K", at + 1, initial))
    raise AssertionError


def test_scripts_are_the_least_cheapest_ones():
    for n in range(5):
        for letters in itertools.product("suaoSUAOb", repeat=n):
            word = "".join(letters)
            assert repair.repair_script(word) == plain_script(word), word
    rng = random.Random(1)
    for _ in range(400):
        word = "".join(rng.choices("suaoSUAObd", weights=[1, 4, 4, 1, 1, 2, 2, 1, 2, 2], k=rng.randint(5, 60)))
        assert repair.repair_script(word) == plain_script(word), word


def test_products_of_chunks_keep_the_script():
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choices("suaoSUAObd", k=rng.randint(1, 40)))
        chunks = [word[i:i + 7] for i in range(0, len(word), 7)]
        matrices = [repair.chunk_matrix(c) for c in chunks]
        end = repair.last_state(repair._forward(matrices, 0, len(matrices), 0))
        states = repair.crossings(matrices, 0, end)
        joined = "".join(repair.chunk_script(c, states[i], states[i + 1]) for i, c in enumerate(chunks)) + repair.end_of(end)
        assert joined == plain_script(word)


def plain_repair(rows):
    """The contract, read row by row."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, letters = set(), ""
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "b" if not body else "d" if (role, text) in seen else initial if body[-1] in ".!?" else initial.upper()
            seen.add((role, text))
        script = plain_script(letters)
        lines, rest, cost = [], list(zip(kept, letters, strict=True)), 0
        for edit in script:
            turn = "assistant" if lines and lines[-1][0] == "u" else "user"
            cost += {"K": 0, "R": 1, "D": 2, "I": 5}[edit]
            if edit == "I":
                lines.append(f"{turn}:")
                continue
            (_, role, text), letter = rest.pop(0)
            cost += 5 * (letter.isupper() and edit != "D")
            if edit != "D":
                lines.append(f"{role if edit == 'K' else turn}:{text}")
        turns = [t for t, *_ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, letters.count("b"), letters.count("d"),
                    sum(x.isupper() for x in letters), sum(p not in ("su", "ua", "au") for p in pairs), cost, script,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def _conversations():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "why", "Why?", "", " \t", "long text " * 5000 + ".", "Ünï ☃.", "two\nlines.", None, "Yes. "]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn, 3, None, turn * 4]),
                         rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)))
    rows += [(1000, t, "user" if t % 2 else "assistant", "Ok." if t % 3 else f"Say {t}.") for t in range(400)]
    return rows + rng.sample(rows, 30)


@pytest.mark.parametrize("chunk", [repair.CHUNK, 5])
def test_repair_equals_a_plain_reading(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = _conversations()
    table = spark.createDataFrame([(*r, 0, "clash") for r in rows], ROWS).repartition(3)
    got = [tuple(r) for r in repair.damage_and_repair(table).collect()]
    assert sorted(got, key=str) == sorted(plain_repair(rows), key=str)


def test_frequent_contents_change_nothing(spark, monkeypatch):
    rows = _conversations()
    table = spark.createDataFrame([(*r, 0, "clash") for r in rows], ROWS)
    want = sorted(plain_repair(rows), key=str)
    monkeypatch.setattr(repair, "frequent_keys", lambda lines: [
        r[0] for r in lines.selectExpr("xxhash64(key)").distinct().collect()][::2])
    assert sorted((tuple(r) for r in repair.damage_and_repair(table).collect()), key=str) == want


def test_conversations_without_rows(spark):
    dropped = [c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:1]
    table = spark.createDataFrame([(c, 0, "user", "Hi.", 0, "") for c in dropped], ROWS)
    assert [tuple(r) for r in repair.damage_and_repair(table).collect()] == [
        (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped]
    assert repair.damage_and_repair(spark.createDataFrame([], ROWS)).count() == 0
