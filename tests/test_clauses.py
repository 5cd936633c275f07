"""Clause alignment against brute force and on worked examples."""

import random

import pytest

from bidlake.operators import clauses


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def longest_rising(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


@pytest.mark.parametrize("bits", [clauses.TABLE_BITS, 20, 1])
def test_common_subsequence_is_longest(bits):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = clauses.common_subsequence(a, b, bits)
        assert len(pairs) == longest_common(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_rising_run_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        values = rng.sample(range(30), rng.randint(0, 15))
        run = clauses.rising_run(values)
        assert len(run) == longest_rising(values) and run == sorted(run)
        assert [values[i] for i in run] == sorted(values[i] for i in run)


def test_everything_is_said_once():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 12))] for _ in range(2))
        kept, found = clauses.kept_pairs(a, b), clauses.changes(a, b)
        assert all(a[i] == b[j] for i, j in kept)
        assert all(p < q and r < s for (p, r), (q, s) in zip(kept, kept[1:]))
        assert sorted([i for i, _ in kept] + [i for _, i, _ in found if i is not None]) == list(range(len(a)))
        assert sorted([j for _, j in kept] + [j for _, _, j in found if j is not None]) == list(range(len(b)))
        for change, i, j in found:
            assert {"moved": i is not None and j is not None, "edited": i is not None and j is not None,
                    "removed": j is None, "added": i is None}[change]
            assert (change == "moved") == (i is not None and j is not None and a[i] == b[j])


def test_a_long_text_with_few_changes_is_quick():
    a = list(range(200_000))
    b = a[:1000] + a[5000:] + a[1000:1003]
    found = clauses.changes(a, b)
    assert sum(c == "moved" for c, *_ in found) == 3 and sum(c == "removed" for c, *_ in found) == 3997


OLD = ["Preamble", "Pay in 30 days", "Deliver in May", "Penalty 1%", "Law: Italy", "Signatures"]
NEW = ["Preamble", "Law: Italy", "Pay in 60 days", "Deliver in May", "Penalty 1%", "Insurance", "Signatures"]


def table(spark, versions, extra=""):
    rows = [(k, i, c, extra) for k, v in versions.items() for i, c in enumerate(v)]
    return spark.createDataFrame(rows, "tender string, pos int, clause string, hash string")


def test_moved_edited_added_and_removed(spark):
    old = table(spark, {"a": OLD, "b": ["x", "y"], "only old": ["p"], "same": ["q"] * 5, None: ["n"]})
    new = table(spark, {"a": NEW, "b": ["y", "z", None], "only new": ["r"], "same": ["q"] * 5})
    got = {tuple(r) for r in clauses.clause_changes(old, new, "tender").collect()}
    assert got == {
        ("a", "moved", 4, 1, "Law: Italy", "Law: Italy"), ("a", "edited", 1, 2, "Pay in 30 days", "Pay in 60 days"),
        ("a", "added", None, 5, None, "Insurance"), ("b", "removed", 0, None, "x", None), ("b", "added", None, 1, None, "z"),
        ("b", "added", None, 2, None, None), ("only old", "removed", 0, None, "p", None), ("only new", "added", None, 0, None, "r")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "tender string, pos int, clause string, hash string")
    assert clauses.clause_changes(none, none, "tender").count() == 0
    assert clauses.clause_changes(none, table(spark, {"a": OLD}), "tender").filter("change = 'added'").count() == len(OLD)


def test_split_keeps_empty_clauses(spark):
    rows = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "id int, text string")
    assert sorted(tuple(r) for r in clauses.split_clauses(rows, "id", "text").collect()) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (3, 0, "")]
