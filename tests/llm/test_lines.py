"""Line dedup against a plain reading of the contract."""

import collections
import random

import pytest

from bidlake.llm import lines

DOCS = "doc_id long, text string, doc string, t1 string, body long, row string, bits string"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=3):
    holders = collections.defaultdict(set)

    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        kept = []
        split = (text or "").split("\n")
        for line in split:
            held = holders[key(line)]
            known = [d for d in held if d is not None]
            if len(key(line)) < 20 or len(held) < min_docs or doc == (max(known) if known else None):
                kept.append(line)
        out.append((doc, len(split), len(split) - len(kept), "\n".join(kept)))
    return out


def _rows():
    rng = random.Random(4)
    stock = ["A line of License text, kept once.", "  a LINE of license text, kept once.\r", "short", "", "ÜBER zwanzig Zeichen lang Ä", "über zwanzig Zeichen lang Ä",
             "exactly nineteen ch", "exactly twenty chars", "\x0btabs\tinside stay where they are\x0c", " other blanks are letters here "]
    rows = []
    for doc in range(60):
        picked = rng.choices(stock, k=rng.randint(0, 6)) + [f"the own line number {rng.randint(0, 40)} of some"] * rng.randint(0, 2)
        rng.shuffle(picked)
        rows.append((doc if doc % 11 else None, "\n".join(picked)))
    rows += [(5, rows[5][1]), (5, "another text\n" + stock[0]), (7, None), (8, ""), (9, "\n\n"), (70, "\n".join(["only here, but five times over"] * 5))]
    # one long text: dropped lines in its first and last words of bits, none between
    rows += [(-1, stock[0] + "\n" + "\n".join(f"long text line {i:08d} unlike any" for i in range(5000)) + "\n" + stock[7])]
    return rows + rng.sample(rows, 10)


@pytest.mark.parametrize(("frequent", "min_docs"), [(lines.FREQUENT, 3), (2, 3), (40, 3), (40, 5)])
def test_dedup_equals_a_plain_reading(spark, frequent, min_docs):
    rows = _rows()
    table = spark.createDataFrame([(d, t, "x", "y", 1, "z", "w") for d, t in rows], DOCS).repartition(5)
    found = lines.dedup_lines(table, min_docs=min_docs, frequent=frequent).collect()
    assert all(r["row"][2:] == ("x", "y", 1, "z", "w") for r in found)
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found]
    assert sorted(got, key=str) == sorted(plain(rows, min_docs), key=str)


def test_frequent_keys_are_those_of_many_lines(spark):
    table = spark.range(1000).selectExpr("cast(case when id % 3 = 0 then 0 else id end as string) as key")
    hot = lines.frequent_keys(table, 100, 512)
    assert hot == [r[0] for r in spark.sql("select xxhash64('0')").collect()]


def test_bitmaps_leave_out_words_that_stay(spark):
    rows = _rows()
    table = spark.createDataFrame([(d, t, "", "", 0, "", "") for d, t in rows], DOCS)
    long = lines.keep_bitmaps(table).filter("doc = -1").first()
    assert long["n_dropped"] == 2 and [w["word"] for w in long["words"]] == [0, 5001 // 64]


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
