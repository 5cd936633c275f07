"""Boolean keyword syntax and the automaton over many queries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bidlake.functions import keywords as K
from bidlake.operators.keyword import keyword_search_many

TEXTS = [None, "", "alpha", "alpha beta", "beta gamma delta", "ISO 27001 and GDPR", "ISO 9001 only", "CIG: 12345678AB here",
         "ANAC compliance optional", "a(b)c", "100% sure_thing", "back\\slash", "日本 ISO", "AND is a word", "Alpha"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


@pytest.mark.parametrize(("query", "steps"), [
    ("", ""), (None, ""), ("  ", ""), ("a", "a"), ("a b", "a b &"), ("a AND b", "a b &"), ("a OR b c", "a b c & |"), ("a b OR c", "a b & c |"),
    ("NOT a b", "a ! b &"), ("NOT NOT a", "a ! !"), ("-a b", "a ! b &"), ("a -b", "a b ! &"), ("(a OR b) c", "a b | c &"),
    ("a OR NOT (b c)", "a b c & ! |"), ('"a b" c', "a_b c &"), ('f:"x y"', "f x_y &"), ("a and b", "a and & b &"), ("a-b", "a-b"),
    ("- a", "- a &"), ("((a))", "a"), ("a OR b OR c", "a b | c |"), ("-(a OR b)", "a b | !"), ("x AND -y", "x y ! &"), ('"(a)" OR b', "(a) b |")])
def test_precedence(query, steps):
    sign = {K.AND: "&", K.OR: "|", K.NOT: "!"}
    assert " ".join(s.term.replace(" ", "_") if s.op == K.TERM else sign[s.op] for s in K.parse(query)) == steps


@pytest.mark.parametrize(("query", "position"), [
    ("AND a", 0), ("a OR", 2), ("a AND OR b", 6), ("(a", 0), ("a)", 1), ("()", 1), ('"a', 0), ('a ""', 2), ("NOT", 0), ("a (", 2),
    ("a OR )", 5), ("-", None), ("a NOT", 2), ("(a OR b))", 8)])
def test_malformed_queries_name_the_place(query, position):
    if position is None:  # a lone hyphen is a word
        assert K.parse(query) == [K.Step(K.TERM, "-")]
        return
    with pytest.raises(K.KeywordSyntaxError) as error:
        K.parse(query)
    assert error.value.position == position


def plain(query, text):
    """The query by Python's own operators."""
    text = text or ""
    stack = []
    for step in K.parse(query):
        if step.op == K.TERM:
            stack.append(step.term in text)
        elif step.op == K.NOT:
            stack.append(not stack.pop())
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if step.op == K.AND else a or b)
    return stack[0] if stack else True


QUERIES = ["", "alpha", "ISO AND (27001 OR 9001)", "ISO -GDPR", "NOT alpha", 'CIG:"12345678AB"', '"beta gamma" OR "a(b)c"', "100% OR sure_thing",
           "back\\slash", "日本", "-ISO -alpha -beta", "ANAC compliance -optional", "NOT (a OR e)", "nowhere OR \"AND is\""]


def test_condition_fold_and_automaton_agree(spark, texts):
    want = {(q, i) for q, query in enumerate(QUERIES) for i, text in enumerate(TEXTS) if plain(query, text)}
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, terms string")
    many = {(r.qid, r.id) for r in keyword_search_many(asked, texts, 100, syntax=True).collect()}
    assert many == want
    blocks = {(r.qid, r.id) for r in keyword_search_many(asked, texts, 100, syntax=True, block_size=3).collect()}
    assert blocks == want
    for q, query in enumerate(QUERIES):
        here = {i for i, text in enumerate(TEXTS) if plain(query, text)}
        # a filter drops rows whose containment is unknown, which only matters for the null text
        assert {r.id for r in texts.filter(K.condition("text", query)).collect()} - {0} == here - {0}
        assert {r.id for r in texts.filter(K.holds("text", K.postfix(query))).collect()} == here


def test_random_queries(spark):
    rng = random.Random(11)
    words = ["ab", "b", "abc", "ca", "c a", "bb"]

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return f'"{rng.choice(words)}"'
        if kind < 0.45:
            return f"NOT ({made(depth - 1)})"
        return f"({made(depth - 1)} {rng.choice(['AND', 'OR', ''])} {made(depth - 1)})"

    queries = [made(3) for _ in range(60)]
    bodies = ["".join(rng.choices("abc ", k=rng.randint(0, 8))) for _ in range(80)]
    table = spark.createDataFrame(list(enumerate(bodies)), "id int, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, terms string")
    got = {(r.qid, r.id) for r in keyword_search_many(asked, table, 1000, syntax=True).collect()}
    assert got == {(q, i) for q, query in enumerate(queries) for i, body in enumerate(bodies) if plain(query, body)}


def test_wildcards_overlaps_and_nulls_without_syntax(spark, texts):
    asked = ["1%0", "s_re_thing", "%", "_", "alp lpha pha", "", "a%a", "back\\slash", None, "%%ISO", "AND OR"]
    table = spark.createDataFrame(list(enumerate(asked)), "qid int, terms string")
    got = {(r.qid, r.id) for r in keyword_search_many(table, texts, 100, block_size=4).collect()}
    want = set()
    for q, terms in enumerate(asked):
        for i, text in enumerate(TEXTS):
            tests = [re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in t), re.DOTALL) for t in (terms or "").split()]
            if all(text is not None and t.search(text) for t in tests):
                want.add((q, i))
    assert got == want


def test_timestamps_keep_their_digits_as_query_ids(spark, texts):
    asked = spark.sql("select timestamp'2025-01-01 10:00:00.123456' as qid, 'alpha' as terms")
    rows = keyword_search_many(asked, texts, 1).collect()
    assert [r.qid.microsecond for r in rows] == [123456]


def test_a_text_is_read_once_and_never_exploded(spark, tmp_path, texts):
    texts.write.parquet(str(tmp_path / "t"))
    asked = spark.createDataFrame([(i, "alpha beta") for i in range(50)], "qid int, terms string")
    plan = keyword_search_many(asked, spark.read.parquet(str(tmp_path / "t")), 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("FileScan parquet") == 1 and "Generate" not in physical and "Join" not in physical


def test_malformed_query_fails_the_search(spark, texts):
    asked = spark.createDataFrame([(1, "alpha OR")], "qid int, terms string")
    with pytest.raises(K.KeywordSyntaxError):
        keyword_search_many(asked, texts, 3, syntax=True)


def test_no_queries(spark, texts):
    asked = spark.createDataFrame([], "qid int, terms string")
    assert keyword_search_many(asked, texts, 3).count() == 0
    assert keyword_search_many(asked.withColumn("x", F.lit(1)), texts.limit(0), 3).count() == 0
