"""Vector and keyword search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.functions.vectors import length_embedding
from bidlake.operators import vector_search
from bidlake.operators.evaluation import embedding_quality, mean_metrics, retrieval_metrics
from bidlake.operators.keyword import bm25_search, keyword_search, keyword_search_many
from bidlake.operators.vector_search import vector_topk, vector_topk_many


@pytest.fixture(scope="module")
def vectors(spark):
    """300 vectors of which a third are copies of one."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 16)).astype(np.float32)
    data[100:200] = data[100]
    rows = [(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(4).cache(), data.astype(float)


def brute(data, query, k, metric):
    if metric == "IP":
        score = data @ query
    elif metric == "L2":
        score = ((data - query) ** 2).sum(axis=1)
    else:
        score = data @ query / (np.linalg.norm(data, axis=1) * np.linalg.norm(query))
    score = np.rint(score * 1e9) / 1e9
    order = sorted(range(len(data)), key=lambda i: (score[i] if metric == "L2" else -score[i], i))
    return [f"v{i:03d}" for i in order[:k]]


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_every_path_agrees_with_brute_force(spark, vectors, metric):
    df, data = vectors
    picked = {i: data[i] for i in (0, 100, 250)}
    queries = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in picked.items()], "qid int, query_vector array<double>")
    shared = vector_topk_many(queries, df, 7, metric).collect()
    blocks = vector_topk_many(queries, df, 7, metric, query_bytes_limit=1, block_rows=2).collect() if metric == "IP" \
        else vector_topk_many(queries, df, 7, metric, query_bytes_limit=1, block_rows=100).collect()
    for i, query in picked.items():
        want = brute(data, query, 7, metric)
        assert [r.id for r in vector_topk(df, query, 7, metric).collect()] == want
        for got in (shared, blocks):
            assert [r.id for r in sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])] == want


def test_small_batches_keep_the_running_best(spark, vectors, monkeypatch):
    df, data = vectors
    monkeypatch.setattr(vector_search, "SCORES_AT_ONCE", 3)
    best = vector_search._Best(data[[3, 150]], 4, "IP")
    import pyarrow as pa
    for start in range(0, 300, 3):
        best.add(pa.array([f"v{i:03d}" for i in range(start, start + 3)]), data[start:start + 3])
    out = best.batch([3, 150], (pa.int64(), pa.string())).to_pandas()
    for q in (3, 150):
        assert list(out[out.qid == q].id) == brute(data, data[q], 4, "IP")


def test_wide_vectors_and_empty_sides(spark, vectors):
    wide = spark.createDataFrame([("a", [1.0] * 200), ("b", [0.5] * 200)], "id string, embedding array<float>")
    got = vector_topk(wide, [1.0] * 200, 1).collect()
    assert (got[0].id, got[0].score) == ("a", 200.0)
    assert vector_topk(wide, [1.0] * 200, 2, "L2").collect()[1].score == 50.0
    queries = spark.createDataFrame([], "qid int, query_vector array<double>")
    assert vector_topk_many(queries, wide, 3).count() == 0
    assert vector_topk_many(spark.createDataFrame([(1, [1.0] * 200)], queries.schema), wide.filter("false"), 3).count() == 0


def test_dimension_and_metric_errors(spark, vectors):
    with pytest.raises(ValueError, match="dim mismatch"):
        vector_topk(vectors[0], [1.0, 2.0], dim=16)
    with pytest.raises(ValueError):
        vector_topk(vectors[0], [1.0] * 16, metric="HAMMING")


KEYWORD_ROWS = [(1, "Alpha beta"), (2, "alpha  beta"), (3, "100% sure"), (4, "snake_case x"), (5, "a\\b beta"), (6, None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(KEYWORD_ROWS, "id int, text string")


@pytest.mark.parametrize("terms, ids", [
    ("alpha beta", [2]), ("Alpha", [1]), ("a_pha", [2]), ("1%sure", [3]), ("e_case", [4]), ("a\\b", [5]),
    (" \t beta \n ", [1, 2, 5]), ("zzz", []),
])
def test_keyword_terms(spark, texts, terms, ids):
    assert [r.id for r in keyword_search(texts, terms, 10).collect()] == ids
    many = keyword_search_many(spark.createDataFrame([(9, terms)], "qid int, terms string"), texts, 10)
    assert [r.id for r in many.orderBy("rank").collect()] == ids


def test_empty_query_matches_all_and_score_is_null(texts):
    rows = keyword_search(texts, "  ", 3).collect()
    assert [r.id for r in rows] == [1, 2, 3] and all(r.score is None for r in rows)


def test_keyword_blocks_equal_one_literal(spark, texts):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["beta", "a", "1%e", "", "snake x", "Alpha beta", "q\"uote", "a\\b"])], "qid int, terms string")
    one = keyword_search_many(queries, texts, 2).collect()
    blocks = keyword_search_many(queries, texts, 2, block_size=3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, blocks)) and len(one) > 6


def test_containment_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(KEYWORD_ROWS, "id int, text string").write.parquet(str(tmp_path / "t"))
    plan = keyword_search(spark.read.parquet(str(tmp_path / "t")), "alpha beta", 5)._jdf.queryExecution().toString()
    assert "StringContains(text,alpha)" in plan and "StringContains(text,beta)" in plan


def test_bm25_prefers_rare_terms_and_drops_misses(spark):
    docs = spark.createDataFrame(
        [(1, "the the cat"), (2, "the dog"), (3, "a bird"), (4, "the fish swims far away")], "id int, text string")
    got = [r.id for r in bm25_search(docs, "the CAT", 10).collect()]
    assert got[0] == 1 and set(got) == {1, 2, 4}


def test_metrics_guard_missing_relevance(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "qid int, rank int, relevant boolean")
    wanted = spark.createDataFrame([(1, 1), (2, 0), (3, 2)], "qid int, n_relevant int")
    rows = {r.qid: r for r in retrieval_metrics(hits, wanted, 2).collect()}
    assert rows[1].mrr == 0.5 and rows[1].recall_at_k == 1.0 and rows[1].precision_at_k == 0.5
    assert rows[2].recall_at_k == 0.0 and rows[3].mrr == 0.0 and rows[3].ndcg_at_k == 0.0
    assert mean_metrics(retrieval_metrics(hits, wanted, 2)).first().n_queries == 3


def test_embedding_quality_counts_bad_vectors(spark, vectors):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", None)]
    row = embedding_quality(spark.createDataFrame(rows, "id string, embedding array<float>"), 2).first()
    assert (row.total, row.valid_count) == (6, 3)
    assert row.avg_similarity == pytest.approx((0 + 2**0.5 / 2 * 2) / 3)


def test_length_embedding(spark):
    v = spark.sql("select 'abcd' as t").select(length_embedding("t", 4).alias("v")).first().v
    assert v == pytest.approx([0.004, 0.254, 0.504, 0.754])


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    """What Spark ships to a worker must load where this package cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "task.bin").write_bytes(cloudpickle.dumps(vector_search._Best))
    code = ("import sys, importlib.util as u; sys.path = [p for p in sys.path if 'repo' not in p and p]; "
            "from pyspark import cloudpickle; assert u.find_spec('bidlake') is None; "
            "assert cloudpickle.loads(open('task.bin', 'rb').read()).__name__ == '_Best'")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def _rows(spark, *vectors):
    return spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(vectors)], "id string, embedding array<float>")


def _search(spark, path, rows, query, metric):
    if path == "one":
        return vector_topk(rows, query, 3, metric).collect()
    questions = spark.createDataFrame([(1, query), (2, query), (3, None)], "qid int, query_vector array<float>")
    limit = {"query_bytes_limit": 1, "block_rows": 1} if path == "blocks" else {}
    return vector_topk_many(questions, rows, 3, metric, **limit).filter("qid = 1").orderBy("rank").collect()


@pytest.mark.parametrize("path", ["one", "many", "blocks"])
@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_unsound_vectors_fail_on_every_path(spark, path, metric):
    for bad in ([1.0], [1.0, 2.0, 3.0], [float("nan"), 1.0], [None, 1.0]):
        with pytest.raises(Exception, match="Embedding"):
            _search(spark, path, _rows(spark, [1.0, 2.0], bad, None), [1.0, 1.0], metric)


@pytest.mark.parametrize("path", ["one", "many", "blocks"])
def test_rows_without_vector_take_no_part(spark, path):
    got = _search(spark, path, _rows(spark, [1.0, 2.0], None, [3.0, 0.0]), [1.0, 1.0], "IP")
    assert [(r.id, r.score) for r in got] == [("v0", 3.0), ("v2", 3.0)]


@pytest.mark.parametrize("width", [127, 128, 129])
def test_widths_around_the_generated_sum_behave_alike(spark, width):
    rows = _rows(spark, [1.0] * width, [2.0] * width)
    for metric in ("IP", "L2"):
        one, many = (_search(spark, path, rows, [1.0] * width, metric) for path in ("one", "many"))
        assert [(r.id, r.score) for r in one] == [(r.id, r.score) for r in many]
    with pytest.raises(Exception, match="dim mismatch"):
        _search(spark, "one", _rows(spark, [1.0] * (width + 1)), [1.0] * width, "IP")
