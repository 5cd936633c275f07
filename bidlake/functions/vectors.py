"""Vector similarity as generated JVM arithmetic, and vector aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("IP", "L2", "COSINE")

# Scores are rounded here before ranking, so exact copies tie on every execution path and the
# id decides, whatever order a path sums in.
SCORE_DIGITS = 9
_SCALE = float(10**SCORE_DIGITS)
# Beyond this width the generated sum outgrows one JVM method and the array form is used; the
# result is the same, as widths are checked.
UNROLL_LIMIT = 128


def ranked_score(score: Column) -> Column:
    return F.rint(score * _SCALE) / _SCALE


def _tree_sum(terms: list[str]) -> str:
    """Balanced SQL sum: depth log(n), so wide vectors do not nest expressions deeply."""
    while len(terms) > 1:
        terms = ["(" + " + ".join(terms[i : i + 4]) + ")" for i in range(0, len(terms), 4)]
    return terms[0]


def _elements(vector: str, n: int) -> list[str]:
    name = "`" + vector.replace("`", "``") + "`"
    return [f"cast(get({name}, {i}) as double)" for i in range(n)]


def _unrolled(template: str, vector: str, query: Sequence[float]) -> Column:
    """One generated sum over the elements; as SQL text it costs a single call to the JVM."""
    pairs = zip(_elements(vector, len(query)), query)
    return F.expr(_tree_sum([template.format(v=v, q=f"({q!r}D)") for v, q in pairs]))


def dot(vector: str, query: Sequence[float]) -> Column:
    """Inner product with a literal query vector."""
    query = [float(q) for q in query]
    if len(query) <= UNROLL_LIMIT:
        return _unrolled("{v} * {q}", vector, query)
    return dot_columns(F.col(vector), F.array(*[F.lit(q) for q in query]))


def dot_columns(a: Column, b: Column) -> Column:
    """Inner product of two vector columns."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: str, dim: int | None = None) -> Column:
    if dim is not None and dim <= UNROLL_LIMIT:
        return F.sqrt(_unrolled("{v} * {v}", vector, [0.0] * dim))
    return F.sqrt(dot_columns(F.col(vector), F.col(vector)))


def similarity(vector: str, query: Sequence[float], metric: str = "IP") -> Column:
    """Score of a vector column against a literal query: higher is better for IP and COSINE,
    lower for L2 (squared distance). A null vector has no score; one of another width, or with a
    null or NaN component, fails the job."""
    query = [float(q) for q in query]
    if metric == "IP":
        score = dot(vector, query)
    elif metric == "L2":
        if len(query) <= UNROLL_LIMIT:
            score = _unrolled("({v} - {q}) * ({v} - {q})", vector, query)
        else:
            literal = F.array(*[F.lit(q) for q in query])
            gaps = F.zip_with(vector, literal, lambda x, y: x.cast("double") - y)
            score = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    elif metric == "COSINE":
        length = math.sqrt(sum(q * q for q in query))
        both = norm(vector, len(query)) * length
        score = F.when(both == 0, 0.0).otherwise(dot(vector, query) / both)
    else:
        raise ValueError(f"metric must be one of {METRICS}")
    return _sound(vector, len(query), ranked_score(score))


def _sound(vector: str, dim: int, score: Column) -> Column:
    """The score of a vector of ``dim`` numbers. A null or NaN component shows in the score, so
    components are not visited again; the score is named once, to keep the generated code small."""
    stored = F.col(vector)
    width = F.concat(F.lit(f"Embedding dim mismatch: expected {dim}, got "), F.size(stored).cast("string"))
    unsound = F.raise_error(F.lit("Embedding holds a null or NaN component")).cast("double")
    return (F.when(stored.isNull(), F.lit(None).cast("double"))
            .when(F.size(stored) != dim, F.raise_error(width).cast("double"))
            .otherwise(F.coalesce(F.nanvl(score, F.lit(None).cast("double")), unsound)))


def best_first(score: str | Column, metric: str = "IP") -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return score.asc_nulls_last() if metric == "L2" else score.desc_nulls_last()


def mean_vector(vector: str, dim: int) -> Column:
    """Element-wise mean as ``dim`` partial aggregates: one row per group and task is shuffled,
    whatever the number of vectors."""
    return F.expr("array(" + ", ".join(f"avg({e})" for e in _elements(vector, dim)) + ")")


def checked_dim(vector: str | Column, dim: int) -> Column:
    """The vector itself; the job fails on a vector of another width."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    message = F.concat(F.lit(f"Embedding dim mismatch: expected {dim}, got "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(message).cast(T.ArrayType(T.FloatType())))


def length_embedding(text: str | Column, dim: int) -> Column:
    """Deterministic stand-in model: element i is ``len(text) / 1000 + i / dim``."""
    base = F.char_length(text).cast("double") / 1000.0
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: base + i.cast("double") / float(dim))
