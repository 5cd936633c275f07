"""Exact top-k search for many questions, each with its own filter document.

Filters are data: a column of JSON documents in the language of ``functions.filters.matches``. A
filter is compiled into a small tree over atoms (field, operator, operand); equal atoms of different
filters are one. A task evaluates every atom once per Arrow batch, which gives each row a bitmap of
atoms, combines the bitmaps by the trees of the distinct filters, and scores a question only on the
rows that its filter leaves. The collection is read once for all questions, and no plan grows with
their number.

Up to ``query_bytes_limit`` the questions travel with the tasks. A larger set and the collection are
cut into blocks of bounded size that meet once per pair of blocks, as in ``vector_search``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.functions.filters import OPERATORS, field_column
from bidlake.functions.vectors import METRICS, best_first
from bidlake.operators.vector_search import BLOCK_BYTES, DEFAULT_K, QUERY_BYTES_LIMIT, _arrow_types, _Best, _to_matrix

# Rows of one step: bitmaps and scores of a step are held at once.
STEP_ROWS = 8192
# Up to so many distinct filters their disjunction also goes to the scan; results are the same without it.
PUSHED_FILTERS = 16


def parse_filter(document: str | None) -> tuple:
    """The tree of a JSON filter document: ("atom", field, operator, operand as JSON), ("and", parts) or ("or", parts).

    A null or empty document lets every row through. Anything else that is no filter is an error.
    """
    if document is None or not document.strip():
        return ("and", ())
    try:
        spec = json.loads(document)
    except json.JSONDecodeError as error:
        raise ValueError(f"filter is not JSON at {error.pos}: {document[:80]}") from None
    return _tree(spec)


def _tree(spec: Any) -> tuple:
    if not isinstance(spec, Mapping):
        raise ValueError(f"a filter is an object, not {json.dumps(spec)[:80]}")
    parts: list[tuple] = []
    for name, value in spec.items():
        if name in ("$and", "$or"):
            if not isinstance(value, list) or (name == "$or" and not value):
                raise ValueError(f"{name} needs a list of filters")
            inner = tuple(_tree(v) for v in value)
            parts.append(("and", inner) if name == "$and" else ("or", inner))
        elif name.startswith("$"):
            raise ValueError(f"unknown filter operator {name}")
        else:
            tests = value if isinstance(value, Mapping) else {"$eq": value}
            for operator, operand in tests.items():
                if operator not in OPERATORS:
                    raise ValueError(f"unknown filter operator {operator}")
                if operator == "$in" and not isinstance(operand, list):
                    raise ValueError("$in needs a list")
                parts.append(("atom", name, operator, json.dumps(operand)))
    return ("and", tuple(parts))


def fields_of(tree: tuple) -> set[str]:
    if tree[0] == "atom":
        return {tree[1]}
    return set().union(*(fields_of(p) for p in tree[1])) if tree[1] else set()


def atom_flags(values: pa.Array, operator: str, operand: Any) -> np.ndarray:
    """Which of ``values`` pass one test; a null value or operand passes none."""
    if operator == "$contains":
        hit = np.zeros(len(values), bool)
        flat = pc.equal(pc.list_flatten(values), _as(operand, values.type.value_type))
        parents = pc.list_parent_indices(values).to_numpy()
        hit[parents[pc.fill_null(flat, False).to_numpy(zero_copy_only=False)]] = True
        return hit
    if operator == "$in":
        wanted = [_as(v, values.type) for v in operand if v is not None]
        flags = pc.is_in(values, value_set=pa.array([w.as_py() for w in wanted], values.type)) if wanted else pa.array([False] * len(values))
        return pc.and_(flags, pc.is_valid(values)).to_numpy(zero_copy_only=False)
    if operand is None:
        return np.zeros(len(values), bool)
    if isinstance(operand, float) and pa.types.is_integer(values.type):
        values = values.cast(pa.float64())
    compare = {"$eq": pc.equal, "$ne": pc.not_equal, "$lt": pc.less, "$lte": pc.less_equal,
               "$gt": pc.greater, "$gte": pc.greater_equal}[operator]
    return pc.fill_null(compare(values, _as(operand, values.type)), False).to_numpy(zero_copy_only=False)


def _as(value: Any, kind: pa.DataType) -> pa.Scalar:
    """A JSON value in the type of a column; text stands for dates and times."""
    scalar = pa.scalar(value)
    return scalar if scalar.type == kind else scalar.cast(kind)


class FilterSet:
    """The filters of many questions: their distinct trees over shared atoms."""

    def __init__(self, documents: list[str | None]):
        trees = [parse_filter(d) for d in documents]
        self.trees = list(dict.fromkeys(trees))
        number = {tree: i for i, tree in enumerate(self.trees)}
        group = np.array([number[tree] for tree in trees], np.int64)
        order = np.argsort(group, kind="stable")
        self.questions = np.split(order, np.searchsorted(group[order], np.arange(1, len(self.trees))))
        atoms = dict.fromkeys(a for tree in self.trees for a in _atoms(tree))
        self.atoms = [(name, operator, json.loads(operand)) for _, name, operator, operand in atoms]
        self.place = {atom: i for i, atom in enumerate(atoms)}

    def bitmaps(self, columns: Mapping[str, pa.Array], n: int) -> np.ndarray:
        """One packed bitmap over ``n`` rows per atom."""
        flags = np.zeros((len(self.atoms), n), bool)
        for i, (name, operator, operand) in enumerate(self.atoms):
            flags[i] = atom_flags(columns[name], operator, operand)
        return np.packbits(flags, axis=1)

    def rows(self, bitmaps: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(questions, rows) of every distinct filter that leaves a row."""
        every = np.packbits(np.ones(n, bool))
        for tree, questions in zip(self.trees, self.questions, strict=True):
            left = np.flatnonzero(np.unpackbits(self._combine(tree, bitmaps, every), count=n))
            if len(left):
                yield questions, left

    def _combine(self, tree: tuple, bitmaps: np.ndarray, every: np.ndarray) -> np.ndarray:
        if tree[0] == "atom":
            return bitmaps[self.place[tree]]
        parts = [self._combine(p, bitmaps, every) for p in tree[1]]
        if not parts:
            return every
        return (np.bitwise_and if tree[0] == "and" else np.bitwise_or).reduce(parts)


def tree_column(tree: tuple, kinds: Mapping[str, T.DataType]) -> Column:
    """The same condition as a column, for the scan; ``kinds`` gives the type of every field."""
    if tree[0] != "atom":
        parts = [tree_column(p, kinds) for p in tree[1]]
        return reduce((lambda a, b: a & b) if tree[0] == "and" else (lambda a, b: a | b), parts) if parts else F.lit(True)
    _, name, operator, operand = tree
    column, kind, value = field_column(name), kinds[name], json.loads(operand)
    if operator == "$contains":
        return F.array_contains(column, F.lit(value).cast(kind.elementType))
    if operator == "$in":
        return reduce(lambda a, b: a | b, [column == F.lit(v).cast(kind) for v in value if v is not None], F.lit(False))
    if isinstance(value, float) and isinstance(kind, T.IntegralType):
        column, kind = column.cast("double"), T.DoubleType()
    value = F.lit(value).cast(kind)
    return {"$eq": column == value, "$ne": column != value, "$lt": column < value, "$lte": column <= value,
            "$gt": column > value, "$gte": column >= value}[operator]


def _atoms(tree: tuple) -> Iterator[tuple]:
    if tree[0] == "atom":
        yield tree
    else:
        for part in tree[1]:
            yield from _atoms(part)


def _filter_fields(questions: DataFrame) -> list[str]:
    """The fields that any filter names; at most as many as the collection has."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for document in set(batch.column("filter").to_pylist()):
                found |= fields_of(parse_filter(document))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["field"])

    return sorted(row.field for row in questions.select("filter").mapInArrow(named, "field string").distinct().collect())


def _selected(collection: DataFrame, id_column: str, vector_column: str, fields: list[str]) -> DataFrame:
    return collection.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"),
                             *[field_column(name).alias(f"f{i}") for i, name in enumerate(fields)]).filter("vector is not null")


def vector_topk_filtered(
    queries: DataFrame, collection: DataFrame, k: int = DEFAULT_K, metric: str = "IP", qid_column: str = "qid",
    query_column: str = "query_vector", filter_column: str = "filter", id_column: str = "id", vector_column: str = "embedding",
    query_bytes_limit: int = QUERY_BYTES_LIMIT, block_rows: int | None = None,
) -> DataFrame:
    """Top-k per question among the rows its filter document lets through: (qid, id, score, rank).

    ``filter_column`` holds JSON text such as ``{"tender_id": "T1", "amount": {"$gte": 1000}}``; null or
    empty means no filter. A dotted field reads a map or struct entry. Text operands are read as dates
    or times where the field is one. Rows and questions without a vector take no part; vectors of another
    width, filters that cannot be read and fields that the collection lacks fail the job. A question
    whose filter leaves fewer than k rows gets those.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    questions = queries.select(
        F.col(qid_column).alias("qid"), F.col(query_column).cast("array<double>").alias("vector"),
        F.col(filter_column).alias("filter")).filter("vector is not null")
    fields = _filter_fields(questions)
    rows = _selected(collection, id_column, vector_column, fields)
    schema = T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    stored = rows.select(F.size("vector").alias("dim")).first()
    dim = stored.dim if stored else 1
    types = _arrow_types(schema)

    def search(held: _Best, filters: FilterSet, batch: pa.RecordBatch) -> None:
        for start in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(start, STEP_ROWS)
            vectors, ids = _to_matrix(part.column("vector"), dim), part.column("id")
            bitmaps = filters.bitmaps({name: part.column(f"f{i}") for i, name in enumerate(fields)}, part.num_rows)
            found = [held.candidates(asked, ids.take(pa.array(left)), vectors[left])
                     for asked, left in filters.rows(bitmaps, part.num_rows)]
            if found:
                held.merge(found)

    size = questions.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("filter")).alias("chars")).first()
    if size.n * 8 * dim + 4 * (size.chars or 0) <= query_bytes_limit:
        fetched = questions.toArrow()
        documents = fetched.column("filter").to_pylist()
        trees = set(map(parse_filter, documents))
        if 0 < len(trees) <= PUSHED_FILTERS:
            kinds = dict(zip(fields, [f.dataType for f in rows.schema.fields[2:]], strict=True))
            rows = _selected(collection.filter(tree_column(("or", tuple(sorted(trees, key=str))), kinds)), id_column, vector_column, fields)
        shared = rows.sparkSession.sparkContext.broadcast(
            (fetched.column("qid").to_pylist(), _to_matrix(fetched.column("vector"), dim) if stored else np.zeros((0, 1)),
             documents))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix, documents = shared.value
            held, filters = _Best(matrix, k, metric), FilterSet(documents)
            for batch in batches:
                if qids:
                    search(held, filters, batch)
            yield held.batch(qids, types)

        partial = rows.mapInArrow(best, schema)
    else:
        size = block_rows or max(BLOCK_BYTES // (8 * max(dim, 1)), 1)
        n_q, n_r = (max(1, -(-df.count() // size)) for df in (questions, rows))

        def block(df: DataFrame, key: str, own: str, n: int, other: str, n_other: int) -> DataFrame:
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))
            return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, every)

        def best_of(q_block: pa.Table, r_block: pa.Table) -> pa.Table:
            qids = q_block.column("qid").to_pylist()
            if not qids or not r_block.num_rows:
                return pa.Table.from_batches([_Best(np.zeros((0, 1)), k, metric).batch([], types)])
            held = _Best(_to_matrix(q_block.column("vector"), dim), k, metric)
            filters = FilterSet(q_block.column("filter").to_pylist())
            for batch in r_block.to_batches():
                search(held, filters, batch)
            return pa.Table.from_batches([held.batch(qids, types)])

        partial = block(questions, "qid", "qb", n_q, "rb", n_r).groupBy("qb", "rb").cogroup(
            block(rows, "id", "rb", n_r, "qb", n_q).groupBy("qb", "rb")).applyInArrow(best_of, schema)
    order = Window.partitionBy("qid").orderBy(best_first("score", metric), "id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
