"""Embedding near-duplicates: tiles in principal-component order with early stopping.

Unit vectors are turned to their principal components (from the second moments of all rows). Equal
vectors are one class. Classes are cut into tiles by the first component; two tiles meet only if
their ranges in the leading components and the norms of what is left allow a cosine of the
threshold. Inside a pair of tiles the product over the leading components plus the product of the
remaining norms bounds every cosine; pairs whose bound is below the threshold stop there, the others
are computed in double precision from the original vectors. A pair of tiles returns link counts and
a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import components, local_roots, stage
from bidlake.llm.vectors import matrix, usable

THRESHOLD = 0.95
TILE_ROWS = 4096
LEADING = 16
STRIP = 1024  # rows of a tile whose bounds are held at once
SLACK = 1e-5


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS, leading: int = LEADING) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (id, vector).

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    vectors of different widths. Repeated rows count as vectors of their own. No rows give none.
    """
    kept = rows.select(F.col("id").cast("long").alias("id"), F.when(
        usable("vector"), F.transform(F.col("vector").cast("array<double>"), lambda x: x + 0.0)).alias("vector"))
    classes = stage(kept.filter("vector is not null").groupBy("vector").agg(
        F.min("id").alias("class_id"), F.count("*").alias("copies")).withColumn("width", F.size("vector")), "classes")
    found = None
    for width, n in sorted(map(tuple, classes.groupBy("width").count().collect())):
        here = _links(classes.filter(F.col("width") == width), width, n, threshold, tile_rows, min(leading, width))
        found = here if found is None else found.unionByName(here)
    alone = kept.filter("vector is null").select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is not None:
        found = stage(found, "links")
        linked = found.groupBy("class_id").agg(F.sum("links").alias("links"))
        groups = components(found.select(F.col("class_id").alias("a"), F.col("low").alias("b")))
        summary = classes.join(linked, "class_id", "left").join(groups, F.col("class_id") == F.col("id"), "left").select(
            "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"))
        alone = alone.unionByName(kept.filter("vector is not null").join(summary, "vector").select(
            F.col("id").alias("vec_id"), "n_links", "component_id"))
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _rotation(classes: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments of the unit vectors, largest first (width x width numbers)."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            unit = _unit(matrix(batch.column("vector")))
            total += unit.T @ unit
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width * width, dtype=np.int32)), "x": pa.array(total.ravel())})

    sums = classes.select("vector").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(width * width)
    for i, x in sums:
        total[i] = x
    values, vectors = np.linalg.eigh(total.reshape(width, width))
    return vectors[:, np.argsort(-values)]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _links(classes: DataFrame, width: int, n: int, threshold: float, tile_rows: int, leading: int) -> DataFrame:
    """(class_id, links, low) per linked class and pair of tiles."""
    rotation = _rotation(classes, width)

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(matrix(batch.column("vector"))) @ rotation[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class_id", "copies", "vector")), pa.array(x)],
                                             ["class_id", "copies", "vector", "x"])

    placed = stage(classes.mapInArrow(first_of, "class_id long, copies long, vector array<double>, x double"), "placed")
    tiles = -(-n // tile_rows)
    marks = [i / tiles for i in range(1, tiles)]
    borders = np.unique(placed.approxQuantile("x", marks, 0.2 / tiles)) if marks else np.zeros(0)

    def tile_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = np.searchsorted(borders, batch.column("x").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tile), *(batch.column(c) for c in ("class_id", "copies", "vector"))],
                                             ["tile", "class_id", "copies", "vector"])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("class_id")
        v = matrix(table.column("vector"))
        turned = _unit(v) @ rotation
        rest = np.sqrt(np.maximum((turned[:, leading:] ** 2).sum(axis=1), 0.0))
        return pa.table({
            "tile": pa.array([key[0].as_py()], pa.int32()), "low": pa.array([turned[:, :leading].min(axis=0).tolist()]),
            "high": pa.array([turned[:, :leading].max(axis=0).tolist()]), "rest": pa.array([float(rest.max())]),
            "ids": pa.array([table.column("class_id").to_numpy().tobytes()], pa.binary()),
            "copies": pa.array([table.column("copies").to_numpy().tobytes()], pa.binary()),
            "data": pa.array([v.tobytes()], pa.binary())})

    boxes = "tile int, low array<double>, high array<double>, rest double, ids binary, copies binary, data binary"
    tiled = placed.mapInArrow(tile_of, "tile int, class_id long, copies long, vector array<double>")
    # close to one first component, a tile can only be split by where the borders fall; its rows stay a few tiles at most
    packed = stage(tiled.groupBy("tile").applyInArrow(pack, boxes), "tiles")
    reach = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + SLACK
    last = [int(np.searchsorted(borders, (borders[i] if i < len(borders) else np.inf) + reach, side="right")) for i in range(len(borders) + 1)]
    spans = packed.sparkSession.createDataFrame([(i, j) for i, j in enumerate(last)], "tile int, last int")
    ranges = packed.select("tile", "low", "high", "rest")
    other = ranges.select(*(F.col(c).alias(c + "2") for c in ("tile", "low", "high", "rest")))
    pairs = ranges.join(spans, "tile").withColumn("tile2", F.explode(F.sequence("tile", "last"))).join(other, "tile2")
    corners = [F.zip_with(a, b, lambda x, y: x * y) for a in ("low", "high") for b in ("low2", "high2")]
    most = F.aggregate(F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(corners))), F.lit(0.0),
                       lambda s, z: s + F.greatest(z["c0"], z["c1"], z["c2"], z["c3"]))
    pairs = pairs.filter(most + F.col("rest") * F.col("rest2") >= threshold - SLACK).select("tile", "tile2")
    pairs = stage(pairs, "pairs")
    side = packed.select("tile", "ids", "copies", "data")
    left = pairs.join(side, "tile").select(F.col("tile").alias("i"), F.col("tile2").alias("j"), "ids", "copies", "data")
    right = pairs.join(side.withColumnRenamed("tile", "tile2"), "tile2").select(
        F.col("tile").alias("i2"), F.col("tile2").alias("j2"), *(F.col(c).alias(c + "2") for c in ("ids", "copies", "data")))

    def meet(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        other = {c.removesuffix("2"): x for c, x in two.to_pylist()[0].items()}
        return _meet(one.to_pylist()[0], other, key[0].as_py() == key[1].as_py(), width, rotation, threshold, leading)

    return left.groupBy("i", "j").cogroup(right.groupBy("i2", "j2")).applyInArrow(meet, "class_id long, links long, low long")


def _meet(one: dict, two: dict, same: bool, width: int, rotation: np.ndarray, threshold: float, leading: int) -> pa.Table:
    def side(row: dict) -> tuple:
        v = np.frombuffer(row["data"], np.float64).reshape(-1, width)
        unit = _unit(v)
        turned = unit @ rotation
        rest = np.sqrt((turned[:, leading:] ** 2).sum(axis=1))
        bound = np.concatenate([turned[:, :leading], rest[:, None]], axis=1).astype(np.float32)
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64), unit, bound

    ids1, copies1, unit1, bound1 = side(one)
    ids2, copies2, unit2, bound2 = side(two)
    links1, links2 = np.zeros(len(ids1), np.int64), np.zeros(len(ids2), np.int64)
    root = np.arange(len(ids1) + len(ids2))
    for at in range(0, len(ids1), STRIP):
        high = bound1[at:at + STRIP] @ bound2.T
        a, b = np.nonzero(high >= np.float32(threshold - SLACK))
        if same:
            a, b = a[a + at < b], b[a + at < b]
        if not len(a):
            continue
        cosine = np.concatenate([np.einsum("ij,ij->i", unit1[a[i:i + 65536] + at], unit2[b[i:i + 65536]])
                                 for i in range(0, len(a), 65536)])
        near = cosine >= threshold
        a, b = a[near] + at, b[near]
        links1 += np.bincount(a, copies2[b], len(ids1)).astype(np.int64)
        links2 += np.bincount(b, copies1[a], len(ids2)).astype(np.int64)
        found = local_roots(len(root), np.concatenate([np.arange(len(root)), a]), np.concatenate([root, (b if same else b + len(ids1))]))
        root = found
    if same:
        links1, ids, links = links1 + links2, ids1, links1 + links2
        root = root[:len(ids1)]
    else:
        ids, links = np.concatenate([ids1, ids2]), np.concatenate([links1, links2])
    least = np.full(len(root), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    some = links > 0
    return pa.table({"class_id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()),
                     "low": pa.array(least[root][some], pa.int64())})
