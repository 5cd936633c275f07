"""Approximate nearest neighbours: a navigable small-world hierarchy per shard.

Equal vectors are one node, which carries the smallest ids that can appear in an answer; nodes are
dealt to shards of about ``SHARD_NODES`` by a hash. A shard is one row of flat arrays: vectors, levels,
neighbours at level 0 (nodes x ``2 * LINKS``) and above (one block of ``LINKS`` per node and level).
Query blocks meet every shard of their width, and the k best of all shards are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import stage
from bidlake.llm.vectors import distinct_vectors, matrix, usable

SHARD_NODES = 4096
BLOCK_QUERIES = 1024
LINKS = 16
BUILD_BREADTH = 64
SEARCH_BREADTH = 128
SPARE = 16  # room beyond the limit before a neighbour list is pruned
MOST_TASKS = 20_000  # tasks of one build; beyond, a task builds several shards one after another


class Hierarchy:
    """One shard's graph over the rows of ``vectors`` (squared Euclidean distance)."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, ground: np.ndarray, upper: np.ndarray, entry: int):
        self.vectors, self.levels, self.ground, self.upper, self.entry = vectors, levels, ground, upper, entry
        self.upper_at = np.cumsum(levels) - levels
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0

    @staticmethod
    def build(vectors: np.ndarray, links: int = LINKS, breadth: int = BUILD_BREADTH, seed: int = 7) -> Hierarchy:
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        levels = np.minimum(np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(links)), 12).astype(np.int64)
        graph = Hierarchy(vectors, levels, np.full((n, 2 * links + SPARE), -1, np.int32),
                          np.full((int(levels.sum()), links + SPARE), -1, np.int32), 0)
        for i in range(1, n):
            graph._insert(i, links, breadth)
        for row in range(n):
            graph._prune(row, 0, 2 * links)
        for row in range(n):
            for level in range(1, int(levels[row]) + 1):
                graph._prune(row, level, links)
        graph.ground, graph.upper = graph.ground[:, :2 * links].copy(), graph.upper[:, :links].copy()
        return graph

    def _list(self, node: int, level: int) -> np.ndarray:
        return self.ground[node] if level == 0 else self.upper[self.upper_at[node] + level - 1]

    def _insert(self, i: int, links: int, breadth: int) -> None:
        q, top = self.vectors[i], int(self.levels[self.entry])
        near = [(self._distance(q, self.entry), self.entry)]
        for level in range(top, int(self.levels[i]), -1):
            near = self._layer(q, near, 1, level)
        for level in range(min(top, int(self.levels[i])), -1, -1):
            near = self._layer(q, near, breadth, level)
            most = 2 * links if level == 0 else links
            chosen = self._diverse(np.array([d for d, _ in near]), np.array([j for _, j in near]), links)
            self._list(i, level)[:len(chosen)] = chosen
            for j in chosen.tolist():
                own = self._list(j, level)
                free = int(np.argmax(own < 0)) if own[-1] < 0 else -1
                if free < 0:
                    self._prune(j, level, most)
                    free = int(np.argmax(own < 0))
                own[free] = i
        if self.levels[i] > top:
            self.entry = i

    def _prune(self, node: int, level: int, most: int) -> None:
        own = self._list(node, level)
        held = own[own >= 0]
        if len(held) <= most:
            return
        gaps = ((self.vectors[held] - self.vectors[node]) ** 2).sum(axis=1)
        order = np.lexsort((held, gaps))
        kept = self._diverse(gaps[order], held[order], most)
        own[:] = -1
        own[:len(kept)] = kept

    def _diverse(self, gaps: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Neighbours (ascending by gap) that are nearer to the node than to a chosen one; free
        places then go to the nearest that were passed over."""
        if len(nodes) <= most:
            return nodes
        v = self.vectors[nodes]
        norms = (v * v).sum(axis=1)
        between = norms[:, None] + norms[None, :] - 2 * (v @ v.T)
        open_, chosen = np.ones(len(nodes), bool), []
        for i in range(len(nodes)):
            if open_[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                open_ &= between[i] >= gaps
        picked = np.zeros(len(nodes), bool)
        picked[chosen] = True
        rest = np.flatnonzero(~picked)[:most - len(chosen)]
        return nodes[np.concatenate([np.array(chosen, np.int64), rest])]

    def _distance(self, q: np.ndarray, node: int) -> float:
        gap = self.vectors[node] - q
        return float(gap @ gap)

    def _layer(self, q: np.ndarray, entries: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest nodes found from ``entries`` on one level, ascending."""
        self.turn += 1
        seen, turn = self.seen, self.turn
        for _, j in entries:
            seen[j] = turn
        open_ = list(entries)
        heapq.heapify(open_)
        best = [(-d, -j) for d, j in entries]
        heapq.heapify(best)
        while len(best) > breadth:
            heapq.heappop(best)
        while open_:
            d, c = heapq.heappop(open_)
            if len(best) >= breadth and d > -best[0][0]:
                break
            near = self._list(c, level)
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            gap = self.vectors[near] - q
            gaps = np.einsum("ij,ij->i", gap, gap)
            if len(best) >= breadth:
                close = gaps < -best[0][0]
                gaps, near = gaps[close], near[close]
            for d, j in zip(gaps.tolist(), near.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-d, -j))
                    heapq.heappush(open_, (d, j))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, -j))
                    heapq.heappush(open_, (d, j))
        return sorted((-d, -j) for d, j in best)

    def search(self, q: np.ndarray, k: int, breadth: int = SEARCH_BREADTH) -> list[int]:
        """About the k nearest nodes, nearest first."""
        near = [(self._distance(q, self.entry), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            near = self._layer(q, near, 1, level)
        return [j for _, j in self._layer(q, near, max(breadth, k), 0)[:k]]


INDEX_SCHEMA = ("width int, shard int, n int, entry int, ids_kept int, vectors binary, ids binary, ids_each binary, "
                "levels binary, ground binary, upper binary")


def build_index(rows: DataFrame, ids_kept: int, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Index ``rows`` (id, vector); answers of up to ``ids_kept`` - 1 neighbours are complete in ids.

    Unusable vectors (null, zero, with null or non-finite components) are left out; vectors of
    different widths never meet. Returns the staged table of shards.
    """
    held = rows.filter(usable("vector")).select(
        F.col("id").cast("long").alias("id"), F.transform(F.col("vector").cast("array<double>"), lambda x: x + 0.0).alias("vector"))
    nodes = stage(distinct_vectors(held, ids_kept), "nodes")
    shards = nodes.groupBy("width").agg(F.ceil(F.count("*") / shard_nodes).cast("int").alias("shards"))
    # a shard takes seconds to build and few bytes to ship, so tasks are dealt by shards, not by bytes
    tasks = min(int(shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]), MOST_TASKS)
    dealt = nodes.join(shards, "width").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    dealt = dealt.repartition(2 * tasks, "width", "shard")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("vector")).astype(np.float64)
        ids = [np.array(x, np.int64) for x in table.column("ids").to_pylist()]
        order = np.argsort([x[0] for x in ids], kind="stable")  # same graph whatever the arrival
        vectors, ids = np.ascontiguousarray(vectors[order]), [ids[i] for i in order]
        graph = Hierarchy.build(vectors)
        raw = {"vectors": vectors, "ids": np.concatenate(ids), "ids_each": np.array([len(x) for x in ids], np.int32),
               "levels": graph.levels, "ground": graph.ground, "upper": graph.upper}
        numbers = {"width": key[0].as_py(), "shard": key[1].as_py(), "n": len(vectors), "entry": graph.entry, "ids_kept": ids_kept}
        return pa.table({**{c: pa.array([x], pa.int32()) for c, x in numbers.items()},
                         **{c: pa.array([x.tobytes()], pa.binary()) for c, x in raw.items()}})

    return stage(dealt.select("width", "shard", "vector", "ids").groupBy("width", "shard").applyInArrow(build, INDEX_SCHEMA), "index")


def search(index: DataFrame, queries: DataFrame, k: int, breadth: int = SEARCH_BREADTH, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found per usable query (id, vector).

    Score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller vec_id; a row never answers the query of its own id. No queries or no rows: no answers.
    """
    asked = queries.filter(usable("vector")).select(
        F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).distinct()
    blocks = max(-(-asked.count() // block), 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("width", F.size("vector"))
    places = index.select("width", "shard")
    packed = asked.groupBy("width", "block").applyInArrow(_pack, "width int, block int, ids binary, asked binary")
    left = packed.join(places, "width")
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(*(F.col(c).alias(c + "2") for c in right.columns))

    def meet(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for a in one.to_pylist():
            for b in other.to_pylist():
                _answer(a, {c.removesuffix("2"): x for c, x in b.items()}, k, breadth, out)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t)
                         for c, x, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    found = left.groupBy("width", "shard", "block").cogroup(right.groupBy("width2", "shard2", "block2")).applyInArrow(
        meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    vectors = matrix(table.column("vector")).astype(np.float64)
    return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                     "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
                     "asked": pa.array([vectors.tobytes()], pa.binary())})


def _answer(asked: dict, shard: dict, k: int, breadth: int, out: list[list]) -> None:
    n, width = shard["n"], shard["width"]
    array = lambda name, kind: np.frombuffer(shard[name], kind)
    levels = array("levels", np.int64)
    graph = Hierarchy(array("vectors", np.float64).reshape(n, width), levels, array("ground", np.int32).reshape(n, -1),
                      array("upper", np.int32).reshape(int(levels.sum()), LINKS), shard["entry"])
    ids, each = array("ids", np.int64), array("ids_each", np.int32)
    first = np.cumsum(each) - each
    for q_id, q in zip(np.frombuffer(asked["ids"], np.int64), np.frombuffer(asked["asked"], np.float64).reshape(-1, width), strict=True):
        nodes = np.array(graph.search(q, k + 1, breadth))
        gap = graph.vectors[nodes] - q
        score = np.sqrt((gap * gap).sum(axis=1))
        own = np.concatenate([ids[first[i]:first[i] + each[i]] for i in nodes])
        scores = np.repeat(score, each[nodes])
        keep = own != q_id
        own, scores = own[keep], scores[keep]
        best = np.lexsort((own, scores))[:k]
        out[0].append(np.full(len(best), q_id))
        out[1].append(own[best])
        out[2].append(scores[best])
