"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(scale * x). A VA-file holds them in blocks: for each vector its cells (each component cut
into 2**bits cells of one width a dimension, one byte each) and the integers. A scan takes a block's cells and gets, by one
matrix product, an upper bound of every score with every query; then exact vectors are read in the order of
that bound, until the next bound is below the k-th score found so far, so that the result is certain.

Queries come in blocks of bounded size, each against all vectors; a task keeps k results a query, and the k
best of all tasks are the result. Nothing but one block of queries is sent to the executors.

Null or odd input: a vector that is null, empty, or holds null, NaN or infinite components takes no part, nor does a row
without id. Vectors of different length aren't compared. Repeated rows are each a candidate; a query's own
row is every row with its id. Queries that repeat an id are one query, with the smallest vector. Extra columns are ignored.
Components beyond 64 bits become the nearest long; where sums could pass 63 bits they are made with Python's integers, and a score
beyond a long is the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stage_table

BITS = 6
BLOCK, QUERIES = 4096, 1024
#: Blocks of queries whose results are written together.
AT_ONCE = 16


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v (array of long): the rows that take part."""
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole)
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def build(rows: DataFrame, bits: int = BITS) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The VA-file of rows (vec_id, v), and for each length of vector the lowest value and cell width by component."""
    rows = rows.withColumn("dim", F.size("v"))
    spread = rows.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    grid: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sorted({r["dim"] for r in spread}):
        own = sorted((r["at"], r["low"], r["high"]) for r in spread if r["dim"] == dim)
        low, high = ([r[i] for r in own] for i in (1, 2))
        # as Python's integers if a sum of products could pass 63 bits
        kind = object if sum(max(abs(a), abs(b)) ** 2 for a, b in zip(low, high)) >= 1 << 62 else np.int64
        grid[dim] = (np.array(low, kind), np.array([max(1, -(-(b - a + 1) // (1 << bits))) for a, b in zip(low, high)], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                low, width = grid[dim]
                for x in range(0, len(own), BLOCK):
                    part = own.slice(x, BLOCK)
                    exact = _matrix(part.column("v"), dim)
                    cells = ((exact.astype(low.dtype) - low) // width).astype(np.uint8)
                    ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()), pa.array([exact.astype("<i8").tobytes()], pa.binary())],
                        names=["dim", "ids", "cells", "exact"],
                    )

    return stage_table(rows.mapInArrow(run, "dim int, ids binary, cells binary, exact binary"), "va-file"), grid


class _Best:
    """The k best (score, id) of one query so far; ties go to the smaller id."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype == object:
            scores = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        top = np.lexsort((i, ~s))[: self.k]
        self.scores, self.ids = s[top], i[top]


def _scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], grid: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """queries: for each length of vector, ids and integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: [_Best(k) for _ in ids] for dim, (ids, _) in queries.items()}
        for b in batches:
            for r in range(len(b)):
                dim = b.column("dim")[r].as_py()
                if dim not in queries:
                    continue
                names, asked = queries[dim]
                low, width = grid[dim]
                whole = low.dtype
                asked = asked.astype(whole)
                ids = np.frombuffer(b.column("ids")[r].as_py(), "<i8")
                cells = np.frombuffer(b.column("cells")[r].as_py(), np.uint8).reshape(-1, dim)
                exact = np.frombuffer(b.column("exact")[r].as_py(), "<i8").reshape(-1, dim)
                q = asked.astype(np.float64)
                # highest score within a vector's cells: each component at its cell's upper or lower end
                base = q @ (low + cells * width).astype(np.float64).T
                upper = base + (np.maximum(q, 0) @ (width - 1).astype(np.float64))[:, None]
                # float sums are exact below 2**53; beyond, bounds stay safe by a share of the largest sum
                reach = np.maximum(np.abs(low.astype(np.float64)), np.abs((low + width * 256).astype(np.float64)))
                upper += (np.abs(q) @ reach)[:, None] * 1e-12
                for j, name in enumerate(names.tolist()):
                    mine, bound = best[dim][j], upper[j]
                    near = np.flatnonzero(bound >= mine.least())
                    near = near[ids[near] != name]
                    near = near[np.argsort(-bound[near], kind="stable")]
                    x, step = 0, 2 * k
                    while x < len(near) and bound[near[x]] >= mine.least():
                        take = near[x : x + step]
                        mine.add(exact[take].astype(whole) @ asked[j], ids[take])
                        x, step = x + step, 4 * step
        for dim, (names, _) in queries.items():
            found = best[dim]
            n = [len(f.ids) for f in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, n), pa.int64()), pa.array(np.concatenate([f.ids for f in found]), pa.int64()), pa.array(np.concatenate([f.scores for f in found]), pa.int64())],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    is_query: over the columns vec_id and v (the integers).
    """
    rows = integers(vectors, vec_id, vector, scale)
    blocks, grid = build(rows, bits)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = asked.count()
    parts = max(1, -(-n // QUERIES))
    asked = stage_table(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))), "queries") if parts > 1 else asked.withColumn("part", F.lit(0).cast("long"))
    found: list[DataFrame] = []
    for part in range(parts):
        own: dict[int, list] = {}
        for r in asked.where(F.col("part") == part).collect():  # one block: about QUERIES rows
            own.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        queries = {dim: (np.array([i for i, _ in q], np.int64), np.array([v for _, v in q], np.int64)) for dim, q in own.items()}
        found.append(blocks.mapInArrow(_scan(queries, grid, k), "query_id long, vec_id long, score long"))
        if len(found) > AT_ONCE:
            found = [stage_table(_best_of(found, k), "found")]
    return _best_of(found, k).select("query_id", "rank", "vec_id", "score")


def _best_of(found: list[DataFrame], k: int) -> DataFrame:
    every = found[0].select("query_id", "vec_id", "score")
    for f in found[1:]:
        every = every.union(f.select("query_id", "vec_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
