"""Codebooks of any size: codes in blocks, of which a task holds one at a time.

A block is a folder of a staged table, small enough to be broadcast. For each block the points are scored and report
their best ``(cost, code)`` there; one reduce over these small rows picks the winners, and sums by code move the
centers of each block. Neither centers nor sums are ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.ordering import global_rank
from tagweave.functions.vectors import add_vectors, finite_matrix, lists, matrix
from tagweave.session import remove_path, stage


@dataclass
class Blocks:
    """A table with ``code`` and ``center``, in order of the codes, cut into ``count`` blocks of ``size`` codes."""

    table: DataFrame
    count: int
    size: int

    @staticmethod
    def of(codebook: DataFrame, k: int, size: int) -> Blocks:
        if k <= size:
            return Blocks(codebook, 1, size)
        numbered = global_rank(codebook, ["code"], "place", "codes")
        cut = F.expr(f"place div {size}")
        return Blocks(stage(numbered.withColumn("block", cut).drop("place"), "codes", partition="block"), -(-k // size), size)

    def __iter__(self) -> Iterator[pa.Table]:
        for block in range(self.count):
            part = self.table if self.count == 1 else self.table.where(F.col("block") == block).drop("block")
            yield part.toArrow().sort_by("code")

    def drop(self) -> None:
        if self.count > 1:
            remove_path(self.table.sparkSession, self.table.staged_path)


Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def winners(marked: DataFrame, blocks: Blocks, score: Scorer, weight: str) -> DataFrame:
    """``mark, cost, code`` of every marked point: the least cost of all codes, the lowest code on ties.

    ``score`` gives the costs of points (n, d) for centers (b, d) and their values of the column ``weight``.
    """
    best, paths = None, []
    for table in blocks:
        codes = table.column("code").to_numpy().astype(np.int32)
        width = len(table.column("center")[0])
        centers = matrix(table.column("center").combine_chunks(), width)
        shared = marked.sparkSession.sparkContext.broadcast((codes, centers, table.column(weight).to_numpy()))
        found = stage(marked.select("mark", "vec").mapInArrow(_best(shared, score), "mark long, cost double, code int"), "costs")
        shared.destroy()
        paths.append(found.staged_path)
        best = found if best is None else best.unionByName(found)
    if blocks.count > 1:
        best = best.groupBy("mark").agg(F.min(F.struct("cost", "code")).alias("least")).select("mark", "least.cost", "least.code")
    best.staged_paths = paths
    return best


def _best(shared, score: Scorer):
    def task(batches):
        codes, centers, weights = shared.value
        step = max(1, 4_000_000 // len(codes))
        for batch in batches:
            x = finite_matrix(batch.column(1), centers.shape[1])
            place, cost = np.empty(len(x), np.int64), np.empty(len(x))
            for lo in range(0, len(x), step):
                costs = score(x[lo : lo + step], centers, weights)
                place[lo : lo + step] = costs.argmin(axis=1)
                cost[lo : lo + step] = costs.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cost), pa.array(codes[place])], names=["mark", "cost", "code"])

    return task


def code_sums(coded: DataFrame, width: int) -> DataFrame:
    """``code, total``: of the points ``code, vec`` the sum of the vectors and, as last value, their number.

    Points of one code are added up within each batch first, so a code with very many points sends few rows.
    """

    def task(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy()
            if not len(codes):
                continue
            x = np.hstack([finite_matrix(batch.column(1), width), np.ones((len(codes), 1))])
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(codes[order][cuts]), lists(np.add.reduceat(x[order], cuts, axis=0))], names=["code", "total"])

    partial = coded.select("code", "vec").mapInArrow(task, "code int, total array<double>")
    return add_vectors(partial, "code", "total", width + 1)


def first_distinct(points: DataFrame, n: int, order: list[str], taken: DataFrame | None) -> DataFrame:
    """``place, point_id, vec``: the first ``n`` distinct vectors in the given order that are not in ``taken`` (``vec``)."""
    first = points.groupBy("vec").agg(F.min(F.struct(*dict.fromkeys([*order, "point_id"]))).alias("first"))
    if taken is not None:
        first = first.join(taken, "vec", "left_anti")
    ranked = global_rank(first, [*[f"first.{c}" for c in order], "vec"], "place", "seeds")
    return ranked.where(F.col("place") < n).select("place", "first.point_id", "vec")


@dataclass
class Book:
    """A codebook as a staged table ``code, center, size``."""

    table: DataFrame
    k: int
    width: int

    def frame(self) -> DataFrame:
        squares = F.aggregate("center", F.lit(0.0), lambda s, v: s + v * v)
        return self.table.select("code", "center", "size", (F.lit(0.5) * squares).alias("half_norm"))


def learn_batch(points: DataFrame, book: Book | None, k: int, width: int, block: int, order: list[str], score: Scorer) -> Book:
    """One batch of points ``point_id, vec`` and the columns of ``order``: assign with frozen centers, then move them.

    Missing codes are seeded from the batch; seeds are scored as clusters of one point and add up from nothing.
    """
    names = list(dict.fromkeys(["point_id", "vec", *order]))
    marked = stage(points.select(*names).withColumn("mark", F.monotonically_increasing_id()), "marked")
    taken = 0 if book is None else book.k
    old = None if book is None else book.table.select("code", "center", "size", F.col("size").alias("counted"))
    whole = old
    if taken < k:
        known = None if book is None else book.table.select(F.col("center").alias("vec"))
        seeds = first_distinct(marked, k - taken, order, known)
        fresh = seeds.select(
            (F.col("place") + taken).cast("int").alias("code"), F.col("vec").cast("array<double>").alias("center"),
            F.lit(1.0).alias("size"), F.lit(0.0).alias("counted"),
        )
        whole = stage(fresh if old is None else old.unionByName(fresh), "book")
    n = whole.count()
    if not n:
        raise ValueError("there are no points to learn from")
    blocks = Blocks.of(whole, n, block)
    won = winners(marked, blocks, score, "size")
    sums = code_sums(marked.join(won.select("mark", "code"), "mark"), width)
    met = whole.join(sums, "code", "left")
    added = F.coalesce(F.element_at("total", -1), F.lit(0.0))
    grown = F.col("counted") + added
    moved = F.zip_with("center", F.slice("total", 1, width), lambda c, t: (F.col("counted") * c + t) / grown)
    center = F.when(added > 0, moved).otherwise(F.col("center"))
    done = Book(stage(met.select("code", center.alias("center"), grown.alias("size")), "book"), n, width)
    blocks.drop()
    for path in (*won.staged_paths, marked.staged_path):
        remove_path(points.sparkSession, path)
    if book is not None:
        remove_path(points.sparkSession, book.table.staged_path)
    return done
