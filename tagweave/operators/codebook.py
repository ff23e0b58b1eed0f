"""Learning codebooks: seeding, balanced online clustering in batches, k-means.

Points are ``(point_id, vec array<double>)``. A codebook is ``(code, center, size, half_norm)``.
Up to ``MODEL_CELLS`` values it is held whole by the driver and the tasks; larger ones are learned and
used block by block (``shards``), with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.mathx import hash_order, uniform_of
from tagweave.functions.ordering import slices
from tagweave.functions.vectors import add_vectors, finite_matrix, lists, matrix
from tagweave.operators import shards
from tagweave.session import MODEL_CELLS, new_path, remove_path, stage

CODEBOOK = "code int, center array<double>, size double, half_norm double"
SCORE_CELLS = 4_000_000


@dataclass
class Codebook:
    """Centers (k, d) and sizes (k) on the driver."""

    centers: np.ndarray
    sizes: np.ndarray

    @property
    def half_norms(self) -> np.ndarray:
        return 0.5 * (self.centers**2).sum(axis=1)

    @staticmethod
    def gather(codebook: DataFrame) -> "Codebook":
        table = codebook.select("code", "center", "size").toArrow().sort_by("code")
        width = len(table.column("center")[0]) if len(table) else 0
        return Codebook(matrix(table.column("center").combine_chunks(), width), table.column("size").to_numpy().astype(float))

    def frame(self, spark: SparkSession) -> DataFrame:
        table = pa.table(
            {
                "code": pa.array(np.arange(len(self.sizes), dtype=np.int32)),
                "center": lists(self.centers),
                "size": pa.array(self.sizes),
                "half_norm": pa.array(self.half_norms),
            }
        )
        return spark.createDataFrame(table, schema=CODEBOOK)


def in_one_piece(k: int, width: int) -> bool:
    return k * width <= MODEL_CELLS


def block_size(width: int) -> int:
    """Codes in a block."""
    return max(1, MODEL_CELLS // max(1, width))


def size_of(codebook: DataFrame) -> tuple[int, int]:
    """The number of codes and the width of the centers, without gathering any."""
    k, width = codebook.agg(F.count("*"), F.max(F.size("center"))).first()
    return k, width or 0


def vector_width(points: DataFrame) -> int:
    first = points.where("vec is not null").select(F.size("vec")).first()
    return 0 if first is None else first[0]


def _seed_rows(points: DataFrame, k: int, order: list[str], taken: np.ndarray) -> tuple[list, np.ndarray]:
    """Ids and vectors of the first ``k`` distinct vectors in the given order that are not in ``taken``.

    Each round reads the points once and keeps the few first rows per task (a top-n, no full
    sort). Copies of a vector found in one round are filtered out in the next, so a vector with
    very many copies cannot fill the rounds.
    """
    ids, seeds = [], []
    known = {v.tobytes(): v for v in taken + 0.0}  # zeros of either sign are equal
    while len(seeds) < k:
        rest = points
        if known:
            found = points.sparkSession.createDataFrame(pa.table({"vec": lists(np.array(list(known.values())))}))
            rest = points.join(F.broadcast(found), "vec", "left_anti")
        head = rest.orderBy(*order).limit(4 * k).select("point_id", "vec").toArrow()
        if len(head):
            width = len(head.column("vec")[0])
            for i, vector in zip(head.column("point_id").to_pylist(), matrix(head.column("vec").combine_chunks(), width) + 0.0, strict=True):
                if vector.tobytes() not in known and len(seeds) < k:
                    known[vector.tobytes()] = vector
                    ids.append(i)
                    seeds.append(vector)
        if len(head) < 4 * k:
            break
    return ids, np.array(seeds)


def codebook_seed(points: DataFrame, k: int, order: list[str] | None = None) -> DataFrame:
    """The first k distinct vectors ``(code, point_id, vec)``: empty clusters cost nothing, so they win first."""
    given, order, width = points.where("vec is not null"), order or ["point_id"], vector_width(points)
    if not in_one_piece(4 * k, width):
        found = shards.first_distinct(given, k, order, None)
        return found.select(F.col("place").cast("int").alias("code"), "point_id", F.col("vec").cast("array<double>").alias("vec"))
    ids, seeds = _seed_rows(given, k, order, np.zeros((0, width)))
    schema = T.StructType(
        [
            T.StructField("code", T.IntegerType()),
            T.StructField("point_id", points.schema["point_id"].dataType),
            T.StructField("vec", T.ArrayType(T.DoubleType())),
        ]
    )
    rows = [(n, i, v) for n, (i, v) in enumerate(zip(ids, seeds.tolist(), strict=True))]
    return points.sparkSession.createDataFrame(rows, schema)


def _costs(x: np.ndarray, centers: np.ndarray, norms: np.ndarray, balance: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + norms[None, :] - 2.0 * (x @ centers.T)
    return balance[None, :] * squares


def balanced_costs(x: np.ndarray, centers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _costs(x, centers, (centers**2).sum(axis=1), sizes / (1.0 + sizes))


def plain_costs(x: np.ndarray, centers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _costs(x, centers, (centers**2).sum(axis=1), np.ones(len(sizes)))


def _cost_batches(batches, column: int, book, balanced: bool = True):
    centers, sizes = book
    norms = (centers**2).sum(axis=1)
    balance = sizes / (1.0 + sizes) if balanced else np.ones(len(sizes))
    step = max(1, SCORE_CELLS // len(sizes))
    for batch in batches:
        x = finite_matrix(batch.column(column), centers.shape[1])
        codes = np.empty(len(x), dtype=np.int32)
        costs = np.empty(len(x))
        for lo in range(0, len(x), step):
            all_costs = _costs(x[lo : lo + step], centers, norms, balance)
            codes[lo : lo + step] = all_costs.argmin(axis=1)
            costs[lo : lo + step] = all_costs.min(axis=1)
        yield batch, x, codes, costs


def hartigan_assign(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """The code with the least ``n / (1 + n) * squared distance`` per point, lowest code on ties."""
    k, width = size_of(codebook)
    if not in_one_piece(k, width):
        marked = points.where("vec is not null").select("point_id", "vec", F.monotonically_increasing_id().alias("mark"))
        marked = stage(marked, "marked")
        won = shards.winners(marked, shards.Blocks.of(codebook.select("code", "center", "size"), k, block_size(width)), balanced_costs, "size")
        return marked.join(won, "mark").select("point_id", "code", "cost")
    book = Codebook.gather(codebook)
    bc = points.sparkSession.sparkContext.broadcast((book.centers, book.sizes))
    schema = T.StructType(
        [points.schema["point_id"], T.StructField("code", T.IntegerType()), T.StructField("cost", T.DoubleType())]
    )

    def task(batches):
        for batch, _, codes, costs in _cost_batches(batches, 1, bc.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes), pa.array(costs)], names=schema.names)

    return points.where("vec is not null").select("point_id", "vec").mapInArrow(task, schema)


def _add_points(points: DataFrame, book: Codebook, fresh: int = 0, balanced: bool = True) -> Codebook:
    """Assign with frozen centers, add up per code inside each task, and move the running means.

    The last ``fresh`` codes are seeds from these points: they are scored as clusters of one point but add up from nothing,
    so the seeds themselves are counted by the scan like every other point, whatever their ids.
    """
    k, width = book.centers.shape
    bc = points.sparkSession.sparkContext.broadcast((book.centers, book.sizes))

    def task(batches):
        total = np.zeros((k, width + 1))
        for _, x, codes, _ in _cost_batches(batches, 0, bc.value, balanced):
            order = np.argsort(codes, kind="stable")
            ordered = codes[order]
            cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else []
            if len(cuts):
                total[ordered[cuts], :width] += np.add.reduceat(x[order], cuts, axis=0)
                total[:, width] += np.bincount(codes, minlength=k)
        used = np.flatnonzero(total[:, width]).astype(np.int32)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), lists(total[used])], names=["code", "total"])

    partial = points.where("vec is not null").select("vec").mapInArrow(task, "code int, total array<double>")
    sums = add_vectors(partial, "code", "total", width + 1).toArrow()
    bc.destroy()
    centers, sizes = book.centers.copy(), book.sizes.copy()
    sizes[k - fresh :] = 0.0
    if len(sums):
        codes = sums.column("code").to_numpy()
        totals = matrix(sums.column("total").combine_chunks(), width + 1)
        grown = sizes[codes] + totals[:, width]
        centers[codes] = (sizes[codes][:, None] * centers[codes] + totals[:, :width]) / grown[:, None]
        sizes[codes] = grown
    return Codebook(centers, sizes)


def _learn_batch(points: DataFrame, book: Codebook | shards.Book | None, k: int, order: list[str],
                 balanced: bool = True) -> Codebook | shards.Book:
    points = points.where("vec is not null")
    if isinstance(book, shards.Book) or book is None:
        width = vector_width(points) if book is None else book.width
        if isinstance(book, shards.Book) or not in_one_piece(k, width):
            return shards.learn_batch(points, book, k, width, block_size(width), order, balanced_costs if balanced else plain_costs)
    taken = 0 if book is None else len(book.sizes)
    fresh = 0
    if taken < k:
        known = np.zeros((0, 0)) if book is None else book.centers
        _, new = _seed_rows(points, k - taken, order, known)
        if len(new):
            fresh = len(new)
            old = np.zeros((0, new.shape[1])) if book is None else book.centers
            counted = np.zeros(0) if book is None else book.sizes
            book = Codebook(np.vstack([old, new]), np.r_[counted, np.ones(fresh)])
    if book is None:
        raise ValueError("there are no points to learn from")
    return _add_points(points, book, fresh, balanced)


def _frame(book: Codebook | shards.Book, spark: SparkSession) -> DataFrame:
    return book.frame(spark) if isinstance(book, Codebook) else book.frame()


def hartigan_partial_fit(points: DataFrame, codebook: DataFrame | None, k: int = 2,
                         order: list[str] | None = None) -> DataFrame:
    """Add one batch to a codebook. Missing codes are seeded from the batch, in ``order`` (default: id).

    Centers and balances are frozen while the batch is assigned; for batches of one point this is
    the sequential rule, for larger ones it approaches it while batches are small next to clusters.
    Every point counts once, also where ids repeat or are null; points without a vector are left out.
    """
    return _partial_fit(points, codebook, k, order, balanced=True)


def minibatch_kmeans_partial_fit(points: DataFrame, codebook: DataFrame | None, k: int = 32,
                                 order: list[str] | None = None) -> DataFrame:
    """Add one mini-batch by k-means: each point goes to its nearest center, centers are running means of their points."""
    return _partial_fit(points, codebook, k, order, balanced=False)


def _partial_fit(points: DataFrame, codebook: DataFrame | None, k: int, order: list[str] | None, balanced: bool) -> DataFrame:
    book = None
    if codebook is not None:
        n, width = size_of(codebook)
        if in_one_piece(max(n, k), width):
            book = Codebook.gather(codebook)
        else:
            book = shards.Book(stage(codebook.select("code", "center", "size"), "book"), n, width)
    return _frame(_learn_batch(points, book, k, order or ["point_id"], balanced), points.sparkSession)


def batch_of(points: DataFrame, n_batches: int, seed: str) -> DataFrame:
    """Add ``_order`` (a hash shuffle) and ``batch``, its range cut into equal parts; needs no sort."""
    placed = points.withColumn("_order", hash_order(seed, F.col("point_id")))
    return placed.withColumn("batch", F.floor(uniform_of(F.col("_order")) * n_batches).cast("int"))


def hartigan_fit(points: DataFrame, k: int = 2, max_iter: int = 10, n_batches: int = 10, shuffle: bool = True,
                 seed: int = 0) -> DataFrame:
    """``max_iter`` passes over the points in ``n_batches`` batches each, from an empty codebook.

    Sizes keep growing over passes and points are never taken back, as with one long stream.
    With ``shuffle`` every pass goes through the points in a hash order of its own; without, in the order of their ids,
    in batches of equal size.
    """
    return _fit(points, k, max_iter, n_batches, shuffle, seed, balanced=True)


def minibatch_kmeans(points: DataFrame, k: int = 32, max_iter: int = 10, n_batches: int = 10, shuffle: bool = True,
                     seed: int = 0) -> DataFrame:
    """As ``hartigan_fit``, with the nearest center instead of the balanced cost: the quantizer's default clusterer."""
    return _fit(points, k, max_iter, n_batches, shuffle, seed, balanced=False)


def _fit(points: DataFrame, k: int, max_iter: int, n_batches: int, shuffle: bool, seed: int, balanced: bool) -> DataFrame:
    spark = points.sparkSession
    points = points.where("vec is not null").select("point_id", "vec")
    book, path = None, None
    if not shuffle:
        # sorted and written once; a batch is a range of the stored rows
        size = max(1, -(-points.count() // n_batches))
        n_batches, batch_at = slices(points, ["point_id", "vec"], size, "points")
        order, path = ["point_id"], batch_at.staged_path
    for n_pass in range(max_iter):
        if shuffle:
            split = batch_of(points, n_batches, f"{seed}:{n_pass}")
            # one shuffle and one write per pass instead of n_batches full reads
            path = new_path(spark, "points")
            split.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
            table = spark.read.parquet(path)
            order = ["_order", "point_id"]
        for n in range(n_batches):
            batch = table.where(F.col("batch") == n) if shuffle else batch_at(n)
            if book is None and batch.isEmpty():
                continue
            book = _learn_batch(batch, book, k, order, balanced)
        if shuffle:
            remove_path(spark, path)
    if not shuffle and path is not None:
        remove_path(spark, path)
    if book is None:
        raise ValueError("there are no points to learn from")
    return _frame(book, spark)


# --- k-means over all points --------------------------------------------------------------------------------------


def _scan_candidates(points: DataFrame, candidates: np.ndarray, schema: str, report: Callable) -> DataFrame:
    """One map over the points with their squared distances to the candidates: the least one, and whose it is."""
    shared = points.sparkSession.sparkContext.broadcast(candidates)

    def task(batches):
        c = shared.value
        norms, ones = (c**2).sum(axis=1), np.ones(len(c))
        step = max(1, SCORE_CELLS // len(c))
        for batch in batches:
            x = finite_matrix(batch.column("vec"), c.shape[1])
            least, near = np.empty(len(x)), np.empty(len(x), np.int64)
            for lo in range(0, len(x), step):
                d = np.maximum(_costs(x[lo : lo + step], c, norms, ones), 0.0)
                near[lo : lo + step] = d.argmin(axis=1)
                least[lo : lo + step] = d.min(axis=1)
            out = report(batch, least, near)
            if out is not None:
                yield out

    return points.mapInArrow(task, schema)


def oversampled(points: DataFrame, k: int, seed: int, rounds: int, oversample: float) -> np.ndarray:
    """Candidates for ``k`` centers (k-means||): the point first in the hash order, then in each round every point with
    probability ``oversample * k * d / sum of d``, where d is its squared distance to the candidates so far.

    Draws are md5 of (seed, round, point id): the same under any partitioning. About ``oversample * k`` points come in a
    round. Equal vectors are one candidate.
    """
    width = vector_width(points)
    ordered = points.withColumn("draw", hash_order(f"{seed}:first", F.col("point_id")))
    head = ordered.orderBy("draw", "vec").limit(1).toArrow()
    if not len(head):
        raise ValueError("there are no points to learn from")
    candidates = finite_matrix(head.column("vec").combine_chunks(), width)

    def total(_batch, least, _near):
        return pa.RecordBatch.from_arrays([pa.array([float(least.sum())])], names=["d"])

    for n in range(rounds):
        whole = _scan_candidates(points.select("vec"), candidates, "d double", total).agg(F.sum("d")).first()[0]
        if not whole > 0:
            break
        rate = oversample * k / whole

        def drawn(batch, least, _near, rate=rate):
            hit = np.flatnonzero(batch.column("u").to_numpy() < np.minimum(1.0, rate * least))
            return batch.take(pa.array(hit)) if len(hit) else None

        kind = points.schema["point_id"].dataType.simpleString()
        given = points.withColumn("u", uniform_of(hash_order(f"{seed}:{n}", F.col("point_id"))))
        found = _scan_candidates(given, candidates, f"point_id {kind}, vec array<double>, u double", drawn)
        rows = found.dropDuplicates(["vec"]).orderBy("vec").select("vec").toArrow()
        if len(rows):
            candidates = np.vstack([candidates, matrix(rows.column("vec").combine_chunks(), width)])
    return candidates


def reclustered(candidates: np.ndarray, weights: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """``k`` centers of weighted candidates: the heaviest, then one by one the one with the most weight times squared
    distance to the centers so far (the first of several); then ``rounds`` of weighted k-means."""
    chosen = [int(weights.argmax())]
    least = ((candidates - candidates[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(candidates)):
        chosen.append(int((weights * least).argmax()))
        least = np.minimum(least, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
    centers = candidates[chosen].copy()
    for _ in range(rounds):
        near = _costs(candidates, centers, (centers**2).sum(axis=1), np.ones(len(centers))).argmin(axis=1)
        heavy = np.bincount(near, weights, len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, candidates * weights[:, None])
        centers[heavy > 0] = sums[heavy > 0] / heavy[heavy > 0, None]
    return centers


def kmeans_codebook(points: DataFrame, k: int = 32, seed: int = 0, max_iter: int = 20, rounds: int = 5,
                    oversample: float = 2.0, refine: int = 5) -> DataFrame:
    """k-means over all points: seeds by oversampling rounds (k-means||), their weighted reclustering, then full rounds
    until no center moves, ``max_iter`` at most. ``size`` is the number of points that made the center.

    A code that loses all its points keeps its center, with size 0. There are fewer than ``k`` codes if there are fewer
    distinct candidates. The candidates, about ``rounds * oversample * k`` vectors, must fit the driver.
    """
    spark = points.sparkSession
    width = vector_width(points)
    if not in_one_piece(int((1 + rounds * oversample) * k), width):
        raise ValueError(f"{k} codes need more candidates than one process holds; learn them in batches")
    points = points.where("vec is not null").select("point_id", F.col("vec").cast("array<double>").alias("vec"))
    candidates = oversampled(points, k, seed, rounds, oversample)

    def counted(_batch, _least, near):
        used, n = np.unique(near, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(n.astype(np.int64))], names=["c", "n"])

    counts = _scan_candidates(points.select("vec"), candidates, "c long, n long", counted).groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(len(candidates))
    weights[counts.column("c").to_numpy()] = counts.column("n").to_numpy()
    book = Codebook(reclustered(candidates, weights, k, refine), np.zeros(min(k, len(candidates))))
    for _ in range(max_iter):
        # as clusters that add up from nothing
        moved = _add_points(points, Codebook(book.centers, np.ones(len(book.sizes))), len(book.sizes), balanced=False)
        same = np.array_equal(moved.centers, book.centers)
        book = moved
        if same:
            break
    return book.frame(spark)
