"""Vector quantization: nearest codewords, indicator rows and codeword histograms.

Any table with the codebook columns can be the codebook, whatever learned it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import finite_matrix, lowest, matrix
from tagweave.operators.codebook import SCORE_CELLS, minibatch_kmeans, minibatch_kmeans_partial_fit, size_of
from tagweave.operators.shards import Blocks
from tagweave.session import MODEL_CELLS, remove_path, stage


def with_half_norms(codebook: DataFrame) -> DataFrame:
    """Refresh half the squared norm of every center, the part of a distance that belongs to the code."""
    squares = F.aggregate("center", F.lit(0.0), lambda s, v: s + v * v)
    return codebook.withColumn("half_norm", F.lit(0.5) * squares)


def vq_fit(points: DataFrame, clusterer: Callable[[DataFrame], DataFrame] | None = None,
           n_atoms: int = 32) -> DataFrame:
    """Learn a codebook with any function from points to a codebook; mini-batch k-means by default."""
    learn = clusterer or (lambda p: minibatch_kmeans(p, n_atoms))
    return with_half_norms(learn(points))


def vq_partial_fit(points: DataFrame, codebook: DataFrame | None,
                   clusterer: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
                   n_atoms: int = 32) -> DataFrame:
    """Add a batch of points to a codebook with an incremental clusterer; mini-batch k-means by default."""
    add = clusterer or (lambda p, c: minibatch_kmeans_partial_fit(p, c, n_atoms))
    return with_half_norms(add(points, codebook))


def _nearest(points: DataFrame, codes: np.ndarray, centers: np.ndarray, halves: np.ndarray, q: int) -> DataFrame:
    """Keep the q best of the codes seen so far and those given; ``hits`` is ordered by (score, code)."""
    bc = points.sparkSession.sparkContext.broadcast((codes, centers, halves))
    width = centers.shape[1]
    schema = T.StructType([f for f in points.schema.fields if f.name not in ("hits", "scores")])
    schema = schema.add("hits", T.ArrayType(T.IntegerType())).add("scores", T.ArrayType(T.DoubleType()))
    kept = [f.name for f in schema.fields if f.name not in ("hits", "scores")]
    resumed = "hits" in points.columns

    def task(batches):
        ids, matrix_c, half = bc.value
        step = max(1, SCORE_CELLS // len(ids))
        for batch in batches:
            x = finite_matrix(batch.column("vec"), width)
            hits, scores = [], []
            for lo in range(0, len(x), step):
                part = half[None, :] - x[lo : lo + step] @ matrix_c.T
                part_ids = np.broadcast_to(ids, part.shape)
                if resumed:
                    n_old = len(batch.column("hits")[0])
                    old = matrix(batch.column("scores"), n_old)[lo : lo + step]
                    old_ids = matrix(batch.column("hits"), n_old)[lo : lo + step].astype(np.int32)
                    part, part_ids = np.hstack([old, part]), np.hstack([old_ids, part_ids])
                # blocks come in code order, so of equal scores the lowest code is first
                best = lowest(part, q)
                hits.append(np.take_along_axis(part_ids, best, axis=1))
                scores.append(np.take_along_axis(part, best, axis=1))
            n_hits = hits[0].shape[1] if hits else 0
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * n_hits)
            flat_ids = np.concatenate(hits).ravel().astype(np.int32) if hits else np.zeros(0, np.int32)
            flat_scores = np.concatenate(scores).ravel() if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept]
                + [pa.ListArray.from_arrays(offsets, pa.array(flat_ids)),
                   pa.ListArray.from_arrays(offsets, pa.array(flat_scores))],
                names=schema.names,
            )

    return points.mapInArrow(task, schema)


def nearest_codes(points: DataFrame, codebook: DataFrame, n_quantizers: int = 1) -> DataFrame:
    """Points with ``hits``, their closest codes by ``half_norm - x . center``, ties by the lowest code.

    Encoding is a map: no join and no shuffle. Points without a vector are left out; a vector of another width is an error. A codebook above the model limit is handled in
    blocks of codes; the best codes so far travel with the points from block to block.
    """
    k, width = size_of(codebook)
    if not k:
        raise ValueError("the codebook is empty")
    out = points.where("vec is not null")
    blocks, before = Blocks.of(codebook.select("code", "center", "half_norm"), k, max(1, MODEL_CELLS // width)), None
    for n, table in enumerate(blocks):
        out = _nearest(
            out,
            table.column("code").to_numpy().astype(np.int32),
            matrix(table.column("center").combine_chunks(), width),
            table.column("half_norm").to_numpy(),
            min(n_quantizers, k),
        )
        if n + 1 < blocks.count:
            out = stage(out, "encoded")
            if before is not None:
                remove_path(points.sparkSession, before)
            before = out.staged_path
    blocks.drop()
    return out.drop("scores")


def vq_encode_hard(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """Every point with its nearest ``code``; other columns of the points are kept."""
    return nearest_codes(points, codebook).withColumn("code", F.col("hits")[0]).drop("hits", "vec")


def vq_encode_soft(points: DataFrame, codebook: DataFrame, n_quantizers: int) -> DataFrame:
    """One row per point and close code, with its ``rank`` from 1."""
    hits = nearest_codes(points, codebook, n_quantizers).drop("vec")
    others = [c for c in hits.columns if c != "hits"]
    ranked = hits.select(*others, F.posexplode("hits").alias("rank", "code"))
    return ranked.withColumn("rank", F.col("rank") + 1)


def vq_indicator_sparse(points: DataFrame, codebook: DataFrame, n_quantizers: int = 1) -> DataFrame:
    """Indicator rows ``(point, code)`` of the true cells only."""
    return vq_encode_soft(points, codebook, n_quantizers).drop("rank")


def membership(hits: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.array_contains(hits, j))


def vq_indicator_dense(points: DataFrame, codebook: DataFrame, n_quantizers: int = 1) -> DataFrame:
    """One boolean array of length k per point."""
    k = codebook.count()
    hits = nearest_codes(points, codebook, n_quantizers).drop("vec")
    return hits.withColumn("indicator", membership(F.col("hits"), k)).drop("hits")


def vq_histogram(encoded: DataFrame, track: str = "track") -> DataFrame:
    """Codeword counts per track; counted map-side first, so long tracks cost no more than short ones."""
    return encoded.groupBy(track, "code").agg(F.count("*").alias("n"))
