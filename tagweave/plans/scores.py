"""Scores of rows for columns, and each row's best columns without looking at all of them.

A score is the inner product of a row's expected weights with a column's expected components, so it is at most the
product of their norms. The columns are taken in order of falling norm, block by block: once a row's k-th best score is
above its norm times the norm of the next column, nothing that is left can come in, and the row is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.ordering import global_rank
from tagweave.functions.vectors import lists, matrix
from tagweave.session import MODEL_CELLS, remove_path, stage

#: Columns that rows are scored for before it is asked which rows are done; scores held at once.
COLUMNS, SCORES = 256, 4_000_000
#: Rounding that the bound allows for.
SLACK = 1 + 1e-9


class Ordered:
    """The columns in a total order, in blocks of which one at a time is on the driver."""

    def __init__(self, beta: DataFrame, order: list, size: int | None):
        self.kind = beta.schema["d"].dataType
        whole = isinstance(self.kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        # equal scores go to the lowest id, so ids have numbers in their order
        self.names = None if whole else stage(global_rank(beta.select("d"), ["d"], "n", "ids"), "ids")
        numbered = beta.select("d", "e").withColumn("n", F.col("d").cast("long")) if whole else beta.select("d", "e").join(self.names, "d")
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
        self.count, width = beta.agg(F.count("*"), F.max(F.size("e"))).first()
        if not self.count:
            raise ValueError("there are no components to score with")
        self.width, self.size = width, size or max(1, MODEL_CELLS // width)
        placed = numbered.select("n", "e", norm.alias("norm"))
        self.blocks = -(-self.count // self.size)
        self.table, self.order = placed, order
        if self.blocks > 1:
            ranked = global_rank(placed, order, "place", "columns").withColumn("block", F.expr(f"place div {self.size}"))
            self.table = stage(ranked, "columns", partition="block")
            heads = self.table.where(F.col("place") % self.size == 0).select("block", "norm").collect()  # a row a block
            self.first = [norm for _, norm in sorted(map(tuple, heads))]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """Of each block numbers, components and norms of its columns, and the norm of the first column after it (-1: none)."""
        for block in range(self.blocks):
            part = self.table if self.blocks == 1 else self.table.where(F.col("block") == block).orderBy("place")
            rows = part.orderBy(*self.order).select("n", "e", "norm").toArrow()
            after = self.first[block + 1] if block + 1 < self.blocks else -1.0
            yield rows.column("n").to_numpy(), matrix(rows.column("e").combine_chunks(), self.width), rows.column("norm").to_numpy(), after

    def drop(self) -> None:
        if self.blocks > 1:
            remove_path(self.table.sparkSession, self.table.staged_path)

    def named(self, table: DataFrame) -> DataFrame:
        """Puts ``d`` in the place of ``n``."""
        if self.names is None:
            return table.withColumn("n", F.col("n").cast(self.kind)).withColumnRenamed("n", "d")
        return table.join(self.names, "n").drop("n")


def best_columns(x: np.ndarray, best: np.ndarray, who: np.ndarray, read: np.ndarray, block: tuple) -> np.ndarray:
    """Goes on with the rows ``x`` over a block's columns; changes their best scores, whose they are, and how many columns
    were read. Says which rows are done."""
    numbers, components, norms, after = block
    own = np.sqrt((x * x).sum(axis=1)) * SLACK
    top = best.shape[1]
    open_rows = np.arange(len(x))
    for lo in range(0, len(numbers), COLUMNS):
        open_rows = open_rows[best[open_rows, -1] <= own[open_rows] * norms[lo]]
        if not len(open_rows):
            break
        ids = numbers[lo : lo + COLUMNS]
        step = max(1, SCORES // (len(ids) + top))
        for at in range(0, len(open_rows), step):
            rows = open_rows[at : at + step]
            scores = x[rows] @ components[lo : lo + COLUMNS].T
            read[rows] += len(ids)
            better = scores.max(axis=1) >= best[rows, -1]
            rows, scores = rows[better], scores[better]
            all_scores = np.hstack([best[rows], scores])
            all_ids = np.hstack([who[rows], np.broadcast_to(ids, scores.shape)])
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :top]
            best[rows], who[rows] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)
    return best[:, -1] > own * after


def _search(shared, top: int, names: list[str]):
    def task(batches):
        block = shared.value
        width = block[1].shape[1]
        for batch in batches:
            x = matrix(batch.column("e"), width)
            fresh = "best" not in batch.schema.names
            best = np.full((len(x), top), -np.inf) if fresh else matrix(batch.column("best"), top).copy()
            who = np.full((len(x), top), -1, np.int64) if fresh else batch.column("who").flatten().to_numpy().reshape(-1, top).copy()
            read = np.zeros(len(x), np.int64) if fresh else batch.column("read").to_numpy().copy()
            done = best_columns(x, best, who, read, block)
            places = pa.array(np.arange(len(x) + 1, dtype=np.int32) * top)
            arrays = [batch.column("i"), batch.column("e"), lists(best), pa.ListArray.from_arrays(places, pa.array(who.reshape(-1))),
                      pa.array(read), pa.array(done)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return task


def top_columns(theta: DataFrame, beta: DataFrame, top: int, block: int | None = None) -> DataFrame:
    """``i, read, hits``: of each row its ``top`` columns with the highest score, best first (equal scores: the lowest id
    first), as an array of ``d, score``, and for how many columns it was scored.

    Exact. With several blocks, rows that are done leave the search, which ends when all are.
    """
    columns = Ordered(beta, [F.desc("norm"), F.col("n")], block)
    spark, top = theta.sparkSession, min(top, columns.count)
    schema = T.StructType([theta.schema["i"]])
    vector = T.ArrayType(T.DoubleType())
    for name, kind in (("e", vector), ("best", vector), ("who", T.ArrayType(T.LongType())), ("read", T.LongType()), ("done", T.BooleanType())):
        schema.add(name, kind)
    rest, found, before = theta.select("i", "e"), None, None
    for n, piece in enumerate(columns):
        shared = spark.sparkContext.broadcast(piece)
        searched = rest.mapInArrow(_search(shared, top, schema.names), schema)
        last = n + 1 == columns.blocks
        if last and found is None and columns.blocks == 1:
            found = searched
            break
        searched = stage(searched, "search")
        shared.destroy()
        if before is not None:
            remove_path(spark, before)
        done = searched if last else stage(searched.where("done"), "best")
        found = done if found is None else found.unionByName(done)
        rest, before = searched.where("not done").select("i", "e", "best", "who", "read"), searched.staged_path
        if last or rest.isEmpty():
            break
    columns.drop()
    pairs = F.arrays_zip(F.col("who").alias("n"), F.col("best").alias("score"))
    if columns.names is None:
        hit = F.transform(pairs, lambda p: F.struct(p["n"].cast(columns.kind).alias("d"), p["score"].alias("score")))
        return found.select("i", "read", hit.alias("hits"))
    spread = columns.named(found.select("i", "read", F.posexplode(pairs).alias("at", "p")).select("i", "read", "at", "p.n", "p.score"))
    hits = F.array_sort(F.collect_list(F.struct("at", "d", "score")))
    return spread.groupBy("i").agg(F.first("read").alias("read"), F.transform(hits, lambda h: F.struct(h["d"].alias("d"), h["score"].alias("score"))).alias("hits"))


def _score_all(shared, names: list[str]):
    def task(batches):
        numbers, components, *_ = shared.value
        step = max(1, SCORES // len(numbers))
        for batch in batches:
            x = matrix(batch.column("e"), components.shape[1])
            for lo in range(0, len(x), step):
                scores = x[lo : lo + step] @ components.T
                owner = pa.array(np.repeat(np.arange(lo, lo + len(scores)), len(numbers)))
                yield pa.RecordBatch.from_arrays([batch.column("i").take(owner), pa.array(np.tile(numbers, len(scores))), pa.array(scores.reshape(-1))], names=names)

    return task


def score_tags(theta: DataFrame, beta: DataFrame, top: int | None = None, block: int | None = None) -> DataFrame:
    """Expected rate ``(i, d, score)`` of every row for the columns in ``beta``, or only of each row's ``top`` best.

    ``block`` is the number of columns that are held at once; by default as many as ``MODEL_CELLS`` values allow. The
    scores of several blocks are written one block after the other, so a single one is with the driver and the tasks.
    """
    if top is not None:
        hits = top_columns(theta, beta, top, block)
        return hits.select("i", F.inline("hits"))
    columns = Ordered(beta, [F.col("n")], block)
    spark = theta.sparkSession
    schema = T.StructType([theta.schema["i"]]).add("n", "long").add("score", "double")
    out = None
    for piece in columns:
        shared = spark.sparkContext.broadcast(piece)
        scored = theta.select("i", "e").mapInArrow(_score_all(shared, schema.names), schema)
        if columns.blocks > 1:
            scored = stage(scored, "scores")
            shared.destroy()
        out = scored if out is None else out.unionByName(scored)
    columns.drop()
    return columns.named(out).select("i", "d", "score")
