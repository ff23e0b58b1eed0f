"""Iterative fitting over counts that are stored once, in a grid of row buckets and column blocks.

``cells`` holds the counts, packed by row and column block ``(i, cols, xs)``: a table with a folder for each block, bucketed
by row. It is never written again. ``state`` holds the weights' shapes ``(i, g)``, a table bucketed alike, so that the two
meet without a shuffle; a step writes a new state, whose size has nothing to do with the counts.

Column blocks are gone through one at a time: the block's components are broadcast, a row's share of its new shape is
added to what the state carries, and the last block completes the row. The component statistic comes from partial sums of
the tasks, of the block's columns only. With a single block the row is complete at once, and the same scan delivers the
statistic; the data part of the bound needs the rates of the next weight update, so the next scan delivers it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.mathx import digamma_np, log_gamma_np
from tagweave.functions.vectors import add_vectors, lists, matrix
from tagweave.plans import factors as fa
from tagweave.plans.components import Beta, Columns, Components
from tagweave.plans.factors import PMFParams
from tagweave.session import new_path, remove_path

# Doubles in the largest temporary of a task: 32 MB; in a bucket of the state, which a task holds whole: 16 MB.
CHUNK_CELLS, BUCKET_CELLS = 4_000_000, 2_000_000
# Weights in a bucket of a mini-batch: fewer are not worth another task.
ROW_CELLS = 50_000
TOTALS = -1


def stopped(bound: float, previous: float, tol: float) -> bool:
    """Relative gain below ``tol``, a loss included; the first bound has nothing to compare with."""
    return not math.isinf(previous) and (bound - previous) / abs(previous) < tol


# --- tables -------------------------------------------------------------------------------------------------------


class Bucketed:
    """A table in the shared folder that is bucketed by row id, known to the catalog as long as it is needed."""

    def __init__(self, made: DataFrame, label: str, buckets: int, partition: str | None = None):
        self.spark = made.sparkSession
        self.name, self.path = f"{label}_{uuid.uuid4().hex}", new_path(self.spark, label)
        writer = made.write.format("parquet").option("path", self.path).bucketBy(buckets, "i")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name)

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def release(self) -> str:
        """Forget the bucketing; the files stay at the path that is returned."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.path

    def drop(self) -> None:
        remove_path(self.spark, self.release())


@dataclass
class Grid:
    """Counts stored once. ``started`` has the rows with their first weights ``i, g, r``."""

    cells: Bucketed
    columns: Columns
    buckets: int
    started: DataFrame

    def block(self, block: int) -> DataFrame:
        return self.cells.frame().where(F.col("block") == block).select("i", "cols", "xs")

    def start(self) -> Bucketed:
        """The first state, written once: drawing it costs more than reading it back."""
        empty = F.lit(None).cast("array<double>")
        state = self.started.select("i", "g", "r", empty.alias("acc"), F.lit(None).cast("int").alias("d"), empty.alias("s"))
        return Bucketed(state, "state", self.buckets)

    def packed(self) -> DataFrame:
        """One row for each row id, with its first weights and its ``parts``: the cells of every block."""
        parts = self.cells.frame().groupBy("i").agg(F.collect_list(F.struct("block", "cols", "xs", "named")).alias("parts"))
        return self.started.join(parts, "i")

    @staticmethod
    def of_rows(packed: DataFrame, columns: Columns, n: int, params: PMFParams) -> Grid:
        """A grid of some rows of another one, ``n`` at most."""
        cores = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(cores, max(1, n * params.n_components // ROW_CELLS))
        own = packed.repartition(buckets, "i")
        cells = own.select("i", F.inline("parts"))
        return Grid(Bucketed(cells, "cells", buckets, "block"), columns, buckets, own.select("i", "g", "r"))

    def drop(self) -> None:
        self.cells.drop()


def build(counts: DataFrame, rows: DataFrame, columns: Columns, params: PMFParams) -> Grid:
    """Packs counts ``(i, d, x)`` by row and column block; one shuffle brings cells and ids together and checks them.

    Ids of counts that ``rows`` or the columns do not name, and null or repeated row ids, are errors. ``counts`` holds one
    row per (i, d), so a packed row is no longer than a block of columns.
    """
    n = rows.count()
    # Parts by what a task holds and works on; a packed byte means far more work than a shuffled one, so parts are not merged.
    buckets = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * params.n_components // BUCKET_CELLS))
    numbered = columns.number(counts.where("x <> 0").select("i", "d", "x"))
    cell = F.struct((F.col("n") % columns.size).cast("int").alias("d"), F.col("x").cast("double").alias("x"))
    known = F.col("n").isNotNull()
    block = F.coalesce(F.expr(f"n div {columns.size}"), F.lit(0)).cast("int")
    cells = numbered.select("i", block.alias("block"), F.when(known, cell).alias("c"), F.lit(0).alias("named"), (~known).cast("int").alias("bad"))
    ids = rows.select("i", F.lit(0).alias("block"), F.lit(None).cast(cells.schema["c"].dataType).alias("c"), F.lit(1).alias("named"), F.lit(0).alias("bad"))
    met = cells.unionByName(ids).repartition(buckets, "i").groupBy("i", "block")
    packed = met.agg(F.collect_list("c").alias("c"), F.sum("named").alias("named"), F.sum("bad").alias("bad"))
    packed = packed.select("i", "block", F.col("c.d").alias("cols"), F.col("c.x").alias("xs"), "named", "bad")
    started = fa.init_shapes_rates(rows.select("i").repartition(buckets, "i"), "i", "theta", params)
    grid = Grid(Bucketed(packed, "cells", buckets, "block"), columns, buckets, started)
    by_row = grid.cells.frame().groupBy("i").agg(F.sum("named").alias("named"), F.sum("bad").alias("bad"))
    repeated = F.col("i").isNull() | (F.col("named") > 1)
    found = by_row.agg(F.sum("bad"), F.count_if(repeated & (F.col("named") > 0)), F.count_if(F.col("named") == 0)).first()
    if any(found[k] for k in range(3)):
        grid.drop()
        if found[1]:
            raise ValueError("the rows have null or repeated ids")
        raise ValueError(f"the counts have {'columns' if found[0] else 'rows'} that the dimensions do not have")
    return grid


# --- one scan -----------------------------------------------------------------------------------------------------


@dataclass
class Sums:
    """What a scan reports: totals over all rows, and the component statistic if asked for."""

    n: int
    data: float
    weights: float
    e: np.ndarray
    stat: np.ndarray | None


@dataclass
class Weights:
    """Weights: the state table, the shared rate row (for rows that carry none of their own), the scale, and totals."""

    state: Bucketed
    rate: np.ndarray | None
    c: float
    sums: Sums | None = None


def share(spark: SparkSession, components: Components) -> Broadcast:
    """Exponentiated expected logs of a block for the tasks; whoever asks for them destroys them after use."""
    return spark.sparkContext.broadcast(np.exp(components.el))


def _segment_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lengths), values.shape[1]))
    filled = lengths > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, starts[filled], axis=0)
    return out


def _row_chunks(lengths: np.ndarray, width: int):
    """Cut a batch into runs of rows whose temporaries stay small."""
    cells = np.cumsum((lengths + 1) * width)
    lo = 0
    while lo < len(lengths):
        base = cells[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cells, base + CHUNK_CELLS, side="right")))
        yield lo, hi
        lo = hi


def scan(cells: DataFrame, state: DataFrame, shared: Broadcast, params: PMFParams, rate: np.ndarray | None,
         new_rate: np.ndarray | None, finish: bool, statistic: bool) -> DataFrame:
    """One pass over a column block's cells and the state, with the components ``shared`` by ``share``.

    ``rate`` is the shared rate row of the incoming weights. With ``new_rate`` the weights are moved: their new shapes are
    added up in ``acc``, and complete if this is the last block (``finish``). Without it they stay, and no state comes out.
    Beside the state come, as rows with a column id, the partial sums of each task.
    """
    k = params.n_components
    move = new_rate is not None
    a = params.a
    n_cols = len(shared.value)
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("i", state.schema["i"].dataType)])
    for name, kind in (("g", vector), ("r", vector), ("acc", vector), ("d", T.IntegerType()), ("s", vector)):
        schema.add(name, kind)
    # The state of a bucket is what a task holds; its cells stream past. Rows without cells in the block come at the end.
    # Merging small buckets would leave too few tasks for the work on them.
    met = cells.join(state.select("i", "g", "r", "acc").hint("shuffle_hash"), "i", "right")

    def task(batches):
        b = shared.value
        column_sums = np.zeros((n_cols, k)) if statistic else None
        totals = np.zeros(k + 3)
        kind = None
        doubles = pa.list_(pa.float64())
        for batch in batches:
            m = batch.num_rows
            if m == 0:
                continue
            ids, cols, xs = batch.column("i"), batch.column("cols"), batch.column("xs")
            kind = ids.type
            d = cols.flatten().to_numpy(zero_copy_only=False)
            x = xs.flatten().to_numpy(zero_copy_only=False)
            lengths = cols.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            g = matrix(batch.column("g"), k)
            own = batch.column("r")
            r = np.broadcast_to(rate, g.shape) if own.null_count == m else matrix(own, k)
            before = batch.column("acc")
            acc = np.zeros(g.shape) if before.null_count == m else matrix(before, k)
            out = np.empty_like(g)
            for lo, hi in _row_chunks(lengths, k):
                part = slice(ends[lo] - lengths[lo], ends[hi - 1])
                dd, xx, ll = d[part], x[part], lengths[lo:hi]
                row = np.repeat(np.arange(hi - lo), ll)
                starts = np.cumsum(ll) - ll
                now, r_now = g[lo:hi], r[lo:hi]
                el = digamma_np(now) - np.log(r_now)
                w = np.exp(el)[row] * b[dd]
                total = w.sum(axis=1)
                totals[k + 1] += float(xx @ np.log(total))
                if move:
                    out[lo:hi] = acc[lo:hi] + _segment_sums(w * (xx / total)[:, None], starts, ll)
                    if finish:
                        out[lo:hi] += a
                        now, r_now = out[lo:hi], np.broadcast_to(new_rate, (hi - lo, k))
                        el = digamma_np(now) - np.log(r_now)
                        if statistic:
                            w = np.exp(el)[row] * b[dd]
                            total = w.sum(axis=1)
                if statistic and len(dd):
                    w *= (xx / total)[:, None]
                    order = np.argsort(dd, kind="stable")
                    sorted_d = dd[order]
                    cuts = np.flatnonzero(np.r_[True, sorted_d[1:] != sorted_d[:-1]])
                    column_sums[sorted_d[cuts]] += np.add.reduceat(w[order], cuts, axis=0)
                e = now / r_now
                totals[:k] += e.sum(axis=0)
                totals[k] += float(np.sum((a - now) * el + now + log_gamma_np(now) - now * np.log(r_now)))
            totals[k + 2] += m
            if move:
                none, no_column = pa.nulls(m, doubles), pa.nulls(m, pa.int32())
                kept = [lists(out), none, none] if finish else [batch.column("g"), own, lists(out)]
                yield pa.RecordBatch.from_arrays([ids, *kept, no_column, none], names=schema.names)
        if kind is None:
            return
        sums = [(np.full(1, TOTALS, dtype=np.int32), np.r_[totals].reshape(1, -1))]
        if statistic:
            touched = np.flatnonzero(column_sums.any(axis=1)).astype(np.int32)
            padded = np.zeros((len(touched), k + 3))
            padded[:, :k] = column_sums[touched]
            sums.append((touched, padded))
        for d_ids, values in sums:
            m = len(d_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), *(pa.nulls(m, doubles) for _ in range(3)), pa.array(d_ids), lists(values)], names=schema.names
            )

    return met.select("i", "cols", "xs", "g", "r", "acc").mapInArrow(task, schema)


def read_sums(scanned: DataFrame, width: int, params: PMFParams, statistic: bool) -> Sums:
    """Add up the partial sums of all tasks; at most one row for each column of the block, and one, reach the driver."""
    k = params.n_components
    table = add_vectors(scanned.where("d is not null"), "d", "s", k + 3).toArrow()
    ids = table.column("d").to_numpy()
    values = matrix(table.column("s").combine_chunks(), k + 3) if len(ids) else np.zeros((0, k + 3))
    totals = values[ids == TOTALS].sum(axis=0)
    stat = None
    if statistic:
        stat = np.zeros((width, k))
        stat[ids[ids != TOTALS]] = values[ids != TOTALS, :k]
    return Sums(int(round(totals[k + 2])), float(totals[k + 1]), float(totals[k]), totals[:k], stat)


# --- steps --------------------------------------------------------------------------------------------------------


def rows_of(state: Bucketed) -> DataFrame:
    return state.frame().where("d is null")


def move(grid: Grid, weights: Weights, beta: Beta, params: PMFParams, statistic: bool, keep: bool) -> Weights:
    """New weights, with the data part at the old ones in their sums. Of a single block the statistic comes along if asked for."""
    rate = params.a * weights.c + beta.total()
    state, data, last = weights.state, 0.0, grid.columns.blocks - 1
    for block in range(last + 1):
        shared = share(state.spark, beta.get(block))
        along = statistic and last == 0
        moved = scan(grid.block(block), rows_of(state), shared, params, weights.rate, rate, block == last, along)
        moved = Bucketed(moved, "state", grid.buckets)
        shared.destroy()
        sums = read_sums(moved.frame(), grid.columns.width(block), params, along)
        data += sums.data
        if state is not weights.state or not keep:
            state.drop()
        state = moved
    sums.data = data
    return Weights(state, rate, sums.n * params.n_components / float(sums.e.sum()), sums)


def measure(grid: Grid, weights: Weights, beta: Beta, params: PMFParams, statistic: bool) -> Iterator[tuple[int, Sums]]:
    """For each block a scan that leaves the weights alone: data part and, if asked for, the statistic of its columns."""
    for block in range(grid.columns.blocks):
        shared = share(weights.state.spark, beta.get(block))
        scanned = scan(grid.block(block), rows_of(weights.state), shared, params, weights.rate, None, True, statistic)
        yield block, read_sums(scanned, grid.columns.width(block), params, statistic)
        shared.destroy()


def data_part(grid: Grid, weights: Weights, beta: Beta, params: PMFParams) -> float:
    return sum(sums.data for _, sums in measure(grid, weights, beta, params, statistic=False))


def statistics(grid: Grid, weights: Weights, beta: Beta, params: PMFParams) -> Iterator[tuple[int, np.ndarray]]:
    """Block by block the component statistic at the weights; a block may be replaced once its statistic is there."""
    if weights.sums.stat is not None:
        yield 0, weights.sums.stat
    else:
        yield from ((block, sums.stat) for block, sums in measure(grid, weights, beta, params, statistic=True))


def local_bound(data: float, weights: Weights, beta: Beta, params: PMFParams) -> float:
    """The bound without the component term."""
    a, k, sums, c = params.a, params.n_components, weights.sums, weights.c
    return data - float(sums.e @ beta.total()) + sums.weights - a * c * float(sums.e.sum()) + k * sums.n * a * math.log(c)


def run(grid: Grid, beta: Beta, params: PMFParams, learn_beta: bool, last_bound: bool = True,
        last_statistic: bool = False) -> tuple[Weights, list[float]]:
    """Alternate weight and (optionally) component updates; ``beta`` is changed in place.

    Returns weights and bounds. With ``last_statistic`` the scan of the last allowed step also reports the component
    statistic at the final weights, if there is a single block.
    """
    k = params.n_components
    state = grid.start()
    ratio = F.aggregate(F.zip_with("g", "r", lambda g, r: g / r), F.lit(0.0), lambda s, v: s + v)
    n, total = state.frame().agg(F.count("*"), F.sum(ratio)).first()
    weights = Weights(state, None, n * k / total)
    bounds, previous, rest = [], -math.inf, None
    for step in range(params.max_iter + 1):
        last = step == params.max_iter
        if last and not last_bound:
            break
        if last:  # only the bound of the last update is still missing
            moved, data = None, data_part(grid, weights, beta, params)
        else:
            moved = move(grid, weights, beta, params, learn_beta or (last_statistic and step == params.max_iter - 1), keep=True)
            data = moved.sums.data
        if rest is not None:
            bounds.append(data + rest)
            if last or stopped(bounds[-1], previous, params.tol):
                if moved is not None:
                    moved.state.drop()
                break
            previous = bounds[-1]
        weights.state.drop()
        weights = moved
        if learn_beta:
            for block, stat in statistics(grid, weights, beta, params):
                beta.put(block, Components(params.b + stat, np.broadcast_to(params.b + weights.sums.e, stat.shape).copy()))
        rest = local_bound(0.0, weights, beta, params) + beta.gamma_term()
    return weights, bounds


def gradient_step(grid: Grid, beta: Beta, rho: float, scale: float, params: PMFParams) -> float:
    """Fold a mini-batch in and move the components in place; returns the stochastic bound after the move."""
    weights, _ = run(grid, beta, params, learn_beta=False, last_bound=False, last_statistic=True)
    for block, stat in statistics(grid, weights, beta, params):
        old = beta.get(block)
        fresh_r = np.broadcast_to(params.b + scale * weights.sums.e, old.r.shape)
        beta.put(block, Components((1 - rho) * old.g + rho * (params.b + scale * stat), (1 - rho) * old.r + rho * fresh_r))
    bound = scale * local_bound(data_part(grid, weights, beta, params), weights, beta, params) + beta.gamma_term()
    weights.state.drop()
    return bound
