"""Stochastic Poisson factorization: mini-batches, natural gradient steps and full passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.mathx import hash_order
from tagweave.functions.ordering import global_rank, slices
from tagweave.plans import factors, grid
from tagweave.plans.components import Beta, Columns
from tagweave.plans.factors import PMFParams
from tagweave.session import remove_path, stage


def _shuffled(rows: DataFrame, params: PMFParams, n_pass: int) -> tuple[DataFrame, list[str]]:
    """Rows with the columns that order them in a pass: by id, or by a hash of seed, pass and id."""
    if not params.shuffle:
        return rows, ["i"]
    order = hash_order(f"{params.random_state}:{n_pass}", F.col("i"))
    return rows.withColumn("_order", order), ["_order", "i"]


def minibatch_split(rows: DataFrame, params: PMFParams, n_pass: int = 0) -> DataFrame:
    """Add ``batch``: consecutive slices of ``batch_size`` rows in shuffled (or id) order; the last may be short."""
    ranked = global_rank(*_shuffled(rows, params, n_pass), "position", "shuffled")
    return ranked.withColumn("batch", F.expr(f"position div {int(params.batch_size)}")).drop("position", "_order")


def pmf_partial_fit(counts: DataFrame, rows: DataFrame, beta: DataFrame, scale: float, rho: float,
                    params: PMFParams, block: int | None = None) -> tuple[DataFrame, float]:
    """One natural gradient step on one mini-batch; returns the new components and the stochastic bound."""
    columns = Columns(beta, params, block)
    cells = grid.build(counts, rows, columns, params)
    moved = Beta.of(beta, columns, params)
    bound = grid.gradient_step(cells, moved, rho, scale, params)
    cells.drop()
    return moved.frame(), bound


@dataclass
class OnlineModel:
    params: PMFParams
    beta: DataFrame
    history: list[tuple[int, int, float]]

    def history_frame(self) -> DataFrame:
        return self.beta.sparkSession.createDataFrame(self.history, "pass int, batch int, bound double")


def online_pmf_fit(counts: DataFrame, rows: DataFrame, cols: DataFrame, params: PMFParams,
                   est_total: int | None = None, block: int | None = None) -> OnlineModel:
    """``n_pass`` passes over shuffled mini-batches. The step number restarts at 1 in each pass, and the
    scale divides by the nominal batch size, also for a short last batch."""
    columns = Columns(cols, params, block)
    n_rows = rows.count()
    whole = grid.build(counts, rows, columns, params)
    table = stage(whole.packed(), "rows")  # with the first weights: every batch starts its rows from the same draws
    whole.drop()
    beta = Beta.of(factors.init_shapes_rates(cols.select("d"), "d", "beta", params), columns, params)
    scale = float(n_rows if est_total is None else est_total) / params.batch_size
    history = []
    for n_pass in range(params.n_pass):
        # sorted by batch once a pass, so that a batch reads only its own part of the files
        n_batches, batch_at = slices(*_shuffled(table, params, n_pass), params.batch_size, "batches")
        for n in range(n_batches):
            batch = grid.Grid.of_rows(batch_at(n), columns, min(params.batch_size, n_rows), params)
            bound = grid.gradient_step(batch, beta, factors.learning_rate(params, n + 1), scale, params)
            batch.drop()
            history.append((n_pass, n, float(bound)))
        remove_path(counts.sparkSession, batch_at.staged_path)
    remove_path(counts.sparkSession, table.staged_path)
    return OnlineModel(params, beta.frame(), history)
