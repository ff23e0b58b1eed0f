"""Batch Poisson factorization: fit, fold-in and tag scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.plans import factors, grid
from tagweave.plans.components import Beta, Columns
from tagweave.plans.factors import PMFParams

ATTRIBUTES = ("e", "el", "g", "r")


@dataclass
class PMFModel:
    """Fitted weights and components with the history of the bound."""

    params: PMFParams
    theta: DataFrame
    beta: DataFrame
    c: float
    bounds: list[float]


def theta_frame(weights: grid.Weights) -> DataFrame:
    """The fitted weights ``i, g, r, e, el``; they are read from their files and need no catalog any more."""
    state = weights.state.frame()
    kept = state.sparkSession.read.schema(state.schema).parquet(weights.state.release()).where("d is null")
    shared = F.array(*[F.lit(float(v)) for v in weights.rate])
    return factors.gamma_expectations(kept.select("i", "g", F.coalesce("r", shared).alias("r")))


def pmf_fit(counts: DataFrame, rows: DataFrame, cols: DataFrame, params: PMFParams, block: int | None = None) -> PMFModel:
    """Fit weights and components to counts ``(i, d, x)``; ``rows(i)`` and ``cols(d)`` name all ids.

    Counts are one row per (i, d). Ids of counts that the dimensions do not name, and repeated or null ids in the
    dimensions, are errors. ``block`` is the number of columns whose components are held at once; by default as many as
    ``MODEL_CELLS`` values allow.
    """
    columns = Columns(cols, params, block)
    cells = grid.build(counts, rows, columns, params)
    beta = Beta.of(factors.init_shapes_rates(cols.select("d"), "d", "beta", params), columns, params)
    weights, bounds = grid.run(cells, beta, params, learn_beta=True)
    cells.drop()
    return PMFModel(params, theta_frame(weights), beta.frame(), weights.c, bounds)


def pmf_transform(counts: DataFrame, rows: DataFrame, beta: DataFrame | None, params: PMFParams,
                  attr: str = "e", block: int | None = None) -> DataFrame:
    """Fold new rows in with fixed components; returns ``(i, attr)``."""
    if beta is None:
        raise ValueError("there are no components to fold in with")
    if attr not in ATTRIBUTES:
        raise ValueError(f"attr must be one of {ATTRIBUTES}")
    columns = Columns(beta, params, block)
    cells = grid.build(counts, rows, columns, params)
    weights, _ = grid.run(cells, Beta.of(beta, columns, params), params, learn_beta=False, last_bound=False)
    cells.drop()
    return theta_frame(weights).select("i", attr)
