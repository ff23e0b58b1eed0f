"""Poisson factorization as relational steps: sparse counts joined with two factor tables.

Counts are rows ``(i, d, x)`` with ``x > 0``. A factor table holds, per id, arrays of length K:
``g`` (shape), ``r`` (rate), ``e`` (expectation) and ``el`` (expected log). Every step is a join of
counts with factors and one aggregation; nothing is gathered but K totals and single numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.mathx import digamma, gamma_pairs, log_gamma
from tagweave.functions.ordering import hot_keys, salted_join
from tagweave.session import MODEL_CELLS


@dataclass(frozen=True)
class PMFParams:
    """Settings of batch and stochastic fitting."""

    n_components: int = 100
    max_iter: int = 100
    tol: float = 5e-4
    smoothness: float = 100.0
    random_state: int = 0
    a: float = 0.1
    b: float = 0.1
    batch_size: int = 10
    n_pass: int = 10
    shuffle: bool = True
    t0: float = 1.0
    kappa: float = 0.6


def gamma_expectations(factors: DataFrame) -> DataFrame:
    """Add ``e = g / r`` and ``el = digamma(g) - ln r`` to a table of Gamma shapes and rates."""
    return factors.withColumn("e", F.zip_with("g", "r", lambda g, r: g / r)).withColumn(
        "el", F.zip_with("g", "r", lambda g, r: digamma(g) - F.ln(r))
    )


def init_shapes_rates(ids: DataFrame, key: str, role: str, params: PMFParams) -> DataFrame:
    drawn = ids.withColumn(
        "_gr", gamma_pairs(params.random_state, role, F.col(key), params.n_components, params.smoothness)
    )
    return drawn.withColumn("g", F.col("_gr.g")).withColumn("r", F.col("_gr.r")).drop("_gr")


def init_factors(ids: DataFrame, key: str, role: str, params: PMFParams) -> DataFrame:
    """Random starting factors per id, the same for any partitioning of ``ids``."""
    return gamma_expectations(init_shapes_rates(ids.select(key), key, role, params))


def set_components(shapes_rates: DataFrame, max_d: int | None = None) -> DataFrame:
    """Components from given (d, g, r); ``max_d`` keeps the columns below it (codewords without tags)."""
    if max_d is not None:
        shapes_rates = shapes_rates.where(F.col("d") < max_d)
    return gamma_expectations(shapes_rates.select("d", "g", "r"))


def array_total(column: str) -> Column:
    return F.sum(F.aggregate(column, F.lit(0.0), lambda s, v: s + v))


def factor_totals(factors: DataFrame, n_components: int) -> list[float]:
    """Sum of the expectations over all ids, per component."""
    row = factors.agg(*[F.sum(F.col("e")[k]) for k in range(n_components)]).first()
    return [float(v) for v in row]


def scale_c(theta: DataFrame, n_components: int) -> DataFrame:
    """One row ``c``: the inverse mean of the expected weights."""
    return theta.agg((F.lit(float(n_components)) * F.count("*") / array_total("e")).alias("c"))


def _exp_logs(factors: DataFrame, key: str, name: str) -> DataFrame:
    return factors.select(key, F.transform("el", F.exp).alias(name))


def with_factors(counts: DataFrame, theta: DataFrame, beta: DataFrame, params: PMFParams,
                 hot_rows: DataFrame | None = None, hot_cols: DataFrame | None = None,
                 n_cols: int | None = None) -> DataFrame:
    """Counts with ``t`` and ``b`` (exponentiated expected logs) and their product sum ``rate``.

    Components are broadcast only when their counted size is within the model limit; otherwise
    both joins shuffle, with hot rows and hot columns cut into pieces.
    """
    n_cols = beta.count() if n_cols is None else n_cols
    right_b = _exp_logs(beta, "d", "b")
    joined = salted_join(counts, _exp_logs(theta, "i", "t"), "i", "d", hot_rows)
    if n_cols * params.n_components <= MODEL_CELLS:
        joined = joined.join(F.broadcast(right_b), "d")
    else:
        joined = salted_join(joined, right_b, "d", "i", hot_cols)
    rate = F.col("t")[0] * F.col("b")[0]
    for k in range(1, params.n_components):
        rate = rate + F.col("t")[k] * F.col("b")[k]
    return joined.withColumn("rate", rate)


def rate_at_nonzeros(counts: DataFrame, theta: DataFrame, beta: DataFrame, params: PMFParams, **hot) -> DataFrame:
    return with_factors(counts, theta, beta, params, **hot).select("i", "d", "x", "rate")


def _statistic(joined: DataFrame, key: str, n_components: int, data: bool = False) -> DataFrame:
    """Per key and component: sum of x * share of the component in the rate (K map-side combined sums).

    With ``data`` also the key's part of the data term, which needs the same rates.
    """
    shared = joined.withColumn("q", F.col("x") / F.col("rate"))
    sums = [F.sum(F.col("q") * F.col("t")[k] * F.col("b")[k]).alias(f"s{k}") for k in range(n_components)]
    extra = [F.sum(F.col("x") * F.ln("rate")).alias("data")] if data else []
    array = F.array(*[F.col(f"s{k}") for k in range(n_components)]).alias("s")
    return shared.groupBy(key).agg(*sums, *extra).select(key, array, *(["data"] if data else []))


def _add_prior(ids: DataFrame, key: str, stat: DataFrame, prior: float, rates: list[float]) -> DataFrame:
    """Shapes prior + statistic for every id, with or without counts, and one shared rate row."""
    filled = ids.select(key).join(stat, key, "left")
    none = F.array(*[F.lit(0.0)] * len(rates))
    shapes = F.transform(F.coalesce("s", none), lambda s: s + F.lit(prior))
    data = ["data"] if "data" in stat.columns else []
    return filled.select(key, shapes.alias("g"), F.array(*[F.lit(v) for v in rates]).alias("r"), *data)


def update_theta(counts: DataFrame, rows: DataFrame, theta: DataFrame, beta: DataFrame, c: float,
                 params: PMFParams, beta_totals: list[float] | None = None, data: bool = False, **hot) -> DataFrame:
    """New weights. With ``data`` each row also has its part of the data term at the old weights."""
    joined = with_factors(counts, theta, beta, params, **hot)
    totals = factor_totals(beta, params.n_components) if beta_totals is None else beta_totals
    stat = _statistic(joined, "i", params.n_components, data)
    return gamma_expectations(_add_prior(rows, "i", stat, params.a, [params.a * c + v for v in totals]))


def update_beta(counts: DataFrame, cols: DataFrame, theta: DataFrame, beta: DataFrame,
                params: PMFParams, theta_totals: list[float] | None = None, **hot) -> DataFrame:
    joined = with_factors(counts, theta, beta, params, **hot)
    totals = factor_totals(theta, params.n_components) if theta_totals is None else theta_totals
    stat = _statistic(joined, "d", params.n_components)
    return gamma_expectations(_add_prior(cols, "d", stat, params.b, [params.b + v for v in totals]))


def blend_beta(counts: DataFrame, theta: DataFrame, beta: DataFrame, rho: float, scale: float,
               params: PMFParams, theta_totals: list[float], **hot) -> DataFrame:
    """One natural gradient step: old components blended with the scaled mini-batch statistic."""
    joined = with_factors(counts, theta, beta, params, **hot)
    stat = _statistic(joined, "d", params.n_components)
    stat = stat.withColumn("s", F.transform("s", lambda s: s * F.lit(float(scale))))
    rates = [params.b + scale * v for v in theta_totals]
    fresh = _add_prior(beta, "d", stat, params.b, rates).withColumnsRenamed({"g": "g1", "r": "r1"})

    def mix(old, new):
        return (1.0 - rho) * old + rho * new

    mixed = beta.select("d", "g", "r").join(fresh, "d")
    return gamma_expectations(
        mixed.select("d", F.zip_with("g", "g1", mix).alias("g"), F.zip_with("r", "r1", mix).alias("r"))
    )


def _gamma_part(prior_shape: float) -> Column:
    """The Gamma term without its prior rate, whose share is minus that rate times the total expectation."""

    def cell(total, z):
        return total + (
            (F.lit(prior_shape) - z["g"]) * z["el"] + z["g"] + log_gamma(z["g"]) - z["g"] * F.ln(z["r"])
        )

    # r * e is g
    return F.coalesce(F.sum(F.aggregate(F.arrays_zip("g", "r", "el"), F.lit(0.0), cell)), F.lit(0.0))


def gamma_term(factors: DataFrame, prior_shape: float, prior_rate: float) -> DataFrame:
    """One row ``term``: the part of the bound that compares Gamma posteriors with their prior."""
    total = F.coalesce(array_total("e"), F.lit(0.0))
    return factors.agg((_gamma_part(prior_shape) - F.lit(prior_rate) * total).alias("term"))


@dataclass(frozen=True)
class Summary:
    """All that the bound and the next step need of a factor table, from one scan."""

    n: int
    e: list[float]
    gamma: float
    data: float

    @property
    def total(self) -> float:
        return math.fsum(self.e)

    def gamma_term(self, prior_rate: float) -> float:
        return self.gamma - prior_rate * self.total


def summarize(factors: DataFrame, prior_shape: float, n_components: int) -> Summary:
    data = F.coalesce(F.sum("data"), F.lit(0.0)) if "data" in factors.columns else F.lit(0.0)
    sums = [F.sum(F.col("e")[k]) for k in range(n_components)]
    row = factors.agg(F.count("*"), _gamma_part(prior_shape), data, *sums).first()
    return Summary(row[0], [float(v) for v in row[3:]], float(row[1]), float(row[2]))


def data_term(counts: DataFrame, theta: DataFrame, beta: DataFrame, params: PMFParams, **hot) -> float:
    rates = rate_at_nonzeros(counts, theta, beta, params, **hot)
    return rates.agg(F.coalesce(F.sum(F.col("x") * F.ln("rate")), F.lit(0.0))).first()[0]


def assemble_bound(data: float, theta: Summary, beta: Summary, c: float, params: PMFParams,
                   scale: float = 1.0) -> float:
    """The bound from its parts, without the constants in x.

    The total of all expected rates factorizes by component. With ``scale`` other than one this is
    the stochastic bound: everything but the component term counts ``scale`` times.
    """
    expected = math.fsum(t * b for t, b in zip(theta.e, beta.e))
    priors = params.n_components * theta.n * params.a * math.log(c)
    local = data - expected + theta.gamma_term(params.a * c) + priors
    return scale * local + beta.gamma_term(params.b)


def elbo(counts: DataFrame, theta: DataFrame, beta: DataFrame, c: float, params: PMFParams,
         scale: float = 1.0, **hot) -> float:
    data = data_term(counts, theta, beta, params, **hot)
    k = params.n_components
    return assemble_bound(data, summarize(theta, params.a, k), summarize(beta, params.b, k), c, params, scale)


def learning_rate(params: PMFParams, step: int | None = None, rho: float | None = None) -> float:
    """Robbins-Monro rate of a step, unless a rate is given outright."""
    if rho is not None:
        return float(rho)
    if step is None:
        raise ValueError("a learning rate needs a step number or a given rate")
    return (step + params.t0) ** (-params.kappa)


def hot_ids(counts: DataFrame, beta: DataFrame) -> dict:
    """Hot rows and columns of a staged count table and the number of components, found once per fit."""
    n = counts.count()
    return {"hot_rows": hot_keys(counts, "i", n), "hot_cols": hot_keys(counts, "d", n), "n_cols": beta.count()}
