"""The component table in blocks of columns, of which one at a time is on the driver and in the tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.mathx import digamma_np, log_gamma_np
from tagweave.functions.ordering import global_rank
from tagweave.functions.vectors import lists, matrix
from tagweave.plans import factors as fa
from tagweave.plans.factors import PMFParams
from tagweave.session import MODEL_CELLS, remove_path, stage


@dataclass
class Components:
    """Component shapes and rates of a block as (columns, K) arrays, in the order of the columns' numbers."""

    g: np.ndarray
    r: np.ndarray
    e: np.ndarray = field(init=False)
    el: np.ndarray = field(init=False)

    def __post_init__(self):
        self.e = self.g / self.r
        self.el = digamma_np(self.g) - np.log(self.r)

    def gamma_term(self, b: float) -> float:
        return float(
            np.sum((b - self.g) * self.el - (b - self.r) * self.e + log_gamma_np(self.g) - self.g * np.log(self.r))
        )

    def table(self, first: int) -> pa.Table:
        numbers = pa.array(np.arange(first, first + len(self.g), dtype=np.int64))
        return pa.table({"n": numbers, "g": lists(self.g), "r": lists(self.r)})


class Columns:
    """Which number each column id has: the id itself if the ids are 0 .. D-1, else its place in their order."""

    def __init__(self, cols: DataFrame, params: PMFParams, block: int | None = None):
        kind = cols.schema["d"].dataType
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        ends = [F.min("d"), F.max("d")] if whole else []
        self.count, named, different, *rest = cols.agg(F.count("*"), F.count("d"), F.count_distinct("d"), *ends).first()
        if not self.count == named == different:
            raise ValueError("the columns have null or repeated ids")
        self.spark, self.kind = cols.sparkSession, kind
        dense = not self.count or rest == [0, self.count - 1]
        self.numbers = None if dense else stage(global_rank(cols.select("d"), ["d"], "n", "columns"), "columns")
        self.size = block or max(1, MODEL_CELLS // params.n_components)
        self.blocks = max(1, -(-self.count // self.size))

    def number(self, table: DataFrame) -> DataFrame:
        """Adds ``n``; null where the id is none of the columns."""
        if self.numbers is not None:
            return table.join(self.numbers, "d", "left")
        return table.withColumn("n", F.when(F.col("d").between(0, self.count - 1), F.col("d").cast("long")))

    def name(self, table: DataFrame) -> DataFrame:
        """Puts ``d`` in the place of ``n``."""
        if self.numbers is None:
            return table.withColumn("n", F.col("n").cast(self.kind)).withColumnRenamed("n", "d")
        return table.join(self.numbers, "n").select("d", *[c for c in table.columns if c != "n"])

    def width(self, block: int) -> int:
        return min(self.size, self.count - block * self.size)


class Beta:
    """Components of all columns. A single block is kept; of several, each is a table of its own that is read when needed."""

    def __init__(self, columns: Columns, params: PMFParams):
        self.columns, self.params = columns, params
        self.kept: Components | None = None
        self.tables: list[DataFrame | None] = [None] * columns.blocks
        self.totals = np.zeros((columns.blocks, params.n_components))
        self.gammas = [0.0] * columns.blocks

    @staticmethod
    def of(shapes_rates: DataFrame, columns: Columns, params: PMFParams) -> Beta:
        """From a table ``d, g, r`` of all columns."""
        beta = Beta(columns, params)
        numbered = columns.number(shapes_rates.select("d", "g", "r")).drop("d")
        if columns.blocks > 1:
            numbered = stage(numbered.withColumn("block", F.expr(f"n div {columns.size}")), "components", partition="block")
        for block in range(columns.blocks):
            part = numbered.where(F.col("block") == block).drop("block") if columns.blocks > 1 else numbered
            beta.put(block, beta._gathered(part, block))
        if columns.blocks > 1:
            remove_path(columns.spark, numbered.staged_path)
        return beta

    def _gathered(self, table: DataFrame, block: int) -> Components:
        rows = table.select("n", "g", "r").toArrow().sort_by("n")
        if len(rows) != self.columns.width(block):
            raise ValueError("there are not as many components as columns")
        parts = [matrix(rows.column(name).combine_chunks(), self.params.n_components) for name in ("g", "r")]
        return Components(*parts)

    def get(self, block: int) -> Components:
        return self.kept if self.columns.blocks == 1 else self._gathered(self.tables[block], block)

    def put(self, block: int, components: Components) -> None:
        """Replaces a block."""
        self.totals[block] = components.e.sum(axis=0)
        self.gammas[block] = components.gamma_term(self.params.b)
        if self.columns.blocks == 1:
            self.kept = components
            return
        before = self.tables[block]
        made = self.columns.spark.createDataFrame(components.table(block * self.columns.size))
        self.tables[block] = stage(made, "components")
        if before is not None:
            remove_path(self.columns.spark, before.staged_path)

    def total(self) -> np.ndarray:
        return self.totals.sum(axis=0)

    def gamma_term(self) -> float:
        return float(sum(self.gammas))

    def frame(self) -> DataFrame:
        """The table ``d, g, r, e, el``."""
        if self.columns.blocks == 1:
            table, c = self.kept.table(0), self.kept
            table = table.append_column("e", lists(c.e)).append_column("el", lists(c.el))
            return self.columns.name(self.columns.spark.createDataFrame(table)).select("d", "g", "r", "e", "el")
        shapes = self.columns.spark.read.parquet(*[t.staged_path for t in self.tables])
        return fa.gamma_expectations(self.columns.name(shapes).select("d", "g", "r"))
