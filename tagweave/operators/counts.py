"""Sparse count matrices with explicit row and column dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.ordering import global_rank

def count_matrix(events: DataFrame, row: str, col: str, value: Column | None = None) -> DataFrame:
    """Counts ``(i, d, x)`` summed over duplicates, map-side first; ``x`` defaults to the number of events."""
    amount = F.count("*") if value is None else F.sum(value)
    cells = events.groupBy(F.col(row).alias("i"), F.col(col).alias("d")).agg(amount.cast("double").alias("x"))
    return cells.where("x <> 0")


def row_ids(items: DataFrame, key: str) -> DataFrame:
    """The row dimension ``(i)``, with rows that have no counts."""
    return items.select(F.col(key).alias("i")).distinct()


def number_labels(labels: DataFrame, label: str) -> DataFrame:
    """Dense column ids ``(d, label)`` from 0 in byte order of the distinct labels."""
    distinct = labels.select(F.col(label).alias("label")).distinct()
    return global_rank(distinct, ["label"], "d", "labels").select(F.col("d").cast("int").alias("d"), "label")


def joint_matrix(codes: DataFrame, bags: DataFrame, n_codes: int) -> DataFrame:
    """Codeword counts and tag counts side by side: tag t becomes column ``n_codes + t``.

    A code outside 0 .. n_codes - 1 is an error: it would lie on a column of a tag. So is a tag id below 0.
    """

    def checked(column: str, right: Column, what: str) -> Column:
        return F.when(right, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{what} is out of range: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))))

    code = checked("code", F.col("code").between(0, n_codes - 1), "a code")
    left = codes.select(F.col("track").alias("i"), code.alias("d"), F.col("n").cast("double").alias("x"))
    right = bags.select(
        F.col("track").alias("i"), (checked("tag_id", F.col("tag_id") >= 0, "a tag id") + F.lit(n_codes)).alias("d"), F.col("n").cast("double").alias("x")
    )
    return left.unionByName(right)
