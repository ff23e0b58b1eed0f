"""Arrow batches to numpy and back, and the exact sum of many partial vectors per key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` values, as a (rows, width) matrix; any other list is an error."""
    lengths = column.value_lengths()
    if lengths.null_count:
        raise ValueError("there is a null where a vector should be")
    lengths = lengths.to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(lengths != width)
    if len(wrong):
        raise ValueError(f"a vector has {lengths[wrong[0]]} values instead of {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(-1, width)


def finite_matrix(column, width: int) -> np.ndarray:
    """As ``matrix``, for data vectors: values that are null, infinite or not a number are an error."""
    values = matrix(column, width)
    if not np.isfinite(values).all():
        raise ValueError("a vector has values that are null, infinite or not numbers")
    return values


def lists(values: np.ndarray) -> pa.Array:
    """A (rows, width) matrix as a list column."""
    n, width = values.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))


def lowest(values: np.ndarray, n: int) -> np.ndarray:
    """Per row, the places of the n lowest values in order, equal values by place, values that are no number last."""
    if n == 1 and values.shape[1]:
        return np.where(np.isnan(values), np.inf, values).argmin(axis=1)[:, None]
    return np.argsort(values, axis=1, kind="stable")[:, :n]


def add_vectors(partials: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Sum equally long vectors per key. The inputs are partial sums, one per task and key.

    Each shuffled part streams its batches into one running sum per key it owns, so memory is
    bounded by the keys of the part, not by the number of partials.
    """
    schema = partials.select(key, vector).schema
    type_of_key = schema[key].dataType

    def task(batches):
        where: dict = {}
        total = np.zeros((0, width))
        for batch in batches:
            ids, inverse = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            slots = np.array([where.setdefault(i, len(where)) for i in ids.tolist()], dtype=np.int64)
            if len(where) > len(total):
                grown = np.zeros((max(2 * len(total), len(where)), width))
                grown[: len(total)] = total
                total = grown
            np.add.at(total, slots[inverse], matrix(batch.column(1), width))
        if where:
            from pyspark.sql.pandas.types import to_arrow_type

            keys = pa.array(list(where), type=to_arrow_type(type_of_key))
            yield pa.RecordBatch.from_arrays([keys, lists(total[: len(where)])], names=[key, vector])

    return partials.select(key, vector).repartition(key).mapInArrow(task, schema)
