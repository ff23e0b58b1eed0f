"""Global positions, running aggregates and joins that stay balanced when one key is hot."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.session import ROWS_PER_TASK, stage

MAX_HOT_KEYS = 1024


def _sorted_table(df: DataFrame, order: list, label: str) -> DataFrame:
    """Range-sort once and fix the result as a table: ``_part`` is the sorted part, ``_at`` the place in it."""
    mark = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("_mark", mark)
    staged = stage(placed, label)
    return (
        staged.withColumn("_part", F.shiftright("_mark", 33))
        .withColumn("_at", F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mark")
    )


def global_rank(df: DataFrame, order: list, name: str = "position", label: str = "rank") -> DataFrame:
    """Add the 0-based position of every row in a total order, without gathering rows in one task.

    One range sort; only the row counts of the sorted parts (one row per part) meet in one place.
    """
    placed = _sorted_table(df, order, label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    ranked = placed.join(F.broadcast(starts), "_part")
    return ranked.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def slices(df: DataFrame, order: list, size: int, label: str = "slices"):
    """Consecutive slices of ``size`` rows in a total order: their number, and a function from n to slice n.

    The rows are sorted and written once. A slice is one range of the stored row marks, which the
    scan uses to skip the rest of the files; the driver only keeps the row counts of the sorted parts.
    """
    marked = stage(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()), label)
    sizes = marked.groupBy(F.shiftright("_mark", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    ends, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        ends.append((total, part))
        total += n

    def mark(position: int) -> int:
        first, part = ends[bisect.bisect_right([e[0] for e in ends], position) - 1]
        return (part << 33) + position - first

    def slice_at(n: int) -> DataFrame:
        lo, hi = mark(n * size), mark(min((n + 1) * size, total) - 1)
        return marked.where(F.col("_mark").between(lo, hi)).drop("_mark")

    slice_at.staged_path = marked.staged_path  # for whoever needs no slice any more
    return -(-total // size), slice_at


def running(df: DataFrame, keys: list[str], order: list, sums: dict[str, str] | None = None,
            maxima: dict[str, str] | None = None, label: str = "running") -> DataFrame:
    """Running sums and maxima per key, inclusive, in two levels.

    The input is range-sorted by (keys, order), so a hot key spreads over many parts. Each part
    runs on its own; what a part receives from earlier parts of the same key is one small row.
    ``sums`` and ``maxima`` map new names to value columns.
    """
    sums, maxima = sums or {}, maxima or {}
    placed = _sorted_table(df, [*keys, *order], label)
    totals = placed.groupBy("_part", *keys).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"_t_{n}") for n, v in maxima.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_part",
        *keys,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
    )
    inside = (
        Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for n, v in sums.items():
        placed = placed.withColumn(f"_i_{n}", F.sum(v).over(inside))
    for n, v in maxima.items():
        placed = placed.withColumn(f"_i_{n}", F.max(v).over(inside))
    if not keys:
        carried = F.broadcast(carried)
    out = placed.join(carried, ["_part", *keys])
    for n in sums:
        out = out.withColumn(n, F.col(f"_i_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in maxima:
        # greatest skips nulls
        out = out.withColumn(n, F.greatest(F.col(f"_i_{n}"), F.col(f"_c_{n}")))
    scratch = [f"_{kind}_{n}" for n in [*sums, *maxima] for kind in "ic"]
    return out.drop("_part", "_at", *scratch)


def hot_keys(df: DataFrame, key: str, n_rows: int | None = None) -> DataFrame | None:
    """Keys that hold more than 1/1024 of all rows, with the number of pieces to cut them into.

    At most 1024 keys can qualify, so the answer may always be broadcast. None when the input is
    too small for any key to be hot.
    """
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= ROWS_PER_TASK:
        return None
    share = n_rows // MAX_HOT_KEYS
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    return stage(counts.select(key, F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_pieces")), "hot")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of many left rows to one right row per ``key``; hot keys are cut by a hash of ``spread``."""
    if hot is None:
        return left.join(right, key)
    hot = F.broadcast(hot)
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    cut = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), pieces).cast("int"))
        .drop("_pieces")
    )
    copies = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return cut.join(copies, [key, "_salt"]).drop("_salt")
