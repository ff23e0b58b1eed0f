"""Ragged arrays: one flat table for all songs, cut by start offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.ordering import running
from tagweave.operators import merge
from tagweave.operators.merge import slice_long
from tagweave.session import stage

def ragged_chunks(offsets: DataFrame, flat: DataFrame, size: int = 1 << 20) -> DataFrame:
    """All songs in pieces ``(song_idx, chunk, value array)`` of at most ``size`` values, for songs of any length."""
    rows = slice_long(offsets, flat).withColumn("chunk", F.expr(f"j div {int(size)}"))
    return rows.groupBy("song_idx", "chunk").agg(_in_order().alias("value"))


def _in_order():
    return F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"])


def ragged_slice(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """All songs with their array ``(song_idx, value array)``; an empty slice gives an empty array.

    The arrays are made while offsets and values are merged; only songs at the edges of parts and batches are put
    together from pieces. The array of a song is one value and has to fit in a task; ``ragged_chunks`` and ``slice_long`` have
    no such bound.
    """
    found = stage(merge.pieces(offsets, flat), "pieces")
    parts = found.where("not whole").groupBy("song_idx").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("parts"))
    joined = parts.select("song_idx", F.flatten(F.transform("parts", lambda p: p["value"])).alias("value"))
    return found.where("whole").select("song_idx", "value").unionByName(joined)


def slice_one(offsets: DataFrame, flat: DataFrame, song_idx: int = 0) -> DataFrame:
    """The array of one song. Both bounds become literals, so the flat scan skips other songs."""
    own = F.col("song_idx") == song_idx
    bounds = offsets.agg(F.min(F.when(own, F.col("start"))).alias("start"), F.min(F.when(F.col("song_idx") > song_idx, F.col("start"))).alias("stop")).first()
    if bounds.start is None:
        raise IndexError(f"no song at {song_idx}")
    rows = flat.where(F.col("pos") >= bounds.start)
    if bounds.stop is not None:
        rows = rows.where(F.col("pos") < bounds.stop)
    arrays = rows.select((F.col("pos") - F.lit(bounds.start)).alias("j"), "value").agg(_in_order().alias("value"))
    return arrays.select(F.lit(song_idx).cast("bigint").alias("song_idx"), "value")


def explode_segments(tracks: DataFrame, key: str, column: str) -> DataFrame:
    """One row per segment ``(key, seg, value)`` of an array column."""
    return tracks.select(key, F.posexplode(column).alias("seg", "value"))


def zip_terms(tracks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Parallel arrays (term, frequency, weight) as one row per term."""
    return tracks.select(key, F.inline(F.arrays_zip(*columns)))


def offsets_of(lengths: DataFrame, key: str, length: str) -> DataFrame:
    """Start offsets ``(key, start)`` from per-key lengths, in key order: what an archive stores as idx."""
    ends = running(lengths.select(key, length), [], [key], sums={"stop": length}, label="offsets")
    return ends.select(key, (F.col("stop") - F.col(length)).alias("start"))
