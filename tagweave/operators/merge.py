"""Offsets and flat values merged by position, in one ordered pass.

Positions are cut into parts of equal width. Each part gets the values and the offsets in it, and one carried offset: that
of the song that owns the part's first position. Sorted by position, a value belongs to the offset last seen; nothing is
repeated for each value or each chunk that a song touches, and values are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stream: carried offsets come first, then offsets, then values at the same position.
CARRIED, OFFSET, VALUE = 0, 1, 2


def _ordered(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """``part, pos, kind, song_idx, start, value``: each part's rows in order, with its carried offset before them."""
    spark = flat.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = 8 * tasks  # several a task, so that the hash deals them evenly
    starts = offsets.select(F.col("song_idx").cast("bigint").alias("song_idx"), F.col("start").cast("bigint").alias("start"))
    last = starts.agg(F.max("start")).first()[0] or 0
    width = last // parts + 1  # values beyond the last offset make parts of their own
    part = lambda pos: F.floor(pos / F.lit(width)).cast("bigint")
    none = F.lit(None).cast(flat.schema["value"].dataType)
    values = flat.select(
        part(F.col("pos")).alias("part"), F.col("pos").cast("bigint").alias("pos"), F.lit(VALUE).alias("kind"),
        F.lit(None).cast("bigint").alias("song_idx"), F.lit(None).cast("bigint").alias("start"), "value",
    )
    own = starts.select(part(F.col("start")).alias("part"), F.col("start").alias("pos"), F.lit(OFFSET).alias("kind"), "song_idx", "start", none.alias("value"))
    # one row a part and a window over these: of several songs at an offset the last can have values
    ends = starts.groupBy(part(F.col("start")).alias("part")).agg(F.max(F.struct("start", "song_idx")).alias("end"))
    top = flat.agg(F.max(F.col("pos").cast("bigint"))).first()[0] or 0
    every = spark.range(top // width + 1).select(F.col("id").alias("part")).join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", F.last("end", ignorenulls=True).over(before).alias("end")).where("end is not null")
    carried = carried.select(
        "part", (F.col("part") * width).alias("pos"), F.lit(CARRIED).alias("kind"), "end.song_idx", "end.start", none.alias("value")
    )
    rows = values.unionByName(own).unionByName(carried)
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "pos", "kind", "song_idx")


def _owned(batch: pa.RecordBatch, held: tuple) -> tuple[np.ndarray, ...]:
    """Of each row of a sorted batch the number of its run (a song in a part), and of each run song, start and whether it
    goes on from before. ``held`` is the part, song and start that the last batch ended in (song -1: none)."""
    part = batch.column("part").to_numpy()
    kind = batch.column("kind").to_numpy()
    heads = kind != VALUE
    turns = np.diff(part, prepend=held[0]) != 0
    new = heads | turns
    new[0] = True
    run = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    song = np.where(heads[at], batch.column("song_idx").fill_null(-1).to_numpy()[at], -1)
    start = np.where(heads[at], batch.column("start").fill_null(0).to_numpy()[at], 0)
    if not heads[0] and not turns[0]:
        song[0], start[0] = held[1], held[2]
    return run, song, start, part, kind


def slice_long(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """Give every flat row ``(pos, value)`` its song and its place in the song: ``(song_idx, j, value)``.

    A song owns the positions from its offset up to the next offset, the last song all that remain.
    """
    schema = T.StructType([T.StructField("song_idx", T.LongType()), T.StructField("j", T.LongType()), flat.schema["value"]])

    def task(batches):
        held = (-1, -1, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            run, song, start, part, kind = _owned(batch, held)
            mine = np.flatnonzero((kind == VALUE) & (song[run] >= 0))
            held = (int(part[-1]), int(song[-1]), int(start[-1]))
            j = batch.column("pos").to_numpy()[mine] - start[run[mine]]
            yield pa.RecordBatch.from_arrays([pa.array(song[run[mine]]), pa.array(j), batch.column("value").take(pa.array(mine))], names=schema.names)

    return _ordered(offsets, flat).mapInArrow(task, schema)


def pieces(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """``song_idx, j, value, whole``: arrays of neighbouring values of a song, the first at place ``j``; an empty one for a song
    without values. ``whole`` songs have no other piece; the others lie at an edge of a part or of a batch."""
    schema = T.StructType([T.StructField("song_idx", T.LongType()), T.StructField("j", T.LongType()),
                           T.StructField("value", T.ArrayType(flat.schema["value"].dataType)), T.StructField("whole", T.BooleanType())])

    def task(batches):
        held = (-1, -1, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            run, song, start, part, kind = _owned(batch, held)
            held = (int(part[-1]), int(song[-1]), int(start[-1]))
            n = np.bincount(run, kind == VALUE, len(song)).astype(np.int64)
            first = np.flatnonzero(np.diff(run, prepend=-1))
            opened = kind[first] == OFFSET
            edge = np.zeros(len(song), bool)
            edge[0] = edge[-1] = True
            edge |= ~opened  # goes on from an earlier part
            edge[:-1] |= part[first[1:]] != part[first[:-1]]  # may go on in the next part
            mine = np.flatnonzero(kind == VALUE)
            kept = song >= 0
            mine = mine[kept[run[mine]]]
            kept &= opened | (n > 0)  # a carried offset without values tells nothing
            j = batch.column("pos").to_numpy()[np.minimum(first + (kind[first] != VALUE), batch.num_rows - 1)] - start
            j[n == 0] = 0
            bounds = np.concatenate([[0], np.cumsum(n[kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), batch.column("value").take(pa.array(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(song[kept]), pa.array(j[kept]), lists, pa.array(~edge[kept])], names=schema.names)

    return _ordered(offsets, flat).mapInArrow(task, schema)
