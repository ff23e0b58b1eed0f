"""Drop lines that an earlier document already has.

Hashes of the lines are range-partitioned and sorted by (hash, document, position), so a task sees the occurrences of
a line one after the other and needs to remember only the first document of the current line. The range bounds
include document and position: a line that is a third of all lines spreads over as many tasks as its share deserves.
A task cannot know the first document of a line that began in an earlier task, so it marks those rows as pending and
reports its two edges; the edges (two rows a task) settle them. What comes back is a bitmap for each document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tagweave.llm.common import IS_SPACE, blocks, flat, keyed, keyed_rows, partitions, stage
from tagweave.llm.common import line_digests as line_hashes

MIN_KEY = 10
DROP, PENDING, TAIL, HEAD = 0, 1, 2, 3
FOUND = "pid int, kind int, k1 long, k2 long, doc_id long, h long, n_lines int, pos int"


def _line_rows(min_key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            buf, offsets = flat(block.column("text"))
            cuts = np.flatnonzero(buf == 10)
            doc_of_cut = np.searchsorted(offsets[1:], cuts, side="right")
            n_lines = np.bincount(doc_of_cut, minlength=block.num_rows) + 1
            doc = np.repeat(np.arange(block.num_rows), n_lines)
            first = np.cumsum(n_lines) - n_lines
            pos = np.arange(len(doc)) - first[doc]
            after = np.arange(len(cuts)) + doc_of_cut  # the line that each line feed ends
            starts, ends = offsets[:-1][doc], offsets[1:][doc]
            ends[after], starts[after + 1] = cuts, cuts + 1
            solid = np.flatnonzero(~IS_SPACE[buf])
            lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
            letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
            some = hi > lo
            doc, pos, starts, ends = doc[some], pos[some], solid[lo[some]], solid[hi[some] - 1] + 1
            long = letters[ends] - letters[starts] >= min_key
            doc, pos, starts, ends = doc[long], pos[long], starts[long], ends[long]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    *map(pa.array, line_hashes(buf, starts, ends, lower=True)),
                    block.column("doc_id").take(at),
                    block.column("h").take(at),
                    pa.array(n_lines[doc].astype(np.int32)),
                    pa.array(pos.astype(np.int32)),
                ],
                ["k1", "k2", "doc_id", "h", "n_lines", "pos"],
            )

    return run


def line_keys(base: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """A row for each line whose key has ``min_key`` code points or more: 128 bits of hash, document, position."""
    given = base.where("doc_id is not null").select("doc_id", "h", "text")
    return given.mapInArrow(_line_rows(min_key), "k1 long, k2 long, doc_id long, h long, n_lines int, pos int")


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: those to drop, those that hang on an earlier task, and the task's edges."""
    names = ["pid", "kind", "k1", "k2", "doc_id", "h", "n_lines", "pos"]
    key, first, head, pid = None, None, None, 0

    def rows(part: dict[str, np.ndarray], chosen: np.ndarray, kind: int) -> pa.RecordBatch:
        n = len(chosen)
        cols = [np.full(n, pid, np.int32), np.full(n, kind, np.int32), *(part[c][chosen] for c in names[2:])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def edge(kind: int, at: tuple[int, int], doc: int) -> pa.RecordBatch:
        row = {"pid": pid, "kind": kind, "k1": at[0], "k2": at[1], "doc_id": doc, "h": 0, "n_lines": 0, "pos": 0}
        return rows({c: np.array([row[c]], np.int32 if c in ("n_lines", "pos") else np.int64) for c in names[2:]}, np.array([0]), kind)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        k1, k2, doc = part["k1"], part["k2"], part["doc_id"]
        pid = int(part["pid"][0])
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = key != (k1[0], k2[0])
        if head is None:
            head = (int(k1[0]), int(k2[0]))
            yield edge(HEAD, head, int(doc[0]))
        begins = np.maximum.accumulate(np.where(new, np.arange(len(k1)), -1))
        firsts = np.where(begins >= 0, doc[begins], doc[0] if first is None else first)
        later = doc != firsts
        waits = (k1 == head[0]) & (k2 == head[1]) & ~later
        yield rows(part, np.flatnonzero(later), DROP)
        yield rows(part, np.flatnonzero(waits), PENDING)
        key, first = (k1[-1], k2[-1]), firsts[-1]
    if head is not None:
        yield edge(TAIL, (int(key[0]), int(key[1])), int(first))


def dropped_lines(base: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``doc_id, h, n_lines, pos`` of every line to drop."""
    spark = base.sparkSession
    order = ["k1", "k2", "doc_id", "h", "pos"]
    ranged = line_keys(base, min_key).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = stage(ranged.withColumn("pid", F.spark_partition_id()).mapInArrow(_first_occurrences, FOUND), "lines")
    carry, settled = None, []
    edges = found.where(F.col("kind") >= TAIL).orderBy("pid", F.desc("kind")).collect()  # two rows a task
    for top, bottom in zip(edges[::2], edges[1::2], strict=True):
        goes_on = carry is not None and carry[:2] == (top.k1, top.k2)
        if goes_on:
            settled.append((top.pid, carry[2]))
        whole = (top.k1, top.k2) == (bottom.k1, bottom.k2)
        carry = (bottom.k1, bottom.k2, carry[2] if goes_on and whole else bottom.doc_id)
    before = spark.createDataFrame(settled, "pid int, first_doc long")  # a row a task at most
    late = found.where(F.col("kind") == PENDING).join(F.broadcast(before), "pid").where("doc_id <> first_doc")
    cols = ["doc_id", "h", "n_lines", "pos"]
    return found.where(F.col("kind") == DROP).select(cols).union(late.select(cols))


def _bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


@F.pandas_udf(BinaryType())
def _bitmaps(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([_bitmap(n, np.asarray(gone)) for n, gone in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _kept_texts(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    return pd.Series([kept_text(t, k)[0] for t, k in zip(texts, keeps, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``doc_id, h, n_lines, n_dropped, keep`` of every document that loses lines.

    A line's key is the line without surrounding white space and with A-Z as a-z. Lines whose key has fewer than
    ``min_key`` code points stay; of the others, those stay that lie in the smallest ``doc_id`` with that key.
    ``keep`` is a zlib-compressed bitmap, first line in the highest bit; ``h`` is ``common.keyed``'s hash of the text.
    Rows with a null ``doc_id`` neither lose lines nor make others lose them. A null text is one empty line. Rows with
    the same ``doc_id`` count as one document: they never make each other lose lines; equal rows get one bitmap.
    """
    dropped = dropped_lines(keyed(docs, doc_id, text), min_key)
    by_doc = dropped.groupBy("doc_id", "h").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return by_doc.select("doc_id", "h", "n_lines", F.size("gone").alias("n_dropped"), _bitmaps("n_lines", "gone").alias("keep"))


def kept_text(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that the bitmap drops, the number of its lines and of those dropped."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    kept = [line for line, bit in zip(lines, bits, strict=True) if bit]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``doc_id, text, h, row, keep`` of every row; ``row`` has the columns of ``docs``."""
    whole = keyed_rows(docs, doc_id, text)
    maps = keep_bitmaps(docs, doc_id, text, min_key).withColumnRenamed("doc_id", "b_id").withColumnRenamed("h", "b_h")
    joined = whole.join(maps.hint("shuffle_hash"), (F.col("doc_id") == F.col("b_id")) & (F.col("h") == F.col("b_h")), "left")
    return joined.select("doc_id", "text", "h", "row", "keep")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", 8 << 20):
        texts, keeps = block.column("text").to_pylist(), block.column("keep").to_pylist()
        out = [kept_text(t, k) for t, k in zip(texts, keeps, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"),
                pa.array([n for _, n, _ in out], pa.int64()),
                pa.array([n for _, _, n in out], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in out], pa.string()),
            ],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    joined = with_bitmaps(docs.select("doc_id", "text")).select("doc_id", "text", "keep")
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; every row and column stays."""
    joined = with_bitmaps(docs, doc_id, text, min_key)
    short = F.when(F.col("keep").isNull(), F.col(f"row.`{text}`")).otherwise(_kept_texts("text", "keep"))
    return joined.select(*[short.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), judged AS (
  SELECT *, length(k) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY k) AS gone FROM keys
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
