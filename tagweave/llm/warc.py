"""WARC archives: writing pages as records, and reading records back by the chain of their lengths.

A record says how long its payload is, so each record names its successor's offset, and the true records are those that
the chain from the beginning of the file reaches. Payloads may hold anything, also whole records. Tasks therefore emit
a candidate, with its successor, wherever the magic stands, and pointer jumping decides: each round doubles the distance that
every candidate's pointer spans and marks what the marked ones point to, so a file of n records takes log2(n) rounds,
however its blocks are spread over tasks. Candidates inside payloads are never reached.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import discard, remove_path, small_batches, stage
from tagweave.session import new_path

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n"
RECORD_END = "\r\n\r\n"

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
#: Records of an archive file at most, so that files stay small enough to be read as one row.
FILE_RECORDS = 1000
#: Rows of decisions up to which they are broadcast; beyond, the join shuffles.
SMALL = 100_000


def _headers(kind: Column, page: Column, digest: Column, size: Column, refers: Column, length: Column) -> Column:
    """The head of a record, up to and with the empty line."""
    lines = [
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), size),
        F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers, F.lit(">"))),
        F.concat(F.lit("Content-Length: "), length),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws(BREAK, *lines), F.lit(RECORD_END))


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED) -> None:
    """Write a record for every row of ``pages`` (``page_id, html``) to archive files in ``folder``.

    Of rows with equal payloads of ``least_shared`` bytes or more the one with the largest ``page_id`` (of repeated ids any
    one) carries the payload; the others are revisit records that refer to it and carry none. A null html is an empty
    payload, a null ``page_id`` is written as an empty id and never shared. Other columns are ignored.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sized = given.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    shared = sized.where((F.col("size") >= least_shared) & F.col("page_id").isNotNull()).groupBy("digest", "size")
    first = shared.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stage(first.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"), "shared")
    same = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    hint = again.hint("broadcast") if again.count() <= SMALL else again  # by checked size; else a shuffle
    known = sized.join(hint, same, "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first").cast("string"))
    body = F.when(refers.isNull(), F.col("html")).otherwise(F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = _headers(
        F.when(refers.isNull(), "response").otherwise("revisit"), text(F.col("page_id")), F.col("digest"), text(F.col("size")), refers,
        text(F.octet_length(body)),
    )
    records = known.select(F.concat(head, body).alias("value"))
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(folder)
    discard(again)


HEAD = re.compile(rb"WARC/1\.1\r\n((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n")
CANDIDATES = (
    "file string, start long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, intact boolean"
)


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whatever looks like a record, wherever it stands: its offset, its successor's, and what its head says."""
    names = ["file", "start", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        for n in range(batch.num_rows):
            data = memoryview(batch.column("content")[n].as_buffer())
            name = batch.column("path")[n].as_py()
            rows = []
            for found in HEAD.finditer(data):
                fields = dict(line.split(b": ", 1) for line in found[1].split(b"\r\n")[:-1])
                try:
                    length, size = int(fields[b"Content-Length"]), int(fields[b"WARC-Payload-Length"])
                    kind = fields[b"WARC-Type"].decode()
                    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                except (KeyError, ValueError):
                    continue
                end = found.end() + length
                if length < 0 or bytes(data[end : end + 4]) != b"\r\n\r\n":
                    continue
                intact = kind == "revisit" or hashlib.sha1(data[found.end() : end]).hexdigest() == digest
                refers = _page(fields.get(b"WARC-Refers-To"))
                rows.append((name, found.start(), end + 4, _page(fields.get(b"WARC-Record-ID")), size, digest, kind, refers, intact))
            for lo in range(0, len(rows), 10_000):
                part = list(zip(*rows[lo : lo + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates that the chain of successors reaches from offset 0 of their file, by pointer jumping.

    A pointer that leads to no candidate (the end of the file, or a break) is null from then on.
    """
    links = candidates.select("file", "start", "next")
    state = stage(links.select("file", "start", F.col("next").alias("jump"), (F.col("start") == 0).alias("sure")), "chain")
    while True:
        ends = state.select(F.col("file").alias("f"), F.col("start").alias("at"), F.col("jump").alias("far"))
        hops = state.where("sure and jump is not null").select("file", F.col("jump").alias("start"), F.lit(True).alias("hit")).distinct()
        moved = state.join(ends, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("at")), "left")
        moved = moved.select("file", "start", F.col("far").alias("jump"), "sure").join(hops, ["file", "start"], "left")
        after = stage(moved.select("file", "start", "jump", (F.col("sure") | F.coalesce("hit", F.lit(False))).alias("sure")), "chain")
        discard(state)
        state = after
        if state.where("sure and jump is not null").isEmpty():
            return state.where("sure").select("file", "start")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in ``folder``: ``CANDIDATES``' columns.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, also for revisits, as their heads say; ``intact`` tells
    whether a response's payload has its digest. An empty folder gives no rows.
    """
    small_batches(spark)  # a file by itself is a batch
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = stage(files.mapInArrow(_candidates, CANDIDATES), "candidates")
    true = reachable(found)
    return found.join(true, ["file", "start"], "left_semi")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns, from records written and read back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``. The archives are removed once their records are staged."""
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    write_archives(pages, folder)
    found = read_archives(spark, folder).where("intact")
    out = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    remove_path(spark, folder)
    return out


def base32_digest(digest: str) -> str:
    """A hexadecimal digest in the form that other WARC tools show."""
    return base64.b32encode(bytes.fromhex(digest)).decode()


ORACLE = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         coalesce(html, '') AS html
  FROM pages
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM firsts
"""
