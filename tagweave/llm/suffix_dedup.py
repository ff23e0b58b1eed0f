"""Remove every byte that lies in a long string found twice in the corpus, by suffix sorting.

One sort of all suffixes of a large corpus is no job for one machine, so the windows of 200 bytes are dealt out by
content first. A window's anchor is the least hash among its 64-byte grams; equal windows have equal anchors, wherever
they lie. Neighbouring windows with one anchor form a segment. Anchors found once are dropped: nothing in them
repeats.
Equal segments are one class, sorted once with the number of its copies, however many there are. The segments of an anchor meet in one task, which builds the Burrows-Wheeler transform and the common prefixes of
its segments column by column (``bwt``) and reports the windows whose common prefix reaches 200 bytes.

An anchor whose segments form very many different classes (a common phrase, or near copies that differ around it) is
dealt out again by the least hash of its windows' 128-byte, then 192-byte grams, and at last by the windows' own hashes:
the rounds in ``GRAMS``. In the last one an anchor is one window, so its classes are as many as lengths of runs of that
window. So no task gets all of a hot group, and nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.bwt import repeated_suffixes
from tagweave.llm.common import BASE, BLOCK_BYTES, UNBASE, blocks, discard, flat, keyed, mix, partitions, powers, random_words, span_hashes, stage

#: Bytes of a string that must not occur twice.
WINDOW = 200
#: Lengths of the grams whose least hash deals out the windows, one after the other for hot anchors.
GRAMS = (64, 128, 192, WINDOW)
#: Windows of a segment at most; longer runs are cut.
RUN = 256
#: An anchor with more classes than this is dealt out again.
HOT_CLASSES = 4096
#: Bytes of segments that are sorted at once, about, and that a task is given at most, about.
SORT_BYTES, TASK_BYTES = 2 << 20, 64 << 20
#: Bytes in a letter of a strand; divides WINDOW.
LETTER = 40

#: The bits of a ranked hash that hold the place in the block; blocks are far shorter than 2**24 bytes.
PLACE = np.uint64((1 << 24) - 1)


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchored_segments(buf: np.ndarray, offsets: np.ndarray, gram: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``text, start, n, anchor, digest, times`` of the segments of all texts: ``n`` windows from ``start`` on (in ``buf``).

    A window's anchor is its gram of least hash, the first of several. ``times`` is 2 where a segment holds its anchor
    more than once, so that its own windows may be equal.
    """
    size = len(buf) - window + 1
    if size <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(random_words(51, 256)[buf] * powers(BASE, len(buf)), out=sums[1:])
    back = powers(UNBASE, len(buf) + 1)
    grams = (sums[gram:] - sums[:-gram]) * back[: len(buf) - gram + 1]
    ranked = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
    where = (least_of_runs(ranked, window - gram + 1) & PLACE).astype(np.int64)
    least = grams[where]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:size]
    inside = offsets[1:][text] - np.arange(size) >= window
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    parts = -(-(ends - starts) // RUN)
    run = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[run] + nth * RUN
    n = np.minimum(ends[run] - begin, RUN)
    data = memoryview(buf.tobytes())
    spans = zip(begin.tolist(), (begin + n + window - 1).tolist(), strict=True)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(data[b:e]) for b, e in spans), np.uint64, len(begin))
    times = 1 + (where[begin] != where[begin + n - 1]).astype(np.int64)
    return text[begin], begin, n, mix(least[begin]).view(np.int64), digest.view(np.int64), times


def _stretches(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The block, or a very long single text in overlapping pieces: first text, offset in it, bytes and bounds."""
    if len(buf) <= 2 * BLOCK_BYTES or len(offsets) > 2:
        yield 0, 0, buf, offsets
        return
    for at in range(0, len(buf) - WINDOW + 1, BLOCK_BYTES):
        piece = buf[at : at + BLOCK_BYTES + WINDOW - 1]
        yield 0, at, piece, np.array([0, len(piece)])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        for _, moved, buf, offsets in _stretches(*flat(block.column("text"))):
            text, begin, n, anchor, digest, times = anchored_segments(buf, offsets, GRAMS[0])
            at = pa.array(text)
            start = begin - offsets[text] + moved
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(at), block.column("h").take(at), *map(pa.array, (anchor, digest, start, n.astype(np.int32), times))],
                ["doc_id", "h", "anchor", "digest", "start", "n", "times"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments asked for in each text."""
    for block in blocks(batches, "text"):
        buf, offsets = flat(block.column("text"))
        wanted = block.column("wanted")
        rows = wanted.flatten()
        begins = np.repeat(offsets[:-1], pc.list_value_length(wanted).to_numpy()) + rows.field("start").to_numpy()
        ends = begins + rows.field("n").to_numpy() + WINDOW - 1
        data = buf.tobytes()
        cut = [data[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        for lo in range(0, len(cut), 4096):
            part = rows.slice(lo, 4096)
            yield pa.RecordBatch.from_arrays(
                [part.field("anchor"), part.field("digest"), part.field("copies"), pa.array(cut[lo : lo + 4096], pa.binary())],
                ["anchor", "digest", "copies", "segment"],
            )


def _deal_again(gram: int):
    """Segments of a segment's windows, dealt out by longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "segment"):
            buf, offsets = flat(block.column("segment"))
            row, begin, n, anchor, digest, times = anchored_segments(buf, offsets, gram)
            at = pa.array(row)
            data = buf.tobytes()
            cut = [data[b:e] for b, e in zip(begin.tolist(), (begin + n + WINDOW - 1).tolist(), strict=True)]
            parent = block.column("anchor").take(at)
            joint = mix(anchor.view(np.uint64) ^ mix(parent.to_numpy().view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [parent, block.column("digest").take(at), block.column("copies").take(at), *map(pa.array, (begin - offsets[row], joint, digest, times)), pa.array(cut, pa.binary())],
                ["p_anchor", "p_digest", "copies", "shift", "anchor", "digest", "times", "segment"],
            )

    return run


def repeated_windows(segments: list[bytes], copies: list[int]) -> list[list[tuple[int, int]]]:
    """For each segment the runs ``[lo, hi)`` of windows that occur in another segment, or twice in this one."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.cumsum(sizes) - sizes
    phases = np.minimum(LETTER, sizes - WINDOW + 1)  # later phases begin no window that earlier ones do not
    owner = np.repeat(np.arange(len(sizes)), phases)
    phase = np.arange(len(owner)) - np.repeat(np.cumsum(phases) - phases, phases)
    length = (sizes[owner] - phase) // LETTER
    bounds = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(begins[owner] + phase - LETTER * bounds[:-1], length) + LETTER * np.arange(bounds[-1])
    words = span_hashes(data, place, place + LETTER, 52)
    letters = np.unique(words, return_inverse=True)[1]
    strand, left = repeated_suffixes(letters, bounds, WINDOW // LETTER, np.asarray(copies)[owner])
    start = begins[owner[strand]] + phase[strand] + LETTER * (length[strand] - left)
    hit = np.zeros(len(data) + 1, bool)
    hit[start] = True
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))  # windows of one segment never reach the next segment
    lo, hi = edge[::2], edge[1::2]
    own = np.searchsorted(begins, lo, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for s, a, b in zip(own.tolist(), (lo - begins[own]).tolist(), (hi - begins[own]).tolist(), strict=True):
        out[s].append((a, b))
    return out


def _runs(anchors: list[int], digests: list[int], copies: list[int], segments: list[bytes]) -> pa.RecordBatch:
    runs = repeated_windows(segments, copies)
    own = np.repeat(np.arange(len(runs)), list(map(len, runs)))
    flat_runs = [r for some in runs for r in some]
    columns = [np.array(anchors, np.int64)[own], np.array(digests, np.int64)[own]]
    ends = [np.array([r[k] for r in flat_runs], np.int32) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, (*columns, *ends))), ["anchor", "digest", "lo", "hi"])


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments that come sorted by anchor the runs of repeated windows, about ``SORT_BYTES`` of whole anchors at once."""
    names = ("anchor", "digest", "copies", "segment")
    held: list[list] = [[] for _ in names]
    size = 0
    for batch in batches:
        for column, name in zip(held, names, strict=True):
            column.extend(batch.column(name).to_pylist())
        size += pc.sum(pc.binary_length(batch.column("segment"))).as_py() or 0
        if size >= SORT_BYTES:
            cut = len(held[0]) - 1
            while cut and held[0][cut - 1] == held[0][-1]:
                cut -= 1
            if cut:
                yield _runs(*(column[:cut] for column in held))
                held = [column[cut:] for column in held]
                size = sum(map(len, held[3]))
    if held[0]:
        yield _runs(*held)


def sort_segments(segments: DataFrame, level: int = 0, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """``anchor, digest, lo, hi``: the repeated windows of the classes in ``segments`` (``anchor, digest, copies, segment``)."""
    hot = None
    if level + 1 < len(GRAMS):
        hot = stage(segments.groupBy("anchor").count().where(F.col("count") > hot_classes).select("anchor"), "hot")
        if hot.isEmpty():
            discard(hot)
            hot = None
    cold = segments.join(hot, "anchor", "left_anti") if hot is not None else segments
    size = cold.agg(F.sum(F.length("segment"))).first()[0] or 0
    tasks = max(partitions(segments.sparkSession), -(-size // TASK_BYTES))
    found = cold.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_out, "anchor long, digest long, lo int, hi int")
    if hot is None:
        return stage(found, "runs")
    schema = "p_anchor long, p_digest long, copies int, shift long, anchor long, digest long, times long, segment binary"
    dealt = stage(segments.join(hot, "anchor", "left_semi").select(segments.columns).mapInArrow(_deal_again(GRAMS[level + 1]), schema), "dealt")
    shared = dealt.groupBy("anchor").agg(F.sum(F.col("copies") * F.col("times")).alias("c")).where("c > 1").select("anchor")
    dealt_twice = dealt.join(shared, "anchor", "left_semi")
    classes = dealt_twice.groupBy("anchor", "digest").agg(
        F.least(F.lit(2), F.sum("copies")).cast("int").alias("copies"), F.first("segment").alias("segment")
    )
    inner = sort_segments(stage(classes, "segments"), level + 1, hot_classes)
    back = dealt.select("p_anchor", "p_digest", "shift", "anchor", "digest").join(inner, ["anchor", "digest"])
    back = back.select("p_anchor", "p_digest", (F.col("lo") + F.col("shift")).cast("int").alias("lo"), (F.col("hi") + F.col("shift")).cast("int").alias("hi"))
    both = stage(found.union(back), "runs")
    discard(dealt, inner, hot)
    return both


def repeated_runs(base: DataFrame, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """``doc_id, h, runs``: for each text with repeats the runs ``lo, hi`` of windows (byte offsets of their begins)."""
    schema = "doc_id long, h long, anchor long, digest long, start long, n int, times long"
    anchors = stage(base.select("doc_id", "h", "text").mapInArrow(_anchor_rows, schema), "anchors")
    twice = anchors.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor")
    marked = stage(anchors.join(twice, "anchor", "left_semi").drop("times"), "marked")
    discard(anchors)
    classes = marked.groupBy("anchor", "digest").agg(
        F.least(F.lit(2), F.count("*")).cast("int").alias("copies"), F.min(F.struct("doc_id", "h", "start", "n")).alias("at")
    )
    wanted = classes.select("at.doc_id", "at.h", F.struct("anchor", "digest", "copies", "at.start", "at.n").alias("w"))
    wanted = wanted.groupBy("doc_id", "h").agg(F.collect_list("w").alias("wanted")).toDF("w_id", "w_h", "wanted")
    of_row = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))
    cut = base.join(wanted.hint("shuffle_hash"), of_row).select("text", "wanted")
    segments = stage(cut.mapInArrow(_cut, "anchor long, digest long, copies int, segment binary"), "segments")
    found = sort_segments(segments, 0, hot_classes)
    discard(segments)
    hits = marked.join(found, ["anchor", "digest"])
    spans = hits.select("doc_id", "h", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("r"))
    return spans.groupBy("doc_id", "h").agg(F.collect_list("r").alias("runs"))


def removed_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches of bytes that the windows beginning in ``[lo, hi)`` cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), (hi + WINDOW - 1).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", 8 << 20):
        texts, runs = block.column("text").to_pylist(), block.column("runs").to_pylist()
        rows = []
        for text, some in zip(texts, runs, strict=True):
            data = text.encode()
            ends = np.array([(r["lo"], r["hi"]) for r in some or []], np.int64).reshape(-1, 2)
            spans = removed_spans(ends[:, 0], ends[:, 1])
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
        n_bytes, n_removed, n_spans, sha, kept, spans = (list(c) for c in zip(*rows, strict=True))
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                block.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string()),
                pa.array(kept, pa.binary()), pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], kind),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_classes: int = HOT_CLASSES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (bytes) and ``spans`` (byte ranges) of every row.

    A byte goes if a 200-byte string that covers it also begins anywhere else: in another row, or elsewhere in the same
    text, where the two may overlap. Strings are judged on the input. Null texts are empty; texts under 200 bytes keep all.
    Each row is a document of its own, also rows that share a ``doc_id`` or have none; so of equal rows all lose what is
    long enough. Other columns are ignored.
    """
    base = keyed(docs, doc_id, text)
    runs = repeated_runs(base, hot_classes).toDF("r_id", "r_h", "runs")
    of_row = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))
    joined = base.join(runs.hint("shuffle_hash"), of_row, "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<lo:long, hi:long>>"
    return joined.mapInArrow(_removed, schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
