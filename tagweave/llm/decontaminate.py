"""Documents that contain an item of a benchmark, verbatim or with a few words changed.

Windows of a document as long as an item, in words, are compared with the item by edit distance. CGK embedding turns
edit distance into Hamming distance: a walk reads the window, copies the word it stands on, and goes on by a random bit
of (step, word), so that two walks that fall out of step at an edit meet again soon. Repeated sampling of a few
coordinates of the embedding (several walks, several samples each) makes windows collide with near items; a collision
is verified by the exact edit distance. The longer an item, the more edits it may have and the more walks are taken, so
that the recall is about the same for all sizes. Windows may begin before a text's first word, in sentinels that stand
for no word: an item that lost words at the beginning of a text has windows in step with it like any other.

A window is only embedded if it holds as many of the item words' 3-grams as the q-gram lemma demands of anything within
reach, which loses nothing and leaves few windows. The items are the query set: they go to every task in blocks of bounded
size, against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import blocks, flat, keyed, keyed_rows, mix, random_words, stage, word_hashes, word_spans

#: Words that may be edited, as a share of the item's words; items of fewer than 8 words must match exactly.
EDITS = 0.2
GRAM = 3
#: Samples of a walk, and coordinates of a sample; the least number of walks, and words of an item for each further one.
SAMPLES, COORDINATES, WALKS, WALK_WORDS = 16, 2, 6, 20
#: Items that go to the tasks at once, and bytes of their texts; values of the embeddings that are held at once.
BLOCK_ITEMS, BLOCK_TEXT, EMBEDDED = 4000, 4 << 20, 1 << 21
#: Bytes of text that are searched at once: windows of an item's size are embedded together.
TEXT_BYTES = 4 << 20
#: What stands before the first word of a text.
SENTINEL = random_words(73, 1)[0]
#: Words of the stretches that are compared at once, about.
COMPARED_WORDS = 1 << 18


def edits_allowed(n: int) -> int:
    return int(EDITS * n) if n >= 8 else 0


@dataclass(frozen=True)
class Items:
    """A block of items: ids, words, and what the tasks look windows up in."""

    ids: list[int]
    words: list[np.ndarray]
    sizes: np.ndarray
    grams: np.ndarray  # the distinct 3-grams of all items, sorted
    places: np.ndarray  # where each gram's items begin in ``holders``, and the end
    holders: np.ndarray
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  # by size: sorted sample hashes and the items they come from


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's first word."""
    buf, offsets = flat(column)
    starts, ends, firsts = word_spans(buf, offsets)
    return word_hashes(buf, starts, ends, 71, lower=True), firsts


def _grams(words: np.ndarray) -> np.ndarray:
    factor = random_words(72, GRAM)
    n = max(0, len(words) - GRAM + 1)
    return mix(sum((words[k : k + n] * factor[k] for k in range(GRAM)), np.zeros(n, np.uint64)))


def walks_of(size: int) -> int:
    """Independent walks for an item of ``size`` words: more of them for more edits."""
    return max(WALKS, -(-size // WALK_WORDS))


def embed(words: np.ndarray, starts: np.ndarray, begins: np.ndarray, steps: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """The walks from ``starts`` on: the words met, and how far into the window, a column for each step.

    Before ``begins``, where its text begins, a walk meets sentinels. A window's CGK embedding is the words met, with zeros where
    the walk has left the window; where it went from there no longer matters.
    """
    met = np.zeros((len(starts), steps), np.uint64)
    far = np.zeros((len(starts), steps), np.int32)
    at = np.zeros(len(starts), np.int64)
    salts = random_words(1000 + walk, steps)
    for step in range(steps):
        place = starts + at
        letter = np.where(place < begins, SENTINEL, words[np.minimum(np.maximum(place, 0), len(words) - 1)])
        met[:, step], far[:, step] = letter, at
        at += (mix(letter ^ salts[step]) & np.uint64(1)).astype(np.int64)
    return met, far


def sample_keys(words: np.ndarray, starts: np.ndarray, begins: np.ndarray, size: int, held: np.ndarray) -> np.ndarray:
    """A hash of the sampled coordinates for each window ``words[start : start + size]`` and each sample, of which only the
    first ``held`` words are there (its text ends).

    Coordinates are sampled from the first ``2 * size``, in which a walk crosses the window.
    """
    factor = random_words(3000, COORDINATES)
    out = np.zeros((len(starts), walks_of(size) * SAMPLES), np.uint64)
    for walk in range(walks_of(size)):
        met, far = embed(words, starts, begins, 2 * size, walk)
        drawn = random_words(2000 + walk, SAMPLES * COORDINATES).reshape(SAMPLES, COORDINATES) >> np.uint64(32)
        for k in range(SAMPLES):
            value = np.full(len(starts), walk * SAMPLES + k + 1, np.uint64)
            for c in range(COORDINATES):
                step = int(drawn[k, c]) * 2 * size >> 32
                value += np.where(far[:, step] < held, met[:, step], np.uint64(0)) * factor[c]
            out[:, walk * SAMPLES + k] = mix(value)
    return out


def build_items(ids: list[int], texts: list[str]) -> Items:
    """Items of fewer than three words are left out: they are no evidence."""
    words, firsts = _words(pa.array(texts, pa.string()))
    chosen = [n for n in range(len(texts)) if firsts[n + 1] - firsts[n] >= GRAM]
    own = [words[firsts[n] : firsts[n + 1]] for n in chosen]
    sizes = np.array([len(w) for w in own], np.int64)
    keys, starts = {}, firsts[:-1][chosen]
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        found = sample_keys(words, starts[of], starts[of], size, sizes[of])
        hashes, item = found.ravel(), np.repeat(of, found.shape[1])
        order = np.argsort(hashes, kind="stable")
        keys[size] = hashes[order], item[order]
    each = [np.unique(_grams(w)) for w in own]
    grams, index = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
    holder = np.repeat(np.arange(len(own)), [len(g) for g in each])
    order = np.argsort(index, kind="stable")
    places = np.searchsorted(index[order], np.arange(len(grams) + 1))
    return Items([ids[n] for n in chosen], own, sizes, grams, places, holder[order], keys)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance between the item and any stretch of ``text``, and where the first best one ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for n, word in enumerate(item, 1):
        over = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        new = np.concatenate([[n], over])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def best_matches(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_match`` of each row of ``items`` in the same row of ``texts``; words behind a text's end must be in no item."""
    steps = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int64)
    new = np.empty_like(row)
    for n in range(items.shape[1]):
        new[:, 0] = n + 1
        np.minimum(row[:, :-1] + (texts != items[:, n, None]), row[:, 1:] + 1, out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=row)
        row += steps
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def compared(items: Items, words: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance of item ``which`` in ``words[lo:hi]``, for each of them, and where the first best one ends (in ``words``)."""
    distance, end = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    order = np.lexsort((hi - lo, items.sizes[which]))
    at = 0
    while at < len(order):
        same = order[at : at + max(1, COMPARED_WORDS // int((hi - lo)[order[at]] + 1))]
        same = same[items.sizes[which[same]] == items.sizes[which[same[0]]]]
        same = same[: max(1, int(np.searchsorted((hi - lo)[same] * np.arange(1, len(same) + 1), COMPARED_WORDS, side="right")))]
        place = lo[same, None] + np.arange(int((hi - lo)[same].max()))
        texts = words[np.minimum(place, len(words) - 1)]
        own = np.stack([items.words[i] for i in which[same]])
        texts[place >= hi[same, None]] = 0  # the hash of no word
        distance[same], where = best_matches(own, texts)
        end[same] = lo[same] + where
        at += len(same)
    return distance, end


def windows(items: Items, grams: np.ndarray, text: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, item``: the windows of an item's size that hold enough of its 3-grams; they may begin as far before the
    text as an item's words can be missing there.

    A stretch of words within ``k`` edits of an item of ``n`` words holds ``n - 2 - 3 k`` of its 3-grams at least, and has
    ``n + k`` words at most. ``grams`` begin at each word; ``text`` says to which text a word belongs.
    """
    at = np.minimum(np.searchsorted(items.grams, grams), len(items.grams) - 1)
    hit = np.flatnonzero(items.grams[at] == grams)
    count = items.places[at[hit] + 1] - items.places[at[hit]]
    item = items.holders[np.repeat(items.places[at[hit]] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    place = np.repeat(hit, count)
    order = np.lexsort((place, item, text[place]))
    item, place = item[order], place[order]
    reach = np.where(items.sizes >= 8, (EDITS * items.sizes).astype(np.int64), 0)[item]
    need = items.sizes[item] - (GRAM - 1) - GRAM * reach
    span = items.sizes[item] + reach - (GRAM - 1)  # begins of 3-grams in the longest stretch
    last = np.arange(len(item)) + need - 1
    good = last < len(item)
    last = np.minimum(last, len(item) - 1)
    good &= (item[last] == item) & (text[place[last]] == text[place]) & (place[last] - place < span)
    item, own = item[good], text[place[good]]
    lo = np.maximum(place[last][good] - span[good] + 1, firsts[own] - reach[good])
    size = place[good] + 1 - lo
    start = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    item, own = np.repeat(item, size), np.repeat(own, size)
    # what begins before a text lies in the one before it: windows are told apart by text, item and begin
    order = np.lexsort((start, item, own))
    own, item, start = own[order], item[order], start[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
    return own[new], start[new], item[new]


def collisions(items: Items, words: np.ndarray, firsts: np.ndarray, own: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows have a sample in common with their item."""
    met = np.zeros(len(start), bool)
    size_of = items.sizes[item]
    for size in np.unique(size_of).tolist():
        rows = np.flatnonzero(size_of == size)
        keys, holder = items.keys[size]
        step = max(1, EMBEDDED // max(2 * size, walks_of(size) * SAMPLES))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            held = np.minimum(size, firsts[1:][own[part]] - start[part])  # a window ends with its text
            hashes = sample_keys(words, start[part], firsts[own[part]], size, held)
            first, after = (np.searchsorted(keys, hashes.ravel(), side=s) for s in ("left", "right"))
            n = np.flatnonzero(after > first)
            count = (after - first)[n]
            found = holder[np.repeat(first[n] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            row = part[np.repeat(n // hashes.shape[1], count)]
            met[row[found == item[row]]] = True
    return met


def leaks(items: Items, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``text, item, last word, edits`` of the places that verify, one for each stretch of neighbouring windows that collide."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    grams = _grams(words)
    if not len(grams) or not len(items.grams):
        return []
    grams[text[GRAM - 1 :] != text[: len(grams)]] = 0  # runs into the next text
    own, start, item = windows(items, grams, text, firsts)
    met = collisions(items, words, firsts, own, start, item)
    own, start, item = own[met], start[met], item[met]
    if not len(own):
        return []
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > items.sizes[item][1:])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(own)) - 1
    own, item, size = own[head], item[head], items.sizes[item[head]]
    reach = np.where(size >= 8, (EDITS * size).astype(np.int64), 0)
    lo = np.maximum(firsts[own], start[head] - reach)
    hi = np.minimum(firsts[own + 1], start[tail] + size + 2 * reach)
    distance, end = compared(items, words, item, lo, hi)
    good = distance <= reach
    return list(zip(own[good].tolist(), item[good].tolist(), (end - firsts[own])[good].tolist(), distance[good].tolist(), strict=True))


def _found(shared):
    """shared: a broadcast of ``Items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for block in blocks(batches, "text", TEXT_BYTES):
            words, firsts = _words(block.column("text"))
            rows = leaks(items, words, firsts)
            if rows:
                row, item, end, edits = (np.array(c) for c in zip(*rows, strict=True))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").take(at), block.column("h").take(at), pa.array([items.ids[i] for i in item], pa.int64()),
                        pa.array(end.astype(np.int32)), pa.array(edits.astype(np.int32)),
                    ],
                    ["doc_id", "h", "item_id", "end_word", "edits"],
                )

    return run


def find_leaks(base: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, h, item_id, end_word, edits``: every place of a text (``common.keyed``) where an item lies."""
    spark = base.sparkSession
    given = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n, size = given.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(1, -(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_TEXT))
    found = None
    for block in range(n_blocks):
        part = given.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        rows = part.orderBy("item_id", "text").collect()  # a block of the query set
        items = spark.sparkContext.broadcast(build_items([r.item_id for r in rows], [r.text for r in rows]))
        hits = base.select("doc_id", "h", "text").mapInArrow(_found(items), "doc_id long, h long, item_id long, end_word int, edits int")
        found = hits if found is None else found.union(hits)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, h, contaminated, n_items, item_ids`` of every row of ``docs`` (``doc_id, text``).

    A document is contaminated if some stretch of its words is within ``edits_allowed`` word edits of all words of a
    benchmark item (``item_id, text``); A-Z count as a-z. Null and empty texts hold nothing; items that are null, have a
    null id or fewer than three words are ignored; rows with equal ids and texts are judged alike; items that share an id are
    found as one. ``item_ids`` is sorted. Other columns are ignored.
    """
    base = keyed(docs)
    by_row = find_leaks(base, benchmark).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    by_row = by_row.toDF("f_id", "f_h", "item_ids")
    of_row = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    rows = base.select("doc_id", "h").join(by_row.hint("shuffle_hash"), of_row, "left")
    items = F.coalesce("item_ids", F.array().cast("array<long>"))
    return rows.select("doc_id", "h", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns: ``doc_id, contaminated, n_items, item_ids``."""
    return contamination(docs.select("doc_id", "text"), benchmark).drop("h")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay."""
    whole = keyed_rows(docs)
    bad = stage(find_leaks(whole.select("doc_id", "h", "text"), benchmark).select("doc_id", "h").distinct(), "leaks").toDF("f_id", "f_h")
    of_row = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    return whole.join(bad.hint("shuffle_hash"), of_row, "left_anti").select("row.*")
