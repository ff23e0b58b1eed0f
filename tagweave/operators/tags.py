"""Free-text tags: normal form, vocabulary and bags of tags."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.ordering import hot_keys, salted_join
from tagweave.operators.counts import number_labels
from tagweave.operators.stem import UNCHANGED, stem_words
from tagweave.session import remove_path, spread_scan, stage

# What separates the words of a tag, and what separates the words of a text.
TAG_SEPARATORS = "[^\\p{L}\\p{N}]+"
TEXT_SEPARATORS = "[ \\t\\n\\r\\f]+"

# A table of tags of at most this size may be broadcast: its texts, and what a row costs beside them.
SENT_BYTES, ROW_BYTES = 64 << 20, 48

# Rows of a raw tag that are stemmed one by one, on average, rather than shuffled to meet its normal form.
STEMS = 8

# Tags that a task counts at least before it forgets rare ones.
COUNTERS = 1 << 16

# Rows that a task counts at once.
GATHERED = 1 << 18

# Raw tags among which a task stems each distinct one once.
STEMMED = 1 << 22

# Tracks in one row of listed tag counts: rows are read some thousand at a time.
LISTED = 1 << 10


def _may_be_sent(table: DataFrame, *texts: str) -> bool:
    sizes = [F.coalesce(F.octet_length(t), F.lit(0)) for t in texts]
    n, size = table.agg(F.count("*"), F.sum(sum(sizes, F.lit(0)))).first()
    return n * ROW_BYTES + (size or 0) <= SENT_BYTES


def normalize_tag(tag: Column) -> Column:
    """Lower case, one stemmed word after the other, no separators: ``Acoustic Guitars`` is ``acoustguitar``."""
    # separators are replaced before words are split at blanks: a split compiles any longer pattern for each value
    blanks = F.trim(F.regexp_replace(F.lower(tag), TAG_SEPARATORS, " "))
    return _once(F.when(F.lower(tag).rlike("[^a-z0-9]"), blanks).otherwise(F.lower(tag)), _stemmed)


def _once(value: Column, take) -> Column:
    """What ``take`` makes of a value that it uses several times: as the variable of a lambda it is computed once."""
    return F.transform(F.array(value), take)[0]


def _stemmed(blanks: Column) -> Column:
    """The stems of the words between single blanks, joined."""
    words = F.when(~blanks.contains(" "), F.array(blanks)).otherwise(F.split(blanks, " "))
    # most tags are one word, and telling that no step changes it is far cheaper than the steps
    return F.when(blanks.rlike(UNCHANGED), blanks).otherwise(F.array_join(_once(words, stem_words), ""))


def words_of(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The words of whole texts as raw tags ``(track, raw)``.

    The outer form of explode keeps the optimizer from splitting every text a second time for an
    inferred size filter; the rows it adds for empty texts fail the test below.
    """
    words = F.explode_outer(F.split(text, TEXT_SEPARATORS))
    return texts.select(F.col(key).alias("track"), words.alias("raw")).where("raw <> ''")


def whole_texts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts as ``(track, text)``, whose words are taken where they are counted."""
    return texts.select(F.col(key).alias("track"), F.col(text).alias("text"))


def _split_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The same words as one array ``raw`` a text, with empty ones at its ends, which have no normal form."""
    texts = batch.column("text")
    # vertical tabs, the one further space that the plain split knows, belong to words
    plain = not pc.any(pc.match_substring(texts, "\v")).as_py()
    words = pc.ascii_split_whitespace(texts) if plain else pc.split_pattern_regex(texts, TEXT_SEPARATORS)
    return pa.RecordBatch.from_arrays([batch.column("track"), words], names=["track", "raw"])


def _one_form(tag: Column) -> Column:
    """A normal form as the one row of an explode, none if it is empty.

    A filter on a computed tag would be pushed below and stem twice; on an exploded one it stays above.
    """
    return F.explode_outer(F.filter(F.array(tag), lambda t: t != ""))


def frequent_forms(raw: DataFrame) -> tuple[DataFrame, bool]:
    """The raw tags on more than one row with their normal form ``(raw, form)``, the more frequent first as far as they may be
    broadcast; and whether the rows of all other raw tags are so few that each can be stemmed by itself.

    Tags are taken by powers of two of their number of rows, so only the sizes of these classes reach the driver.
    """
    counted = stage(raw.groupBy("raw").agg(F.count("*").alias("n")).where("n > 1"), "raw-tags")
    level = F.length(F.bin("n"))
    sizes = counted.groupBy(level.alias("level")).agg(F.count("*").alias("tags"), F.sum("n").alias("rows"), F.sum(F.octet_length("raw")).alias("bytes"))
    room, least, left_tags, left_rows = SENT_BYTES, 65, 0, 0
    for row in sorted(sizes.collect(), reverse=True):
        # a normal form is hardly longer than its raw tag
        room -= row.tags * ROW_BYTES + 2 * (row.bytes or 0)
        if room >= 0:
            least = row.level
        else:
            left_tags, left_rows = left_tags + row.tags, left_rows + row.rows
    forms = counted.where(level >= least).select("raw", normalize_tag(F.col("raw")).alias("form"))
    return forms, left_rows <= STEMS * left_tags


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones, null as one of them, and these."""
    found = pa.concat_arrays(values.chunks).dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _blocks(batches, words: int):
    """Whole rows with about ``words`` elements of ``raw`` together, as tables; a longer row may stand alone."""
    held, size = [], 0
    for batch in batches:
        n = pc.fill_null(pc.list_value_length(batch.column("raw")), 0).to_numpy().astype(np.int64)
        total, first = size + np.cumsum(n), 0
        for end in (np.flatnonzero(total // words > (total - n) // words) + 1).tolist():
            yield pa.Table.from_batches([*held, batch.slice(first, end - first)])
            held, first = [], end
        held.append(batch.slice(first))
        size = int(total[-1]) % words if len(total) else size
    if held:
        yield pa.Table.from_batches(held)


def _tags_in_blocks(raw: DataFrame) -> DataFrame:
    """``block, raw, track, n``: the distinct raw tags of each block of rows, with their tracks and counts as arrays."""
    texts = "raw" not in raw.columns
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("raw", T.StringType()),
                           T.StructField("track", T.ArrayType(raw.schema["track"].dataType)), T.StructField("n", T.ArrayType(T.LongType()))])

    def task(batches):
        for block, table in enumerate(_blocks(map(_split_texts, batches) if texts else batches, STEMMED)):
            size = pc.fill_null(pc.list_value_length(table.column("raw")), 0).to_numpy()
            if not size.sum():
                continue
            tag, words = _codes(pc.list_flatten(table.column("raw")))
            pairs, n = np.unique(tag * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
            bounds = pa.array(np.searchsorted(pairs, np.arange(len(words) + 1) * len(size)).astype(np.int32))
            tracks = pa.concat_arrays(table.column("track").chunks).take(pa.array(pairs % len(size)))
            lists = [pa.ListArray.from_arrays(bounds, values) for values in (tracks, pa.array(n.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), words.cast(pa.string()), *lists], names=schema.names)

    return raw.select("track", "text" if texts else "raw").mapInArrow(task, schema)


def _by_block(batches):
    """The rows of one block after the other, as tables."""
    held = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for first, end in itertools.pairwise(cuts):
            if held and end > first and held[-1].column("block")[0] != batch.column("block")[first]:
                yield pa.Table.from_batches(held)
                held = []
            if end > first:
                held.append(batch.slice(first, end - first))
    if held:
        yield pa.Table.from_batches(held)


def _whole(raw: DataFrame) -> bool:
    return "raw" not in raw.columns or isinstance(raw.schema["raw"].dataType, T.ArrayType)


def _list_in_place(raw: DataFrame) -> DataFrame:
    """Listed tag counts of tracks that have all their raw tags in one row: each block of rows is counted by itself.

    A raw tag is stemmed once a block. No rows are shuffled, and a task holds one block of about ``STEMMED`` raw tags.
    """
    listed = T.StructType([T.StructField("track", raw.schema["track"].dataType), T.StructField("n", T.LongType())])
    schema = T.StructType([T.StructField("tag", T.StringType()), T.StructField("n_tracks", T.LongType()), T.StructField("tracks", T.ArrayType(listed))])
    stemmed = _tags_in_blocks(raw).select("block", normalize_tag(F.col("raw")).alias("tag"), "track", "n")

    def task(batches):
        for table in _by_block(batches):
            table = table.filter(pc.not_equal(table.column("tag"), ""))
            if not table.num_rows:
                continue
            tag, texts = _codes(table.column("tag"))
            at, tracks = _codes(pc.list_flatten(table.column("track")))
            pairs = np.repeat(tag, pc.list_value_length(table.column("n")).to_numpy()) * len(tracks) + at
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            n = np.add.reduceat(pc.list_flatten(table.column("n")).to_numpy()[order], first)
            tag, at = np.divmod(pairs[first], len(tracks))
            # a row begins with each tag, and after so many tracks of it
            place = np.arange(len(tag))
            begins = np.diff(tag, prepend=-1) != 0
            place -= np.maximum.accumulate(np.where(begins, place, 0))
            rows = np.flatnonzero(place % LISTED == 0)
            bounds = np.append(rows, len(tag))
            pair = pa.StructArray.from_arrays([tracks.take(pa.array(at)), pa.array(n)], names=listed.names)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pair)
            yield from pa.table([texts.take(pa.array(tag[rows])), pa.array(np.diff(bounds)), lists], names=schema.names).to_batches(LISTED)

    return stemmed.mapInArrow(task, schema)


def _listed(counted: DataFrame) -> bool:
    return "tracks" in counted.columns and "track" not in counted.columns


def _in_rows(counted: DataFrame) -> DataFrame:
    """Listed tag counts with a row for each track and tag."""
    if not _listed(counted):
        return counted
    others = [c for c in counted.columns if c not in ("tag", "n_tracks", "tracks")]
    return counted.select("tag", *others, F.inline("tracks")).select("track", "tag", *others, "n")


def list_tags(raw: DataFrame) -> DataFrame:
    """The tag counts of ``normalize_tags`` as lists ``(tag, n_tracks, tracks)``: rows of a tag, as many as need be, with at most
    ``LISTED`` of its tracks as ``(track, n)``; a track and tag is in one row only.

    Of tags that come as arrays or texts there are far fewer rows than pairs of track and tag. Whoever asks for tags only need not read
    the tracks, and a tag meets a vocabulary once for all tracks of a row.
    """
    if _whole(raw):
        return _list_in_place(raw)
    return normalize_tags(raw).select("tag", F.lit(1).cast("bigint").alias("n_tracks"), F.array(F.struct("track", "n")).alias("tracks"))


def tags_of_texts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Tag counts ``(track, tag, n)`` of all words of whole texts.

    The words of a key with one text are counted where they stand. Only the words of keys that come more than once are
    shuffled.
    """
    return _count_texts(texts, key, text, normalize_tags)


def list_tags_of_texts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same counts as lists of ``list_tags``."""
    return _count_texts(texts, key, text, list_tags)


def _count_texts(texts: DataFrame, key: str, text: str, count) -> DataFrame:
    every = spread_scan(texts.select(key, text))
    twice = texts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    twice = stage(twice, "repeated-keys")
    if twice.isEmpty():
        return count(whole_texts(every, key, text))
    if not _may_be_sent(twice.select(F.col("_key").cast("string")), "_key"):
        return count(words_of(every, key, text))
    marked = every.join(F.broadcast(twice), F.col(key).eqNullSafe(F.col("_key")), "left")
    once = count(whole_texts(marked.where("_n is null"), key, text))
    return once.unionByName(count(words_of(marked.where("_n > 1"), key, text)))


def normalize_tags(raw: DataFrame) -> DataFrame:
    """Tag counts ``(track, tag, n)`` in normal form.

    ``raw`` has a row for each raw tag, or one for each track with an array of all its raw tags or its whole ``text``; no row of
    the latter two is shuffled. The former are counted as follows.

    Stemming is the costly part. Each frequent raw tag is stemmed once and joined by broadcast, and the rare ones are stemmed
    where they stand, so that rows are shuffled once, by track and tag. If the tags that can't be broadcast have too many rows
    for that, they are joined back to the counted pairs by a shuffle, with frequent tags cut into pieces.
    """
    if _whole(raw):
        return _in_rows(_list_in_place(raw))
    forms, rare = frequent_forms(raw)
    if not rare:
        return _normalize_by_shuffle(raw)
    known = raw.join(F.broadcast(forms), "raw", "left")
    form = F.when(F.col("form").isNotNull(), F.col("form")).otherwise(normalize_tag(F.col("raw")))
    tagged = known.select("track", _one_form(form).alias("tag")).where("tag is not null")
    return tagged.groupBy("track", "tag").agg(F.count("*").alias("n"))


def _normalize_by_shuffle(raw: DataFrame) -> DataFrame:
    """Each distinct raw tag is stemmed once and joined to the counted pairs of track and raw tag."""
    counted = stage(raw.groupBy("track", "raw").agg(F.count("*").alias("n")), "raw-tags")
    forms = counted.select("raw").distinct().select("raw", _one_form(normalize_tag(F.col("raw"))).alias("tag"))
    forms = stage(forms.where("tag is not null"), "tag-forms")
    tagged = salted_join(counted, forms, "raw", "track", hot_keys(counted, "raw"))
    return tagged.groupBy("track", "tag").agg(F.sum("n").alias("n"))


def _value_counts(batches):
    """The sums ``tag, n`` of ``GATHERED`` rows of tags and numbers of tracks at a time, as tables."""
    held, rows = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(pa.Table.from_arrays([batch.column(0).cast(pa.string()), batch.column(1)], names=["tag", "n"]))
            rows += batch.num_rows
        if held and (batch is None or rows >= GATHERED):
            found = pa.concat_tables(held)
            found = found.filter(pc.is_valid(found.column("tag"))).group_by("tag").aggregate([("n", "sum")])
            yield found.rename_columns(["tag", "n"])
            held, rows = [], 0


def _n_tracks(tags: DataFrame) -> Column:
    """On how many tracks the tag of a row is."""
    return (F.col("n_tracks") if _listed(tags) else F.lit(1).cast("bigint")).alias("n")


def tag_sketch(tags: DataFrame, counters: int) -> DataFrame:
    """Lower bounds of how many tracks each tag has ``(tag, n)``, from counters that each task bounds; the row without a tag is
    how much all tasks together may have missed of any tag.

    A task that has more than twice ``counters`` tags takes the count of the one after the ``counters`` largest from all and
    keeps those above zero (as Misra and Gries do): each tag loses that much at most, in any order of the rows.
    """

    def task(batches):
        counts, missed = pa.table({"tag": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        for found in _value_counts(batches):
            counts = pa.concat_tables([counts, found]).group_by("tag").aggregate([("n", "sum")]).rename_columns(["tag", "n"])
            if counts.num_rows > 2 * counters:
                values = counts.column("n").to_numpy()
                least = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
                counts = counts.set_column(1, "n", pc.subtract(counts.column("n"), least)).filter(pa.array(values > least))
                missed += least
        yield from counts.to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([missed], pa.int64())], names=["tag", "n"])

    return tags.select("tag", _n_tracks(tags)).mapInArrow(task, "tag string, n long").groupBy("tag").agg(F.sum("n").alias("n"))


def build_tag_vocab(tags: DataFrame, n_tags: int = 561, min_tracks: int = 1, counters: int = COUNTERS) -> DataFrame:
    """The ``n_tags`` tags on most tracks ``(tag, n_tracks)``; equal counts go by tag.

    ``tags`` has one row for each track and tag, as ``normalize_tags`` gives, or lists as ``list_tags`` gives; other columns are
    ignored. What is shuffled are the tasks' counters. If no task had to drop any, their sums are the counts. Else a tag can only be among the first
    ``n_tags`` if its lower bound and what was missed reach the ``n_tags``-th lower bound; these candidates are counted
    exactly. A tag in no counter has at most as many rows as were missed: if that many could suffice, the counters are too
    few, and four times as many are taken.
    """
    while True:
        sketch = stage(tag_sketch(tags, counters), "sketch")
        missed = (sketch.where("tag is null").agg(F.sum("n")).first()[0]) or 0
        first = sketch.where("tag is not null").orderBy(F.desc("n"), "tag").limit(n_tags)
        if not missed:
            return first.where(F.col("n") >= min_tracks).select("tag", F.col("n").alias("n_tracks"))
        size, least = first.agg(F.count("*"), F.min("n")).first()
        enough = max(least, min_tracks) if size == n_tags else min_tracks
        if missed < enough:
            break
        remove_path(tags.sparkSession, sketch.staged_path)
        counters *= 4
    candidates = sketch.where(F.col("tag").isNotNull() & (F.col("n") + missed >= enough)).select("tag")
    if _may_be_sent(candidates, "tag"):
        # the file of all counters looks too large to broadcast, and all rows would be shuffled
        candidates = F.broadcast(candidates)
    counts = tags.select("tag", _n_tracks(tags)).join(candidates, "tag", "left_semi").groupBy("tag").agg(F.sum("n").alias("n_tracks"))
    return counts.where(F.col("n_tracks") >= min_tracks).orderBy(F.desc("n_tracks"), "tag").limit(n_tags)


def encode_tag_ids(vocab: DataFrame) -> DataFrame:
    """Dense ids from 0 in byte order of the tag."""
    numbered = number_labels(vocab, "tag")
    return numbered.select(F.col("d").alias("tag_id"), F.col("label").alias("tag"))


def _met(tags: DataFrame, vocab: DataFrame, how: str) -> DataFrame:
    """Tags, listed or not, joined with a vocabulary: broadcast if its counted bytes allow, else shuffled, with frequent tags cut
    into pieces. The result has a row for each track and tag."""
    if _may_be_sent(vocab, "tag"):
        return _in_rows(tags.join(F.broadcast(vocab), "tag", how))
    tags = _in_rows(tags)
    hot = hot_keys(tags, "tag")
    if how == "inner":
        return salted_join(tags, vocab, "tag", "track", hot)
    # both halves from one inner join: tags are marked, what stays unmarked is in no vocabulary
    known = vocab.select("tag").distinct().withColumn("_known", F.lit(True))
    every = tags.select("tag").distinct().join(known, "tag", "left").where("_known" if how == "left_semi" else "_known is null")
    return salted_join(tags, every.select("tag"), "tag", "track", hot)


def bag_of_tags(tags: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts per track and vocabulary tag ``(track, tag_id, n)``."""
    known = _met(tags, vocab.select("tag", "tag_id"), "inner")
    return known.groupBy("track", "tag_id").agg(F.sum("n").alias("n"))


def tags_in_vocab(tags: DataFrame, vocab: DataFrame) -> DataFrame:
    return _met(tags, vocab.select("tag"), "left_semi")


def tags_out_of_vocab(tags: DataFrame, vocab: DataFrame) -> DataFrame:
    return _met(tags, vocab.select("tag"), "left_anti")
