"""Audit of how the sources of a language differ in their words, from exact sparse document vectors.

As a count vectorizer does for each language by itself: a vocabulary of the terms in at least ``min_df`` documents, as many
as there are, and of every document the sparse vector of its counts over the vocabulary. Sums of the vectors by source,
smoothed to shares, are compared pair by pair; only entries that are not zero are looked at, all others are one number.

No vocabulary is ever whole in one place. Tasks number the terms as they meet them, in lists of bounded size; what is
shuffled are these lists, a term once a list, which come back as vocabulary indices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.ordering import global_rank
from tagweave.llm.common import blocks, discard, distinct_spans, flat, small_batches, stage, word_spans

#: A term has ASCII letters and characters beyond ASCII; every other byte separates terms.
IS_OUTSIDE = np.ones(256, bool)
IS_OUTSIDE[128:] = IS_OUTSIDE[65:91] = IS_OUTSIDE[97:123] = False

#: Documents that a term of the vocabulary must be in; terms that are reported for a source.
MIN_DF, TOP = 10, 10

#: A share of 1; what is added to a count.
UNIT, PRIOR = 1_000_000_000, 2

#: Bytes of text in a chunk, terms that a task numbers before it starts anew, and entries of term rows compared at once.
CHUNK_BYTES, TERMS, CELLS = 4 << 20, 1 << 18, 1 << 16

#: Sums that a task holds before it gives them out.
SUMS = 1 << 21

CHUNK = """list long, lang string, terms array<string>, dfs array<int>, doc_ids array<long>, sources array<string>,
    sizes array<int>, entries array<long>"""
KINDS = (pa.int64(), pa.string(), *map(pa.list_, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64())))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / total), exactly: three digits at a time, as the product may pass 64 bits."""
    rest, out = np.asarray(count, np.int64) + PRIOR, np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


# --- vectors ------------------------------------------------------------------------------------------------------


class TermList:
    """Numbers of a language's terms, from 0 as they are met, and how many documents have each."""

    def __init__(self, number: int):
        self.number, self.code, self.dfs = number, {}, np.zeros(1024, np.int64)

    def add(self, terms: list[str], dfs: np.ndarray) -> np.ndarray:
        """The numbers of distinct terms, which ``dfs`` more documents have."""
        code = self.code
        out = np.fromiter((code.setdefault(t, len(code)) for t in terms), np.int64, len(terms))
        if len(code) > len(self.dfs):
            self.dfs = np.concatenate([self.dfs, np.zeros(len(code), np.int64)])
        self.dfs[out] += dfs
        return out


def _counter(limit: int):
    """``limit``: terms that a task numbers before it starts new lists."""

    def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of every document over the terms of a list: a row for each chunk and language; and the lists."""
        number = TaskContext.get().partitionId() << 32
        lists: dict[str, TermList] = {}

        def row(*values) -> pa.RecordBatch:
            columns = [pa.array([v], kind) if v is None or not isinstance(v, pa.Array) else _one_list(v, kind) for v, kind in zip(values, KINDS, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["list", "lang", "terms", "dfs", "doc_ids", "sources", "sizes", "entries"])

        for block in blocks(batches, "text", CHUNK_BYTES):
            buf, offsets = flat(block.column("text"))
            starts, ends, firsts = word_spans(buf, offsets, IS_OUTSIDE)
            found = distinct_spans(buf, starts, ends, lower=True)
            doc = np.repeat(np.arange(block.num_rows), np.diff(firsts))
            size = max(1, len(found.dictionary))
            pairs, n = np.unique(doc * size + found.indices.to_numpy(), return_counts=True)
            doc, code = np.divmod(pairs, size)
            langs = block.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in lists:
                    lists[lang] = TermList(number := number + 1)
                chosen = lang_of[doc] == k
                own, local, dfs = np.unique(code[chosen], return_inverse=True, return_counts=True)
                codes = lists[lang].add(found.dictionary.take(pa.array(own)).cast(pa.large_string()).to_pylist(), dfs)[local]
                members = np.flatnonzero(lang_of == k)
                sizes = np.bincount(doc[chosen], minlength=block.num_rows)[members]
                at = pa.array(members)
                yield row(lists[lang].number, lang, None, None, block.column("doc_id").take(at), block.column("source").take(at), pa.array(sizes),
                          pa.array(codes << 32 | n[chosen]))
            if sum(len(terms.code) for terms in lists.values()) > limit:
                yield from (row(t.number, lang, pa.array(list(t.code)), pa.array(t.dfs[: len(t.code)]), *[None] * 4) for lang, t in lists.items())
                lists = {}
        yield from (row(t.number, lang, pa.array(list(t.code), pa.string()), pa.array(t.dfs[: len(t.code)]), *[None] * 4) for lang, t in lists.items())

    return _counted


def _one_list(values: pa.Array, kind: pa.ListType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type))


@dataclass
class Vectors:
    """``chunks``: documents counted over their list's terms, and the lists; ``vocabulary``: ``lang, term, df, index`` (from 0, by term)."""

    chunks: DataFrame
    vocabulary: DataFrame

    def _indexed(self) -> DataFrame:
        """The chunks with ``places``: which terms of their list are in the vocabulary, and where; and how many it has."""
        lists = self.chunks.where(F.col("terms").isNotNull())
        packed = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("index"))
        named = lists.select("list", "lang", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("at", "term"))
        places = named.join(self.vocabulary, ["lang", "term"]).groupBy("list", "n_terms").agg(F.collect_list(packed).alias("places"))
        return self.chunks.where(F.col("terms").isNull()).drop("terms", "dfs").join(places, "list", "left")

    def documents(self) -> DataFrame:
        """``doc_id, lang, source, indices, counts`` of every document; indices ascend."""
        return self._indexed().mapInArrow(_documents, "doc_id long, lang string, source string, indices array<int>, counts array<long>")

    def sums(self) -> DataFrame:
        """``lang, source, index, n``: the documents' vectors added up by language and source."""
        partial = self._indexed().mapInArrow(_group_sums, "lang string, source string, index int, n long")
        return partial.groupBy("lang", "source", "index").agg(F.sum("n").alias("n"))

    def discard(self) -> None:
        discard(self.chunks, self.vocabulary)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each chunk: language, ids and sources of its documents, and document, index and count of every entry."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = {name: batch.column(name)[n] for name in batch.schema.names}
            array = lambda name: row[name].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            entries = array("entries")
            codes = entries >> 32
            index = np.full(row["n_terms"].as_py() or len(codes) and int(codes.max()) + 1, -1, np.int64)
            if row["places"].is_valid:
                places = array("places")
                index[places >> 32] = places & 0xFFFFFFFF
            of = index[codes]
            kept = of >= 0
            doc = np.repeat(np.arange(len(row["doc_ids"])), array("sizes"))
            yield row["lang"].as_py(), row["doc_ids"].values, row["sources"].values, doc[kept], of[kept], entries[kept] & 0xFFFFFFFF


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, sources, doc, index, count in _vectors(batches):
        bounds = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32())
        order = np.lexsort((index, doc))
        index, count = index[order], count[order]
        arrays = [ids, pa.array([lang] * len(ids), pa.string()), sources, pa.ListArray.from_arrays(bounds, pa.array(index, pa.int32())),
                  pa.ListArray.from_arrays(bounds, pa.array(count, pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", "indices", "counts"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct key and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][cuts], np.add.reduceat(counts[order], cuts) if len(cuts) else counts


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by source and index, combined within the task as long as there are not more than ``SUMS`` of them."""
    names: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def combined() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate([part[k] for part in held]) for k in (0, 1)))

    def told() -> pa.RecordBatch:
        groups, (keys, sums) = list(names), combined()
        at = keys >> 32
        arrays = [pa.array([g[k] for g in groups], pa.string()).take(pa.array(at)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(sums)], ["lang", "source", "index", "n"])

    for lang, _, sources, doc, index, count in _vectors(batches):
        coded = sources.dictionary_encode()
        group = np.array([names.setdefault((lang, s), len(names)) for s in coded.dictionary.to_pylist()], np.int64)
        held.append(_summed(group[coded.indices.to_numpy()[doc]] << 32 | index, count))
        if sum(len(keys) for keys, _ in held) > SUMS:
            held = [combined()]
            if len(held[0][0]) > SUMS // 2:
                yield told()
                names, held = {}, []
    if held:
        yield told()


def document_vectors(docs: DataFrame, min_df: int = MIN_DF, list_terms: int = TERMS) -> Vectors:
    """Vocabularies and vectors of ``docs``. Every row is a document; null text, lang and source are empty; other columns
    are ignored. A document without terms has an empty vector. A-Z count as a-z."""
    small_batches(docs.sparkSession)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )
    chunks = stage(given.mapInArrow(_counter(list_terms), CHUNK), "chunks")
    listed = chunks.where(F.col("terms").isNotNull()).select("lang", F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("lang", F.col("t.terms").alias("term"), "t.dfs")
    known = listed.groupBy("lang", "term").agg(F.sum("dfs").alias("df")).where(F.col("df") >= min_df)
    ranked = global_rank(stage(known, "terms"), ["lang", "term"], "place", "vocabulary")
    first = ranked.groupBy("lang").agg(F.min("place").alias("first"))
    numbered = ranked.join(first, "lang").select("lang", "term", "df", (F.col("place") - F.col("first")).cast("int").alias("index"))
    return Vectors(chunks, stage(numbered, "vocabulary"))


# --- comparison ---------------------------------------------------------------------------------------------------


def _pairs_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sources: by how much terms that both have differ from what ``_pairs_of_counts`` takes them for."""
    for lang, sources, base, dense in _dense(batches):
        for a in range(len(sources) - 1):
            p, q = dense[a], dense[a + 1 :]
            p0, q0 = base[a], base[a + 1 :, None]
            more = (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).sum(axis=1)
            others = np.flatnonzero(more)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(others), pa.string()), pa.array([sources[a]] * len(others), pa.string()),
                 pa.array([sources[a + 1 + o] for o in others], pa.string()), pa.array(more[others])],
                ["lang", "a", "b", "value"],
            )


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
    """Blocks of terms of one language: sources in order, their share of a term they don't have, and all shares."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            rows = batch.take(pa.array(np.flatnonzero(langs.indices.to_numpy() == k)))
            cells = rows.column("cells")
            ends = cells.offsets.to_numpy()[1:] - cells.offsets[0].as_py()
            start = 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, side="right")))
                part = cells.slice(start, stop - start)
                value = part.flatten()
                term = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                names = value.field("source").dictionary_encode()
                total, n = (value.field(c).to_numpy(zero_copy_only=False) for c in ("total", "n"))
                order = pc.sort_indices(names.dictionary).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                at = place[names.indices.to_numpy()]
                base = np.zeros(len(order), np.int64)
                base[at] = shares(np.zeros(len(at), np.int64), total)
                dense = np.repeat(base[:, None], len(part), axis=1)
                dense[at, term] = shares(n, total)
                yield lang, names.dictionary.take(pa.array(order)).to_pylist(), base, dense
                start = stop


def _pairs_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two sources: the sum over the vocabulary if no term were in both. A source's terms of one count go together."""
    for batch in batches:
        values = []
        for row in batch.select(["source", "other", "total", "other_total", "n_vocabulary", "counts"]).to_pylist():
            value = 0
            if row["n_vocabulary"]:
                counts = np.array([(c["n"], c["times"]) for c in row["counts"] or ()], np.int64).reshape(-1, 2)
                p0, q0 = shares(0, row["total"]), shares(0, row["other_total"])
                value = int(((gap(shares(counts[:, 0], row["total"]), q0) - gap(p0, q0)) * counts[:, 1]).sum())
                if row["source"] < row["other"]:
                    value += int(gap(p0, q0)) * row["n_vocabulary"]
            values.append(value)
        least = pc.min_element_wise(batch.column("source"), batch.column("other"))
        largest = pc.if_else(pc.equal(least, batch.column("source")), batch.column("other"), batch.column("source"))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), least, largest, pa.array(values, pa.int64())], ["lang", "a", "b", "value"])


def _over_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms that a source has more of than its language."""
    for batch in batches:
        cells = batch.column("cells")
        value, sizes = cells.flatten(), np.diff(cells.offsets.to_numpy())
        n, total = (value.field(c).to_numpy(zero_copy_only=False) for c in ("n", "total"))
        whole = np.add.reduceat(n, np.cumsum(sizes) - sizes) if len(n) else n
        term = np.repeat(np.arange(batch.num_rows), sizes)
        p = shares(n, total)
        q = shares(whole[term], batch.column("lang_total").to_numpy()[term])
        more = np.flatnonzero(p > q)
        of = pa.array(term[more])
        arrays = [batch.column("lang").take(of), value.field("source").take(pa.array(more)), batch.column("index").take(of), pa.array(gap(p, q)[more])]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "index", "value"])


def divergence_audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language how far every other one is (``pair``), and
    the ``top`` terms that set it apart from the language (``term``); see the contract for the arithmetic, which is exact.

    Null lang, source and text are empty. A source without terms has all shares alike; a language without a vocabulary has
    distances of 0, one with a single source no ``pair`` rows. Ties go to the lesser item. An empty table gives no rows.
    There are as many ``pair`` rows as pairs of sources of a language, because that is the result asked for.
    """
    vectors = document_vectors(docs, min_df)
    sums = stage(vectors.sums(), "sums")
    sizes = vectors.vocabulary.groupBy("lang").agg(F.count("*").alias("n_vocabulary"))
    seen = vectors.chunks.where(F.col("terms").isNull()).select("lang", F.explode(F.array_distinct("sources")).alias("source")).distinct()
    counted = sums.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    counts = counted.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("n_all"), F.collect_list(F.struct("n", "times")).alias("counts"))
    groups = seen.join(counts, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n_all", "n_vocabulary"])
    groups = stage(groups.withColumn("total", F.col("n_all") + PRIOR * F.col("n_vocabulary")), "groups")
    langs = groups.groupBy("lang").agg((F.sum("n_all") + PRIOR * F.max("n_vocabulary")).alias("lang_total"))

    cells = sums.join(groups.select("lang", "source", "total"), ["lang", "source"])
    by_term = cells.groupBy("lang", "index").agg(F.collect_list(F.struct("source", "n", "total")).alias("cells")).join(langs, "lang")
    by_term = stage(by_term, "cells")

    others = groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
    met = groups.join(others, "lang").where(F.col("source") != F.col("other"))
    pair = "lang string, a string, b string, value long"
    both = met.mapInArrow(_pairs_of_counts, pair).unionByName(by_term.mapInArrow(_pairs_of_terms, pair))
    summed = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = summed.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")
    rank = lambda item: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank("item"))

    over = by_term.mapInArrow(_over_language, "lang string, source string, index int, value long")
    best = over.select("*", rank("index")).where(F.col("rank") <= top)  # indices are in the order of the terms
    named = best.join(vectors.vocabulary.select("lang", "index", "term"), ["lang", "index"])
    return pairs.unionByName(named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
parts AS (
  SELECT lang, source, n_all, coalesce(v, 0) AS v FROM (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS n_all FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source) LEFT JOIN sizes USING (lang)),
shares AS (
  SELECT p.lang, p.source, k.term, coalesce(n, 0) AS n,
    CAST(1 + 1000000000 * (coalesce(n, 0) + 2)::HUGEINT // (n_all + 2 * v)::HUGEINT AS BIGINT) AS p
  FROM parts p JOIN kept k ON k.lang = p.lang LEFT JOIN counts c ON c.lang = p.lang AND c.source = p.source AND c.term = k.term),
whole AS (
  SELECT lang, term, CAST(1 + 1000000000 * (sum(n) + 2)::HUGEINT // ((SELECT sum(n_all) FROM parts x WHERE x.lang = counts.lang) + 2 * any_value(v))::HUGEINT AS BIGINT) AS q
  FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
