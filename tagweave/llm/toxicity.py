"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of its words; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents have labels; the likelihood of the labels trains the words' weights through the
noisy-or, and the sentence probabilities then point at the offending sentences. The prior of a sentence is fixed and
tiny, so that a long clean document does not become suspect by its length.

Training takes a bounded sample of labelled rows; its words and weights are the model that scoring tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tagweave.llm.common import blocks, flat, keyed_rows, release_memory, small_batches, span_hashes, word_spans
from tagweave.llm.labelled import labelled_rows

#: Labelled documents of each class that train at most; chosen by hash.
SAMPLE = 2000
#: Log-odds that a sentence without evidence is toxic: one in 160,000.
PRIOR = -12.0
#: Labelled documents that must have a word before it gets a weight.
LEAST_DOCS = 3
#: Penalty on the sum of the weights' sizes, and rounds of fitting.
PENALTY, ROUNDS = 0.5, 400
#: Standard errors that a feature's log-odds must exceed zero by.
DOUBT = 2.0
THRESHOLD = 0.7

#: Words are runs of ASCII letters and digits and of any bytes over 127; sentences end at . ! ? and line feeds.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
STOPS = np.zeros(256, bool)
STOPS[list(b".!?\n")] = True

#: Bytes of the prefixes that are features beside the word, for inflected and compound forms.
PREFIXES = (4, 5)


@dataclass(frozen=True)
class Model:
    """Sorted hashes of words, and their weights."""

    words: np.ndarray
    weights: np.ndarray


@dataclass
class Bags:
    """The features of the sentences of some texts: hashes, each sentence's first one, text, and span in bytes.

    A word's features are the word and its prefixes; a short word counts as its own prefix.
    """

    hashes: np.ndarray
    first: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def sentences(column: pa.Array) -> Bags:
    """Sentences that have words."""
    buf, offsets = flat(column)
    starts, ends, _ = word_spans(buf, offsets, APART)
    text = np.searchsorted(offsets[1:], starts, side="right")
    stops = np.flatnonzero(STOPS[buf]) if len(buf) else starts
    number = np.searchsorted(stops, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    heads = [np.minimum(ends, starts + size) for size in PREFIXES]
    spans = np.stack([ends, *heads], axis=1)
    marks = np.arange(spans.shape[1], dtype=np.uint64) * (spans < ends[:, None])  # a prefix is no word
    hashes = np.zeros(0, np.uint64)
    if len(starts):
        hashes = span_hashes(buf, np.repeat(starts, spans.shape[1]), spans.ravel(), 61, lower=True) + marks.ravel()
    return Bags(hashes, first * spans.shape[1], text[first], starts[first], ends[last], offsets)


def _present(bags: Bags, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sentence, feature`` for each of the ``words`` in each sentence, once."""
    at = np.minimum(np.searchsorted(words, bags.hashes), len(words) - 1)
    hit = np.flatnonzero(words[at] == bags.hashes)
    own = np.searchsorted(bags.first, hit, side="right") - 1
    once = np.unique(own * len(words) + at[hit])
    return once // len(words), once % len(words)


def sentence_logits(bags: Bags, model: Model) -> np.ndarray:
    """The log-odds of each sentence: the prior and the weights of its features, each counted once."""
    if not len(model.words):
        return np.full(len(bags.first), PRIOR)
    own, feature = _present(bags, model.words)
    return PRIOR + np.bincount(own, model.weights[feature], len(bags.first))


def noisy_or(logits: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """1 - prod(1 - p) of each text's sentences; 0 for a text without sentences."""
    return -np.expm1(-np.bincount(text, np.logaddexp(0, logits), n_texts))


def _tally(parts: list[pa.RecordBatch], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all texts, and how many toxic and other texts have each. Blocks are added up one by one."""
    words, toxic, other, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in parts:
        bags = sentences(part.column("text"))
        own, index = np.unique(bags.hashes, return_inverse=True)
        text = np.repeat(bags.text, np.diff(np.append(bags.first, len(bags.hashes))))
        seen = np.unique(text * np.int64(max(1, len(own))) + index)
        of_good = good[done + seen // max(1, len(own))]
        of_word = seen % max(1, len(own))
        words.append(own)
        toxic.append(np.bincount(of_word[of_good], minlength=len(own)))
        other.append(np.bincount(of_word[~of_good], minlength=len(own)))
        done += part.num_rows
    word, index = np.unique(np.concatenate(words), return_inverse=True)
    return word, *(np.bincount(index, np.concatenate(c), len(word)) for c in (toxic, other))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Weights of words that make the labels likely, by proximal steps of adaptive length from a first guess.

    Only features that are more frequent in toxic documents beyond chance can speak for toxicity; the others weigh
    nothing, so clean words never excuse a sentence. The penalty takes the weight from features that add nothing. The
    texts are read block by block, first to count features, then to keep the few chosen ones of each sentence.
    """
    n, good = len(texts), labels.astype(bool)
    parts = list(blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], "text"))
    word, c1, c0 = _tally(parts, good)
    p1, p0 = (c1 + 0.5) / (max(1, good.sum()) + 1), (c0 + 0.5) / (max(1, (~good).sum()) + 1)
    beyond = np.log(p1 / p0) - DOUBT * np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    chosen = np.flatnonzero((beyond > 0) & (c1 + c0 >= LEAST_DOCS))
    guess = Model(word[chosen], 3.0 * beyond[chosen])
    if not len(chosen) or not good.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    token, sentence, text, rows = [], [], [], 0
    for part in parts:
        bags = sentences(part.column("text"))
        own, feature = _present(bags, guess.words)
        token.append(feature)
        sentence.append(own + sum(map(len, text)))
        text.append(bags.text + rows)
        rows += part.num_rows
    token, sentence, text = np.concatenate(token), np.concatenate(sentence), np.concatenate(text)
    theta = guess.weights
    size = np.full(len(theta), 1e-6)
    for _ in range(ROUNDS):
        logits = PRIOR + np.bincount(sentence, theta[token], len(text))
        total = np.bincount(text, np.logaddexp(0, logits), n)
        pull = np.where(good, 1 / np.expm1(np.clip(total, 1e-9, 50)), -1.0) * weights
        chance = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
        slope = np.bincount(token, (pull[text] * chance)[sentence], len(theta))
        size += slope * slope
        step = 1.0 / np.sqrt(size)
        theta = np.maximum(0, theta + step * slope - step * PENALTY)
    kept = np.flatnonzero(theta)
    return Model(guess.words[kept], theta[kept])


def held_out(doc_id: str = "doc_id"):
    """The third of the rows that never trains."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled documents of each class that are not held out.

    Labels are ``doc_id, toxic``; nulls are ignored, a document with several labels is toxic if any says so.
    """
    rows = labelled_rows(docs, labels, "toxic", sample, "sample", ~F.coalesce(held_out("l_id"), F.lit(False)))
    # bounded by the sample, so one task takes it; the driver gets the words and weights only
    small_batches(docs.sparkSession)
    given = rows.coalesce(1).sortWithinPartitions("l_id").select("text", "y", "weight")
    learned = given.mapInArrow(_fitted, "word long, weight double").toArrow()
    return Model(learned.column("word").to_numpy().view(np.uint64), learned.column("weight").to_numpy())


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows ``text, y, weight``, as ``word, weight`` by word."""
    parts = list(batches)
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    truth = rows.column("y").to_numpy().astype(np.int64)
    share = dict(zip(truth.tolist(), rows.column("weight").to_pylist(), strict=True))
    weights = np.where(truth == 1, 1.0, share.get(0, 1.0) / share.get(1, 1.0))
    model = fit(rows.column("text").to_pylist(), truth, weights)
    yield pa.RecordBatch.from_arrays([pa.array(model.words.view(np.int64)), pa.array(model.weights)], ["word", "weight"])
    release_memory()


def _scored(model):
    """model: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for block in blocks(batches, "text"):
            bags = sentences(block.column("text"))
            logits = sentence_logits(bags, model.value)
            score = noisy_or(logits, bags.text, block.num_rows)
            bad: list[list[dict]] = [[] for _ in range(block.num_rows)]
            for s in np.flatnonzero(logits > 0).tolist():
                base = bags.offsets[bags.text[s]]
                bad[bags.text[s]].append({"begin": int(bags.begin[s] - base), "end": int(bags.end[s] - base), "score": float(1 / (1 + np.exp(-logits[s])))})
            rest = [c for c in block.schema.names if c != "text"]
            columns = [*(block.column(c) for c in rest), pa.array(score), pa.array(bad, spans)]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "score", "offending"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, predicted, offending`` of every row of ``docs`` (``doc_id, text``).

    ``offending`` lists the sentences that are toxic more likely than not, as byte ranges with their probability. Null,
    empty and blank texts score 0. Equal texts score alike; null ids are kept; other columns are ignored. Without any
    usable label every score is that of the prior.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    schema = "doc_id long, score double, offending array<struct<begin:int, end:int, score:double>>"
    found = chosen.mapInArrow(_scored(model), schema)
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: ``doc_id, held_out, score, predicted``."""
    return toxicity(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    whole = keyed_rows(docs).select("text", "row")
    spans = ArrayType(StructType().add("begin", "integer").add("end", "integer").add("score", "double"))
    schema = StructType().add("row", whole.schema["row"].dataType).add("score", "double").add("offending", spans)
    return whole.mapInArrow(_scored(model), schema).where(F.col("score") < THRESHOLD).select("row.*")
