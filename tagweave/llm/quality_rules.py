"""Quality rules on counts, and a chain of line labels: content or boilerplate.

A linear-chain conditional random field scores each line by binned features and each pair of neighbours by their
labels; Viterbi decoding labels the lines of a document, and the share of its words in content lines decides.

Only documents are labelled, lines are not: whether a line agrees with its document's label is hidden. Training first
goes in rounds over the lines by themselves: with a stated leaning of each line toward its document's label, every line
has a chance of either label, and the weights of the features are moved to make these likely. So lines of a good document
that look like those of bad ones become boilerplate. The labels found, without any leaning, are then what the whole
chain is fitted to by forward and backward sums: its steps learn how one kind follows the other. (With the leaning in
them, steps would learn that all lines of a document are alike.) Decoding knows no document label. Training takes a bounded
sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import blocks, small_batches
from tagweave.llm.labelled import sample_labelled
from tagweave.llm.text_stats import N_FEATURES, Texts, measure, one_hot

#: Labelled documents of each class that train at most.
SAMPLE = 1000
#: Lines of a training chain; longer documents give several chains.
CHAIN = 32
#: Rounds of training, gradient steps in each, their length, and how weights are held back.
ROUNDS, STEPS, STEP, DECAY = 4, 40, 0.15, 1e-3
#: How much a line leans toward its document's label before it is looked at: as log odds.
LEANING = 1.5
#: Share of words in content lines from which a document stays.
LEAST_CONTENT = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50

CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class Chain:
    """``lines``: the weight of each feature for boilerplate against content; ``steps[a, b]``: of ``b`` after ``a``; ``start``."""

    lines: np.ndarray
    steps: np.ndarray
    start: np.ndarray


def marginals(scores: np.ndarray, used: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """By forward and backward sums: the chance of each label at each place, and of each pair of labels at each step.

    ``scores[c, t, y]`` of padded chains, ``used[c, t]``: whether chain ``c`` has a line ``t``.
    """
    n, length, _ = scores.shape
    forward, backward = np.zeros(scores.shape), np.zeros(scores.shape)
    forward[:, 0] = chain.start + scores[:, 0]
    for t in range(1, length):
        forward[:, t] = scores[:, t] + np.logaddexp(*(forward[:, t - 1, y, None] + chain.steps[y] for y in (0, 1)))
    for t in range(length - 2, -1, -1):
        ahead = scores[:, t + 1] + backward[:, t + 1]
        back = np.logaddexp(*(ahead[:, y, None] + chain.steps[:, y] for y in (0, 1)))
        backward[:, t] = np.where(used[:, t + 1, None], back, 0.0)
    whole = forward + backward
    total = np.logaddexp(whole[:, 0, 0], whole[:, 0, 1])[:, None, None]
    at = np.exp(whole - total) * used[..., None]
    pair = forward[:, :-1, :, None] + chain.steps + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
    return at, np.exp(np.minimum(pair - total[..., None], 0)) * used[:, 1:, None, None]


@dataclass(frozen=True)
class Padded:
    """Chains of lines, padded to one length: feature bins, which places are lines, and what each line counts."""

    bins: np.ndarray
    used: np.ndarray
    weight: np.ndarray

    def scores(self, chain: Chain) -> np.ndarray:
        out = np.zeros((*self.used.shape, 2))
        out[..., 1] = chain.lines[self.bins].sum(axis=2)
        return out


def _climb(chains: Padded, chain: Chain, at: np.ndarray, pair: np.ndarray | None, steps: int) -> Chain:
    """Gradient steps of adaptive length toward weights that make the chances of labels ``at`` and of pairs ``pair`` likely.

    Without ``pair`` only the weights of the lines move.
    """
    seen = at * chains.weight[..., None]
    pairs = None if pair is None else pair * chains.weight[:, 1:, None, None]
    size = [np.full_like(a, 1e-8) for a in (chain.lines, chain.steps, chain.start)]
    hold = DECAY * len(chains.used)
    for _ in range(steps):
        now, step = marginals(chains.scores(chain), chains.used, chain)
        now, step = now * chains.weight[..., None], step * chains.weight[:, 1:, None, None]
        gap = ((seen - now)[..., 1])[chains.used]
        slopes = [
            np.bincount(chains.bins[chains.used].ravel(), np.repeat(gap, chains.bins.shape[2]), N_FEATURES) - hold * chain.lines,
            np.zeros((2, 2)) if pairs is None else (pairs - step).sum(axis=(0, 1)) - hold * chain.steps,
            np.zeros(2) if pairs is None else (seen - now)[:, 0].sum(axis=0) - hold * chain.start,
        ]
        moved = []
        for old, slope, total in zip((chain.lines, chain.steps, chain.start), slopes, size, strict=True):
            total += slope * slope
            moved.append(old + STEP * slope / np.sqrt(total))
        chain = Chain(*moved)
    return chain


def fit(texts: list[str], bad: list[int], weights: list[float]) -> Chain:
    """Weights from documents whose labels their lines lean to, by rounds of hidden labels and gradient steps."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    features, leaning, place, worth = [], [], [], []
    done = 0
    for block in blocks([batch], "text"):
        found = measure(block.column("text"))
        bins = one_hot(found.line_bins)
        first = np.searchsorted(found.line_text, np.arange(block.num_rows + 1))
        for n in range(block.num_rows):
            for lo in range(first[n], first[n + 1], CHAIN):
                hi = min(lo + CHAIN, first[n + 1])
                place.append(hi - lo)
                worth.append(weights[done + n])
                features.append(bins[lo:hi])
                leaning.append(LEANING if bad[done + n] else -LEANING)
        done += block.num_rows
    chain = Chain(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))
    if not place:
        return chain
    used = np.arange(max(place)) < np.array(place)[:, None]
    bins = np.zeros((*used.shape, features[0].shape[1]), np.int64)
    bins[used] = np.concatenate(features)
    # a chain counts as its document does, however long
    chains = Padded(bins, used, (np.array(worth) / np.array(place))[:, None] * used)
    lean = np.zeros((*used.shape, 2))
    lean[..., 1] = np.array(leaning)[:, None]
    for _ in range(ROUNDS):
        chain = _climb(chains, chain, marginals(chains.scores(chain) + lean, used, chain)[0], None, STEPS)
    label = (chains.scores(chain)[..., 1] > 0).astype(np.int64)
    at = np.eye(2)[label] * used[..., None]
    pair = np.eye(4)[label[:, :-1] * 2 + label[:, 1:]].reshape(*label[:, 1:].shape, 2, 2) * used[:, 1:, None, None]
    return _climb(chains, chain, at, pair, 2 * STEPS)


def viterbi(scores: list[float], chain: Chain) -> list[int]:
    """The likeliest labels of a chain of lines. ``scores``: boilerplate against content."""
    (cc, cb), (bc, bb) = chain.steps.tolist()
    c, b = chain.start.tolist()
    back = []
    for n, score in enumerate(scores):
        if n:
            from_c, from_b = c + cc >= b + bc, c + cb >= b + bb
            back.append((from_c, from_b))
            c, b = (c + cc if from_c else b + bc), (c + cb if from_b else b + bb)
        b += score
    label = CONTENT if c >= b else BOILERPLATE
    out = [label]
    for step in reversed(back):
        label = CONTENT if step[label] else BOILERPLATE
        out.append(label)
    return out[::-1] if scores else []


def label_lines(found: Texts, chain: Chain) -> np.ndarray:
    """Of each line that has words, whether it is boilerplate."""
    scores = chain.lines[one_hot(found.line_bins)].sum(axis=1).tolist()
    first = np.searchsorted(found.line_text, np.arange(len(found.n_words) + 1)).tolist()
    labels = [y for a, b in zip(first, first[1:]) for y in viterbi(scores[a:b], chain)]
    return np.array(labels, bool)


def _judged(shared):
    """shared: a broadcast of the chain."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = measure(block.column("text"))
            good = ~label_lines(found, shared.value)
            content = np.bincount(found.line_text[good], found.line_words[good], len(found.n_words)) / np.maximum(1, found.n_words)
            failed = (found.n_words < MIN_WORDS) | (100 * found.n_repeat_words > MAX_REPEATED * found.n_words)
            counts = (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words)
            columns = [*(c.astype(np.int64) for c in counts), failed, ~failed & (content >= LEAST_CONTENT), content]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *map(pa.array, columns)], names)

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """``labels``: ``doc_id, quality``, above zero for good documents."""
    rows = sample_labelled(docs, labels, "quality", sample)
    return fit([text for text, *_ in rows], [1 - good for _, good, _ in rows], [weight for *_, weight in rows])


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``content_share`` of every row of ``docs`` (``doc_id, text``).

    Null, empty and blank texts have no words and fail the base rules. A tie between labels is content. Equal texts are
    judged alike; null ids stay; other columns are ignored. Without usable labels every line is content.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, content_share double"
    )
    return chosen.mapInArrow(_judged(chain), schema)
