"""Counts of whole texts and features of their lines, computed for blocks of texts with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tagweave.llm.common import flat, mix, random_words, word_hashes, word_spans

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[list(b"0123456789")] = True
IS_STOP = np.zeros(256, bool)
IS_STOP[list(b".!?:;\"'")] = True
IS_CAPITAL = np.zeros(256, bool)
IS_CAPITAL[65:91] = True
IS_CAPITAL[0xC3] = True  # the first byte of most accented capitals and small letters


@dataclass
class Texts:
    """Of each text: code points in words, symbols, repeated lines, words in repeated 3-word windows; and its lines that have words."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray  # which text each line belongs to
    line_words: np.ndarray
    line_bins: np.ndarray  # a row of bin numbers for each line, a column for each feature


#: Upper bounds of the bins of each feature of a line; a value above the last is in one more bin.
BINS = {
    "words": [2, 5, 12, 30],
    "symbols": [0, 0.02, 0.08, 0.2],  # per byte of the words
    "digits": [0, 0.05, 0.3],
    "repeated": [0, 0.2, 0.5, 0.8],  # share of words in repeated 3-word windows
    "word_length": [2.5, 4, 7, 11],
    "stop": [0.5],  # ends like a sentence
    "capital": [0.5],
    "again": [0.5],  # equals an earlier line
}


def _per(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span are in the mask."""
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[end] - sums[begin]


def _repeated_before(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key of the same owner came before, and whether one is anywhere else."""
    joint = mix(keys ^ mix(owner.astype(np.uint64)))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return before, twice


def measure(column: pa.Array) -> Texts:
    buf, offsets = flat(column)
    n = len(offsets) - 1
    starts, ends, firsts = word_spans(buf, offsets)
    n_words = np.diff(firsts)
    text = np.repeat(np.arange(n), n_words)
    letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = letters[ends] - letters[starts]
    words = word_hashes(buf, starts, ends, 81)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        factor = random_words(82, 3)
        inside = text[2:] == text[:-2]
        three = mix(words[:-2] * factor[0] + words[1:-1] * factor[1] + words[2:] * factor[2])
        twice = np.zeros(len(three), bool)
        twice[inside] = _repeated_before(three[inside], text[:-2][inside])[1]
        for k in range(3):
            covered[k : len(words) - 2 + k] |= twice

    cuts = np.flatnonzero(buf == 10)
    line_of_word = np.searchsorted(cuts, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line_of_word[1:] != line_of_word[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) if len(head) else head
    line_text = text[head]
    before = np.concatenate([[-1], cuts])[line_of_word[head]] + 1
    after = np.concatenate([cuts, [len(buf)]])[line_of_word[head]]
    begin, end = np.maximum(before, offsets[:-1][line_text]), np.minimum(after, offsets[1:][line_text])
    again = _repeated_before(word_hashes(buf, begin, end, 83), line_text)[0] if len(head) else new
    size = tail - head
    share = lambda mask: _per(mask, starts[head], ends[tail - 1]) / np.maximum(1, ends[tail - 1] - starts[head])
    values = {
        "words": size,
        "symbols": share(IS_SYMBOL[buf]),
        "digits": share(IS_DIGIT[buf]),
        "repeated": _per(covered, head, tail) / np.maximum(1, size),
        "word_length": _per_sum(chars, head, tail) / np.maximum(1, size),
        "stop": IS_STOP[buf[ends[tail - 1] - 1]],
        "capital": IS_CAPITAL[buf[starts[head]]],
        "again": again,
    }
    bins = np.stack([np.searchsorted(BINS[name], np.asarray(values[name], float)) for name in BINS], axis=1)
    count = lambda mask, of: np.bincount(of[mask], minlength=n)
    symbols = np.concatenate([[0], np.cumsum(IS_SYMBOL[buf])])
    return Texts(
        n_words, np.bincount(text, chars, n).astype(np.int64), symbols[offsets[1:]] - symbols[offsets[:-1]],
        count(again, line_text), count(covered, text), line_text, size, bins,
    )


def _per_sum(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[end] - sums[begin]


def one_hot(bins: np.ndarray) -> np.ndarray:
    """The bins of all features as numbers in one range."""
    width = np.array([len(b) + 1 for b in BINS.values()])
    return bins + (np.cumsum(width) - width)


N_FEATURES = sum(len(b) + 1 for b in BINS.values())
