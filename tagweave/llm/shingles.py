"""Sets of word shingles and their MinHash signatures, computed for blocks of whole texts with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tagweave.llm.common import flat, mix, random_words, word_hashes, word_spans

#: Words in a shingle.
WIDTH = 5


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, all in a row, and where each text's begin.

    A-Z count as a-z. A text of fewer than ``width`` words has its whole sequence as one shingle, none without words.
    """
    buf, offsets = flat(column)
    starts, ends, firsts = word_spans(buf, offsets)
    words = word_hashes(buf, starts, ends, 1, lower=True)
    factor = random_words(7, width)
    counts = np.diff(firsts)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs += words[k : k + len(runs)] * factor[k]
    runs = mix(runs)
    sets = []
    for first, count in zip(firsts[:-1].tolist(), counts.tolist(), strict=True):
        if count >= width:
            own = np.sort(runs[first : first + count - width + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            sets.append(own[keep])
        elif count:
            whole = (words[first : first + count] * factor[:count]).sum(dtype=np.uint64)
            sets.append(mix(np.array([whole + np.uint64(count)], np.uint64) * np.uint64(0xA24BAED4963EE407)))
        else:
            sets.append(runs[:0])
    bounds = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else runs[:0]), bounds


def minima(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Of each non-empty set the minima under ``n`` universal hash functions a x + b modulo 2**32; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    x = hashes.astype(np.uint32)
    seeds = random_words(11, 2 * n)
    value = np.empty_like(x)
    for j in range(n):
        np.multiply(x, np.uint32(int(seeds[2 * j]) & 0xFFFFFFFF | 1), out=value)
        np.add(value, np.uint32(int(seeds[2 * j + 1]) & 0xFFFFFFFF), out=value)
        out[full, j] = np.minimum.reduceat(value, bounds[:-1][full])
    return out


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; equal sets have equal digests."""
    out = []
    for seed in (21, 22):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ random_words(seed, 1)[0]), out=sums[1:])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]
