"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strands.

All strands are read from the right. Round ``j`` inserts, for each strand that still has one, the suffix of ``j``
letters among the suffixes inserted so far. Its place follows from the transform alone: the suffix ``cX`` comes after
all suffixes that begin with a smaller letter, and after as many ``c``-suffixes as the transform has ``c`` before the
place of ``X``. The transform is kept as the sorted list of pairs (letter, place), which for a large alphabet is its
natural form: the pairs below (c, place of X) are exactly the suffixes before ``cX``. The common prefix of ``cX`` and its
neighbour ``cY`` is one more than that of ``X`` and ``Y``, the least entry between the two in the previous round.

The list of pairs, the common prefixes and the owners live in files; each round reads them in order and writes them
anew. A letter is a run of bytes of the text, so a strand has few letters and few rounds are needed.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

LOW = (1 << 32) - 1


class SuffixFiles:
    """The state between two rounds, in three sequential files."""

    KINDS = (("pairs", np.int64), ("prefixes", np.uint8), ("numbers", np.int32))

    def __init__(self, folder: str):
        self.folder = folder

    def read(self) -> list[np.ndarray]:
        return [np.fromfile(os.path.join(self.folder, name), kind) for name, kind in self.KINDS]

    def write(self, arrays: list[np.ndarray]) -> None:
        for (name, kind), array in zip(self.KINDS, arrays, strict=True):
            array.astype(kind, copy=False).tofile(os.path.join(self.folder, name))


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ``values[lo:hi]`` for each pair ``lo < hi``."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1  # 2**level <= hi - lo
    table, at = values, 0
    for step in range(int(level.max(initial=-1)) + 1):
        if step:
            half = 1 << (step - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == step)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << step)])
    return out


def repeated_suffixes(letters: np.ndarray, bounds: np.ndarray, least: int, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``owners, lengths`` of the suffixes that share their first ``least`` letters with another suffix.

    ``letters`` has the letters (numbers from 0) of all strands in a row, ``bounds`` where each strand begins, and the end.
    A strand stands for ``copies`` equal ones, which would lie side by side with all their letters in common.
    """
    sizes = np.diff(bounds)
    m = len(sizes)
    place = np.arange(m, dtype=np.int64)  # of each strand's last inserted suffix
    strands = [place]  # the strands of the suffixes, in the order in which they were inserted
    count = m
    with tempfile.TemporaryDirectory() as folder:
        files = SuffixFiles(folder)
        files.write([place, np.zeros(m, np.uint8), place])
        for j in range(1, int(sizes.max(initial=0)) + 1):
            pairs, prefixes, numbers = files.read()
            n = len(pairs)
            active = np.flatnonzero(sizes >= j)
            new = (letters[bounds[1:][active] - j].astype(np.int64) + 1) << 32 | place[active]
            order = np.argsort(new)  # no two are equal
            active, new = active[order], new[order]
            at = np.searchsorted(pairs, new)  # old suffixes before each new one
            spot = at + np.arange(len(new))

            # Common prefixes of the new suffixes with what comes before, and of old ones that a new one now precedes.
            alone = np.ones(len(new), bool)
            alone[1:] = at[1:] != at[:-1]
            left = np.where(alone, pairs[np.maximum(at - 1, 0)], np.concatenate([new[:1], new[:-1]]))
            last = np.append(alone[1:], True) & (at < n)
            after = pairs[np.minimum(at, n - 1)]
            one, two = np.concatenate([left, new[last]]), np.concatenate([new, after[last]])
            same = np.flatnonzero((one >> 32 == two >> 32) & (two > LOW))
            shared = np.zeros(len(one), np.uint8)
            shared[same] = np.minimum(_range_minima(prefixes, (one[same] & LOW) + 1, (two[same] & LOW) + 1), least - 1) + 1
            prefixes[at[last]] = shared[len(new) :]

            old = np.ones(n + len(new), bool)
            old[spot] = False
            moved = np.flatnonzero(old)
            tails = pairs & LOW
            np.subtract(pairs, tails, out=pairs)
            tails[m:] = moved[tails[m:]]  # the empty suffixes, which come first, have no tails
            pairs += tails
            tail = new & LOW
            fresh = []
            for before, own in (
                (pairs, new - tail + moved[tail]),
                (prefixes, shared[: len(new)]),
                (numbers, np.arange(count, count + len(new), dtype=np.int32)),
            ):
                whole = np.empty(len(old), before.dtype)
                whole[old] = before
                whole[spot] = own
                fresh.append(whole)
            files.write(fresh)
            place = moved[place]
            place[active] = spot
            strands.append(active)
            count += len(new)
        _, prefixes, numbers = files.read()
    owners = np.concatenate(strands)[numbers]
    lengths = np.repeat(np.arange(len(strands)), list(map(len, strands)))[numbers]
    deep = prefixes >= least
    deep[:-1] |= deep[1:]
    deep |= (copies[owners] > 1) & (lengths >= least)
    return owners[deep], lengths[deep]
