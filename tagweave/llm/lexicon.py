"""A minimal acyclic transducer that maps words to lists of token ids, in one flat buffer that can be memory-mapped.

Equal endings share their states. Each arc carries an output number; their sum along a word is the word's rank among
all words, and the rank points into the table of ids. Outputs on arcs keep the endings shareable: states that only
differ in what they would put out are one state.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Mapping, Sequence

import numpy as np

MAGIC = 0x54574C58
ARRAYS = (("arcs", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.int32), ("bounds", np.int32), ("ids", np.int32))


def compile_lexicon(words: Mapping[bytes, Sequence[int]]) -> bytes:
    """The transducer of ``words``, each with its ids. States are numbered so that arcs sort by (state, byte)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def frozen(node: list) -> int:
        """The number of the one state with this finality and these arcs."""
        shape = (node[0], tuple(node[1]))
        if shape not in register:
            register[shape] = len(states)
            states.append(shape)
        return register[shape]

    ordered = sorted(words)
    path = [[False, []]]  # of the last word: states that may still get arcs
    last = b""
    for word in ordered:
        shared = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), shared, -1):
            path[depth - 1][1].append((last[depth - 1], frozen(path.pop())))
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], frozen(path.pop())))
    root = frozen(path[0])

    below = np.zeros(len(states), np.int64)  # words that a state accepts; a state's targets have smaller numbers
    arcs, targets, outputs = [], [], []
    for number, (final, out) in enumerate(states):
        before = int(final)
        for byte, target in out:
            arcs.append(number << 8 | byte)
            targets.append(target)
            outputs.append(before)
            before += below[target]
        below[number] = before
    lists = [words[w] for w in ordered]
    data = {
        "arcs": arcs, "targets": targets, "outputs": outputs, "final": [s[0] for s in states],
        "bounds": np.cumsum([0, *map(len, lists)]), "ids": [i for ids in lists for i in ids],
    }
    body = [np.asarray(data[name], kind) for name, kind in ARRAYS]
    head = np.array([MAGIC, root, *map(len, body)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in body)


class Lexicon:
    """Reads a compiled transducer from a buffer."""

    def __init__(self, buffer: bytes | mmap.mmap):
        head = np.frombuffer(buffer, np.int64, 2 + len(ARRAYS))
        if head[0] != MAGIC:
            raise ValueError("not a compiled lexicon")
        self.root, at = int(head[1]), head.nbytes
        for (name, kind), size in zip(ARRAYS, head[2:], strict=True):
            array = np.frombuffer(buffer, kind, int(size), at)
            setattr(self, name, array)
            at += array.nbytes + -array.nbytes % 8

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The lexicon from a memory-mapped file, which has no name any more once it is mapped."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """The rank of each word, or -1; all words go through the transducer together, byte by byte."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        buf = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.root, np.int64)
        rank = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        at = 0
        while True:
            alive = alive[lengths[alive] > at]
            if not len(alive) or not len(self.arcs):
                break
            wanted = state[alive] << 8 | buf[begins[alive] + at]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            hit = self.arcs[arc] == wanted
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            rank[alive] += self.outputs[arc]
            state[alive] = self.targets[arc]
            at += 1
        if not len(self.arcs):
            state[lengths > 0] = -1
        known = (state >= 0) & (self.final[state] == 1)
        return np.where(known, rank, -1)

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.bounds[rank] : self.bounds[rank + 1]].tolist()
