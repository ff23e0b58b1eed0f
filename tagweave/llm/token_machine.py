"""A byte-level BPE tokenizer compiled into two deterministic transducers that count tokens without making them.

The first, in ``words``, cuts text into words; a chunk of characters is a map of its states, and a prefix scan composes
the maps of all chunks. The second merges inside a word. After some bytes its state holds, for every place where a token
that is not yet complete may have begun, the tree node reached from there, the last token before it, and how many tokens
fewer there were; a transition is annotated with the tokens it adds (or takes back), so the annotations along a word add
up to its number of tokens. That works because a sequence of tokens is what the merges give exactly if every two
neighbours are what the merges give for their bytes, so that what has been read decides the last token. States are
numbered as they are first reached: from the words of the vocabulary when it is compiled, others where a text needs them.
"""

from __future__ import annotations

import json

import numpy as np

from tagweave.llm.bpe import byte_letters

#: No token yet; nothing consumes a whole token.
NONE, NEVER = -1, 1 << 60

#: Transitions that a task compiles beyond those it was given, and words that it remembers; then it drops them.
MORE, WORDS, WORD_BYTES = 1 << 19, 1 << 17, 32


class Machine:
    """The compiled vocabulary. Plain arrays and dicts, so that it can be sent to tasks."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or odd or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.token_bytes = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        number = {token: n for n, token in enumerate(self.token_bytes)}
        if len(number) < len(self.token_bytes):
            raise ValueError("a token is made by two merges")
        #: The two parts of a token that is 256 or more; its number is its rank.
        self.parts = [(NONE, NONE)] * 256 + [(number[a], number[b]) for a, b in merges]
        self.joined = {pair: n for n, pair in enumerate(self.parts) if n >= 256}
        self.usable = [True] * 256
        for n in range(256, len(self.parts)):  # else the merges for its bytes end otherwise, and it never comes out
            a, b = self.parts[n]
            self.usable.append(self.usable[a] and self.usable[b] and self._first_joined(a, b) == n)
        self._grow_tree()
        self.allowed: dict[tuple[int, int], bool] = {}
        self.numbers, self.states, self.steps = {((0, NONE, 0),): 0}, [((0, NONE, 0),)], {}
        for token in self.token_bytes:
            self.count(token)
        self.base = len(self.states), len(self.steps)
        self.allowed, self.known = {}, {}

    def _edge(self, token: int, side: int) -> list[int]:
        """What stands at a token's edge while it is merged together, from the single byte to the token."""
        out = [token]
        while out[-1] >= 256:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def _first_joined(self, left: int, right: int) -> int | None:
        """The token that first joins bytes of two neighbours while the merges work on their bytes, if any."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            consumes_a = a[i + 1] if i + 1 < len(a) else NEVER
            consumes_b = b[j + 1] if j + 1 < len(b) else NEVER
            across = self.joined.get((a[i], b[j]), NEVER)
            if across < consumes_a and across <= consumes_b:  # of equal ranks the leftmost goes first
                return across
            if consumes_a == consumes_b == NEVER:
                return None
            if consumes_a <= consumes_b:
                i += 1
            else:
                j += 1

    def _may_follow(self, last: int, token: int) -> bool:
        if last == NONE:
            return True
        known = self.allowed.get((last, token))
        if known is None:
            known = self.allowed[last, token] = self._first_joined(last, token) is None
        return known

    def _grow_tree(self) -> None:
        """The tree of the usable tokens' bytes: children by 256 * node + byte, each node's token, which nodes have children."""
        self.child, self.token_at, self.inner = {}, [NONE], {0}
        for n, token in enumerate(self.token_bytes):
            node = 0
            for byte in token if self.usable[n] else b"":
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(NONE)
                    self.inner.add(node)
                node = self.child[key]
            if node:
                self.token_at[node] = n

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state at a byte: 256 * next state + annotation + 128."""
        open_places, token, added = [], NONE, 0
        for node, last, fewer in self.states[state]:  # the longest token first
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            if token == NONE and self.token_at[child] != NONE and self._may_follow(last, self.token_at[child]):
                token, added = self.token_at[child], fewer + 1
            if child in self.inner:
                open_places.append((child, last, fewer))
        reached = (*((node, last, fewer - added) for node, last, fewer in open_places), (0, token, 0))
        number = self.numbers.get(reached)
        if number is None:
            number = self.numbers[reached] = len(self.states)
            self.states.append(reached)
        if not -128 <= added < 128:
            raise ValueError("annotation out of range")
        step = self.steps[state << 8 | byte] = number << 8 | added + 128
        return step

    def count(self, word: bytes) -> int:
        """The number of tokens of a word."""
        get, state, total = self.steps.get, 0, -128 * len(word)
        for byte in word:
            step = get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            total += step & 255
            state = step >> 8
        return total

    def counts(self, words: list[bytes]) -> np.ndarray:
        """``count`` of many words; forgets what was compiled here when it has become too much."""
        known, out = self.known, np.empty(len(words), np.int64)
        for n, word in enumerate(words):
            number = known.get(word)
            if number is None:
                number = self.count(word)
                if len(word) <= WORD_BYTES:
                    known[word] = number
            out[n] = number
        if len(known) > WORDS:
            known.clear()
        if len(self.steps) > self.base[1] + MORE or len(self.allowed) > MORE:
            for key in list(self.steps)[self.base[1] :]:
                del self.steps[key]
            for reached in self.states[self.base[0] :]:
                del self.numbers[reached]
            del self.states[self.base[0] :]
            self.allowed.clear()
        return out
