"""Byte-level BPE's words of many texts at once: a deterministic transducer over classes of characters.

It has a dozen states, and its transitions say where words begin: before the character read, or, where that hangs on
what follows, before the one ahead of it. A chunk of characters is a map from states to states; maps compose, so all
chunks run at once and a prefix scan finds the states in which they begin.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tagweave.llm.common import IS_SPACE

#: Classes of characters; letters are those from LETTER to LETTER_E.
END, LETTER, LETTER_STMD, LETTER_RV, LETTER_L, LETTER_E, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER = range(11)
N_CLASSES = 16

#: States: what the word read last is so far. SHORT_* is a single white space, LONG_* a run of several, by the last one.
(INIT, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_RV, QUOTE_L, ENDED, SHORT_BLANK, SHORT_SPACE, LONG_BLANK, LONG_SPACE) = range(12)
N_STATES = 12

#: The characters of the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Characters of a chunk; bytes after which a text is cut at the next white space that follows a word.
CHUNK, SEGMENT = 64, 4 << 20


def character_classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    for chars, value in (("stmd", LETTER_STMD), ("rv", LETTER_RV), ("l", LETTER_L), ("e", LETTER_E), (" ", BLANK), ("'", APOSTROPHE)):
        out[list(map(ord, chars))] = value
    return out


def _begin(c: int) -> int:
    """The state after the first character of a word."""
    if LETTER <= c <= LETTER_E:
        return LETTERS
    return {END: INIT, NUMBER: NUMBERS, BLANK: SHORT_BLANK, SPACE: SHORT_SPACE, APOSTROPHE: QUOTE, OTHER: OTHERS}[c]


def _step(state: int, c: int) -> tuple[int, bool, bool]:
    """The next state, whether a word begins before this character, and whether one begins before the last character."""
    letter, white = LETTER <= c <= LETTER_E, c in (BLANK, SPACE)
    if state in (INIT, ENDED) or c == END:
        return _begin(c), True, state in (QUOTE_RV, QUOTE_L)
    if state in (LETTERS, NUMBERS, OTHERS):
        same = {LETTERS: letter, NUMBERS: c == NUMBER, OTHERS: c in (APOSTROPHE, OTHER)}[state]
        return (state, False, False) if same else (_begin(c), True, False)
    if state == QUOTE:
        if c in (LETTER_STMD, LETTER_RV, LETTER_L):
            return {LETTER_STMD: ENDED, LETTER_RV: QUOTE_RV, LETTER_L: QUOTE_L}[c], False, False
        return (OTHERS, False, False) if c in (APOSTROPHE, OTHER) else (_begin(c), True, False)
    if state in (QUOTE_RV, QUOTE_L):
        if c == (LETTER_E if state == QUOTE_RV else LETTER_L):
            return ENDED, False, False
        return (LETTERS, False, True) if letter else (_begin(c), True, True)
    if white:
        return (LONG_BLANK if c == BLANK else LONG_SPACE), False, False
    long = state in (LONG_BLANK, LONG_SPACE)
    if state in (SHORT_BLANK, LONG_BLANK):  # the last blank goes with the word that follows
        return (OTHERS if c == APOSTROPHE else _begin(c)), False, long
    return _begin(c), True, long


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs (1: a word begins here, 2: one began a character ago), by 16 * state + class."""
    following, output = np.zeros(N_STATES * N_CLASSES, np.uint8), np.zeros(N_STATES * N_CLASSES, np.uint8)
    for state in range(N_STATES):
        for c in range(OTHER + 1):
            nxt, here, before = _step(state, c)
            following[state * N_CLASSES + c], output[state * N_CLASSES + c] = nxt, here | before << 1
    return following, output


FOLLOWING, OUTPUT = _tables()


def composed(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins, if the first begins in INIT: a parallel prefix scan over the chunks' maps."""
    scan, gap = maps.copy(), 1
    while gap < len(scan):
        later = np.take_along_axis(scan[gap:], scan[:-gap].astype(np.intp), axis=1)  # first the earlier map, then the later
        scan[gap:] = later
        gap *= 2
    return np.concatenate([[INIT], scan[:-1, INIT]]).astype(np.uint8)


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character; END is a word by itself."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    padded = np.zeros(lanes * CHUNK, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for column in columns:
        maps = FOLLOWING[maps * np.uint8(N_CLASSES) + column]
    state = composed(maps.T)
    out = np.empty((CHUNK, lanes), np.uint8)
    for k, column in enumerate(columns):
        key = state * np.uint8(N_CLASSES) + column
        out[k], state = OUTPUT[key], FOLLOWING[key]
    marks = out.T.reshape(-1)
    starts = (marks[:n] & 1).astype(bool)
    starts |= np.append(marks[1:] & 2, 0)[:n].astype(bool)
    return starts


def segments(buf: np.ndarray, bounds: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Where to cut the bytes so that about ``size`` bytes are taken at once: at the end of a piece, or, in a longer one, at a white
    space after something else, where a word begins whatever comes before and after."""
    at, end = 0, len(buf)
    while at < end:
        stop = int(bounds[max(0, np.searchsorted(bounds, at + size, side="right") - 1)])
        if stop <= at:
            stop = int(bounds[np.searchsorted(bounds, at, side="right")])
            look = at + size
            while look < stop:
                white = IS_SPACE[buf[look - 1 : look + 4096]]
                found = np.flatnonzero(white[1:] & ~white[:-1] & (buf[look - 1 : look - 2 + len(white)] < 128))
                if len(found):
                    stop = min(stop, look + int(found[0]))
                    break
                look += 4096
        yield at, stop
        at = stop


def words_of(classes: np.ndarray, buf: np.ndarray, cuts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words in the bytes, each distinct one once and where it comes, and where the words begin; texts end at ``cuts``."""
    chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero((buf & 0xC0) != 0x80)
    kinds = classes[chars]
    breaks = np.searchsorted(begins, cuts)
    starts = word_starts(np.insert(kinds, breaks, END))
    starts = begins[np.delete(starts, breaks + np.arange(len(breaks)))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)])
    return words.dictionary_encode(), starts


def cut_words(classes: np.ndarray, buf: np.ndarray, bounds: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """Segment by segment the words of all texts, and which text each belongs to."""
    for at, stop in segments(buf, bounds, size):
        words, starts = words_of(classes, buf[at:stop], np.unique(bounds[(bounds > at) & (bounds < stop)] - at))
        yield words, np.searchsorted(bounds, starts + at, side="right") - 1
