"""Byte-level BPE encoding and decoding with a transducer lexicon of the frequent words.

Frequent words are counted over all documents, encoded once, and compiled into a minimal acyclic transducer
(``lexicon``) that every task memory-maps. A word that the transducer does not accept goes through the exact merges.
The vocabulary file (the public JSON form of byte-level BPE) is read on the driver and sent along.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import blocks, discard, flat, release_memory, small_batches, stage
from tagweave.llm.lexicon import Lexicon, compile_lexicon
from tagweave.llm.words import character_classes, cut_words

#: Fixed value: the public pattern that cuts a text into words before byte-level merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words in the lexicon, by falling frequency: bounds its size.
LEXICON_WORDS = 32_768

#: Words that a task remembers; longer words are never remembered or counted.
MEMO, MEMO_BYTES = 1 << 18, 48

#: Bytes of text that are encoded at once, and counted at once.
BLOCK, COUNTED = 1 << 20, 2 << 20

#: Above every rank.
NO_RANK = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Bpe:
    """Exact merges, and what the vocabulary file says about ids and special tokens."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or odd or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}

    @cached_property
    def cut(self):
        longest_first = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None

    @cached_property
    def words(self):
        return regex.compile(WORDS).findall

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: of all neighbours, the pair of lowest rank, leftmost first, is joined until none is left."""
        if (whole := self.ids.get(word)) is not None and len(word) == 1:
            return [whole]
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks = self.ranks
        queue = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j >= len(parts) or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two has been joined with another since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return [self.ids[p] for p in parts if p is not None]

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For merging many words at once: ids of single bytes, ranks of pairs of bytes, and pairs of ids with their ranks
        and what they become."""
        single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = np.array([self.ids[a] << 32 | self.ids[b] for a, b in self.ranks], np.int64)
        joined = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)
        of_bytes = np.full(1 << 16, NO_RANK, np.int64)
        for rank, (a, b) in enumerate(self.ranks):
            if len(a) == len(b) == 1:
                of_bytes[a[0] << 8 | b[0]] = rank
        order = np.argsort(pairs)
        return single, of_bytes, pairs[order], order, joined

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words together: each round joins one pair in every word that still has one. The ids of all
        words in a row, and how many each has."""
        single, of_bytes, pairs, rank_of, joined = self.tables
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        buf = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbol, word = single[buf], np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(buf), NO_RANK, np.int64)
        rank[:-1] = np.where(word[:-1] == word[1:], of_bytes[buf[:-1] << 8 | buf[1:]], NO_RANK)
        done_ids, done_words = [], []
        while len(symbol):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), heads)
            open_word = best >> 32 < NO_RANK
            keep = np.repeat(open_word, np.diff(np.append(heads, len(symbol))))
            done_ids.append(symbol[~keep])
            done_words.append(word[~keep])
            place = (best & 0xFFFFFFFF)[open_word]
            symbol[place] = joined[best[open_word] >> 32]
            keep[place + 1] = False
            rank[place] = rank[place + 1]  # whether a neighbour follows in the word; its rank is looked up below
            moved = np.cumsum(keep) - 1
            place = moved[place]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            changed = np.concatenate([place, place[place > 0] - 1])
            changed = changed[changed + 1 < len(symbol)]
            inside = word[changed] == word[changed + 1]
            rank[changed] = NO_RANK
            if len(word):
                rank[-1] = NO_RANK
            changed = changed[inside]
            wanted = symbol[changed] << 32 | symbol[changed + 1]
            found = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            rank[changed] = np.where(pairs[found] == wanted, rank_of[found], NO_RANK)
        ids, owner = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (done_ids, done_words))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row, and where each id's begin and how many they are."""
        lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            lengths[i] = len(token)
        flat = b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths)))
        return np.frombuffer(flat, np.uint8), np.cumsum(lengths) - lengths, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        pool, begins, lengths = self.spelled
        return spread(pool, begins[ids], lengths[ids]).tobytes()

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """What the ids of several texts stand for; bytes that are no text become replacement characters."""
        whole = self.decode(ids)
        at = np.concatenate([[0], np.cumsum(self.spelled[2][ids])])[ends].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    @cached_property
    def decimals(self) -> list[str]:
        """The decimal form of every id."""
        return list(map(str, range(len(self.spelled[2]))))


def spread(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``pool[begin : begin + size]`` one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes blocks of whole texts: words are cut for all texts at once, and each distinct word of a segment is looked up
    once. Words are remembered until there are ``MEMO`` of them; then the memory starts anew."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon, classes: np.ndarray):
        self.bpe, self.lexicon, self.classes = bpe, lexicon, classes
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool, self.begins, self.sizes = (np.zeros(0, kind) for kind in (np.int32, np.int64, np.int64))

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, remembered, from the transducer, or by merging: a pool of ids, and where in it each word's
        begin and how many they are."""
        if len(self.slots) > MEMO:
            self._forget()
        get = self.slots.get
        slot = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        raw = [words[n] for n in new.tolist()]
        ranks = self.lexicon.ranks(raw)
        order = np.concatenate([np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)])
        ranks = ranks[ranks >= 0]
        begins, known = self.lexicon.bounds[ranks].astype(np.int64), np.diff(self.lexicon.bounds)[ranks].astype(np.int64)
        merged, others = self.bpe.merge_all([raw[n] for n in order[len(ranks) :].tolist()])
        sizes = np.concatenate([known, others])
        first, at = len(self.begins), len(self.pool)
        self.pool = np.concatenate([self.pool, spread(self.lexicon.ids, begins, known), merged.astype(np.int32)])
        self.begins = np.concatenate([self.begins, at + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        slot[new[order]] = np.arange(first, first + len(new))
        self.slots.update((words[n], k) for n, k in zip(new.tolist(), slot[new].tolist(), strict=True) if len(words[n]) <= MEMO_BYTES)
        return self.pool, self.begins[slot], self.sizes[slot]

    def _with_special(self, text: str) -> np.ndarray:
        """A text with special tokens in it."""
        parts = []
        for n, part in enumerate(self.bpe.cut.split(text)):
            if n % 2:
                parts.append(np.array([self.bpe.special[part]], np.int32))
            elif part:
                words = [w.encode() for w in self.bpe.words(part)]
                parts.append(spread(*self._look_up(words)))
        return np.concatenate(parts)

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, and the end."""
        buf, bounds = flat(column)
        n, found = np.zeros(len(bounds) - 1, np.int64), [np.zeros(0, np.int32)]
        for words, text in cut_words(self.classes, buf, bounds, BLOCK):
            pool, begins, sizes = self._look_up(words.dictionary.to_pylist())
            at = words.indices.to_numpy()
            found.append(spread(pool, begins[at], sizes[at]))
            n += np.bincount(text, sizes[at], len(n)).astype(np.int64)
        ids, ends = np.concatenate(found), np.concatenate([[0], np.cumsum(n)])
        special = {k for s in self.bpe.special for k in self._texts_with(buf, bounds, s.encode())}
        if not special:
            return ids, ends
        parts = [self._with_special(buf[bounds[k] : bounds[k + 1]].tobytes().decode()) if k in special else ids[ends[k] : ends[k + 1]] for k in range(len(n))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    @staticmethod
    def _texts_with(buf: np.ndarray, bounds: np.ndarray, special: bytes) -> Iterator[int]:
        whole = buf.tobytes()
        at = whole.find(special)
        while at >= 0:
            k = int(np.searchsorted(bounds, at, side="right")) - 1
            inside = at + len(special) <= bounds[k + 1]
            if inside:
                yield k
            at = whole.find(special, int(bounds[k + 1]) if inside else at + 1)


def _word_counter(shared):
    """shared: a broadcast of the character classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(shared.value, np.uint8)
        for block in blocks(batches, "text", COUNTED):
            for words, _ in cut_words(classes, *flat(block.column("text")), COUNTED):
                counts = pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64))
                short = pc.less_equal(pc.binary_length(words.dictionary), MEMO_BYTES)
                yield pa.RecordBatch.from_arrays([words.dictionary.filter(short).cast(pa.binary()), counts.filter(short)], ["word", "n"])
        release_memory()

    return run


def frequent_words(docs: DataFrame, text: str = "text", size: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all documents, ``size`` at most; words over 48 bytes are left to merging.

    Counts are compared by eighths of a power of two, so a histogram of a few hundred rows tells the driver from which
    frequency on it may gather words.
    """
    classes = docs.sparkSession.sparkContext.broadcast(character_classes().tobytes())
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_word_counter(classes), "word binary, n long")
    counts = found.groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    counted = stage(counts, "words")
    room, least = size, None
    for row in sorted(counted.groupBy("level").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.level
    words = [] if least is None else [bytes(row.word) for row in counted.where(F.col("level") >= least).select("word").collect()]
    discard(counted)
    classes.destroy()
    return words


def build_lexicon(docs: DataFrame, bpe: Bpe, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    return compile_lexicon({word: bpe.merge(word) for word in frequent_words(docs, text, size)})


def _encoded(shared):
    """shared: a broadcast of the vocabulary, the compiled transducer and the character classes. An encoder lives as long as
    its task's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Bpe]]:
        encoder = None
        for block in blocks(batches, "text", BLOCK):
            if encoder is None:
                bpe, lexicon, classes = pickle.loads(shared.value)
                encoder = Encoder(bpe, Lexicon.mapped(lexicon), np.frombuffer(classes, np.uint8))
            yield block, *encoder.encode_all(block.column("text")), encoder.bpe
        del encoder
        release_memory()

    return run


def _digests(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
        for block, ids, ends, bpe in _encoded(shared)(batches):
            spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            named = list(map(bpe.decimals.__getitem__, ids.tolist()))
            columns = [block.column("doc_id"), pa.array(np.diff(ends)), sha(",".join(named[a:b]) for a, b in spans), sha(bpe.texts(ids, ends))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _arrays(shared, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, ends, bpe in _encoded(shared)(batches):
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            columns = {"doc_id": block.column("doc_id"), "token_ids": lists}
            if decoded:
                columns["decoded"] = pa.array(bpe.texts(ids, ends), pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _shared(docs: DataFrame, path: str, text: str, size: int):
    """A broadcast of the vocabulary, the lexicon (``size`` words) and the character classes: its size does not hang on the data."""
    with open(path, "rb") as file:
        bpe = Bpe(file.read())
    small_batches(docs.sparkSession)
    lexicon = build_lexicon(docs, bpe, text, size)
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps((bpe, lexicon, character_classes().tobytes()), pickle.HIGHEST_PROTOCOL))


def encode_documents(docs: DataFrame, path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS, decoded: bool = True) -> DataFrame:
    """``doc_id``, ``token_ids`` and, if asked for, ``decoded`` (the text that the ids give) of every row.

    Null and empty texts have no ids and decode to the empty text; a null ``doc_id`` stays null; equal rows give equal
    results; other columns are ignored. Special tokens' strings in a text become their ids, as the public library does.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    run = _arrays(_shared(chosen, path, "text", lexicon_words), decoded)
    return chosen.mapInArrow(run, "doc_id long, token_ids array<int>" + ", decoded string" * decoded)


def encode_digests(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """The contract's columns: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = _digests(_shared(chosen, path, "text", lexicon_words))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
