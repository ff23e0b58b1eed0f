"""Token counts of whole texts by the compiled tokenizer of ``token_machine``: one map over the texts, nothing is shuffled."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import blocks, flat, small_batches
from tagweave.llm.token_machine import Machine
from tagweave.llm.words import SEGMENT, character_classes, cut_words

#: A document with more tokens is over the limit.
LIMIT = 1024


def _pieces(buf: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts without the special tokens in them: bytes, where each piece begins (and the end), its text, and how many
    special tokens each text has."""
    owner, tokens = np.arange(len(bounds) - 1), np.zeros(len(bounds) - 1, np.int64)
    whole = buf.tobytes()
    if not any(s in whole for s in special):
        return buf, bounds, owner, tokens
    cut = regex.compile(b"|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
    parts, owners = [], []
    for n in range(len(bounds) - 1):
        pieces = cut.split(whole[bounds[n] : bounds[n + 1]])
        tokens[n] = len(pieces) - 1
        parts += pieces
        owners += [n] * len(pieces)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), np.array(owners), tokens


def count_block(machine: Machine, classes: np.ndarray, column: pa.Array) -> np.ndarray:
    """The number of tokens of every text."""
    buf, bounds = flat(column)
    buf, bounds, owner, tokens = _pieces(buf, bounds, machine.special)
    for words, piece in cut_words(classes, buf, bounds, SEGMENT):
        n = machine.counts(words.dictionary.to_pylist())[words.indices.to_numpy()]
        tokens += np.bincount(owner[piece], n, len(tokens)).astype(np.int64)
    return tokens


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, classes = pickle.loads(shared.value)
        classes = np.frombuffer(classes, np.uint8)
        for block in blocks(batches, "text", SEGMENT):
            sizes = np.diff(flat(block.column("text"))[1])
            arrays = [block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(count_block(machine, classes, block.column("text")), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, as the public library counts with the file at ``path``.

    Null and empty texts have no bytes and no tokens. Strings of special tokens in a text count as one token each. Equal
    rows give equal results, a null ``doc_id`` stays null, other columns are ignored. Long texts are taken in segments of
    about four million bytes, a stretch without white space at once. The compiled file is broadcast: its size hangs on
    the vocabulary alone.
    """
    with open(path, "rb") as file:
        machine = Machine(file.read())
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((machine, character_classes().tobytes()), pickle.HIGHEST_PROTOCOL))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(_counter(shared), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
