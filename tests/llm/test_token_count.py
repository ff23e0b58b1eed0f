"""Token counts against the public library, and the compiled machine against plain merging."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tagweave.llm import token_count
from tagweave.llm.bpe import Bpe
from tagweave.llm.queries import vocabulary_path
from tagweave.llm.token_machine import Machine
from tagweave.llm.words import FOLLOWING, INIT, N_CLASSES, N_STATES, OTHER, character_classes, composed, word_starts

PARTS = ["'", "s", "t", "r", "e", "v", "l", "m", "d", "a", " ", "  ", "\n", "\t", "1", "23", "!", "é", "日", " ", " ", "x'", "re", "ll",
         "<|endoftext|>", "<|endof", "text|>", "ing", "the", "́", "😀", "²", "ß", "\x1c"]


@pytest.fixture(scope="module")
def machine():
    with open(vocabulary_path(), "rb") as file:
        return Machine(file.read())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def classes():
    return character_classes()


def test_random_texts_in_blocks_of_any_size(machine, classes, library, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)] + [" ".join(rng.choice(PARTS) for _ in range(4000))]
    want = library(texts)
    for segment in (1 << 20, 700, 40):
        monkeypatch.setattr(token_count, "SEGMENT", segment)
        assert token_count.count_block(machine, classes, pa.array(texts)).tolist() == want


def test_every_kind_of_character(machine, classes, library):
    texts = [f"x{c}1{c}'{c} " for c in map(chr, [*range(0x3100), *range(0xFE00, 0x10400), *range(0x1D400, 0x1D800, 7)])]
    assert token_count.count_block(machine, classes, pa.array(texts)).tolist() == library(texts)


def test_words_that_merge_again_and_again(machine, library):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdluñ") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    words += [unit * n for unit in ("a", "ab", "-", "é", "ing") for n in range(1, 120)]
    assert [machine.count(w.encode()) for w in words] == library(words)
    with open(vocabulary_path(), "rb") as file:
        bpe = Bpe(file.read())
    raw = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 20))) for _ in range(2000)]
    assert [machine.count(w) for w in raw] == [len(bpe.merge(w)) for w in raw]


def test_what_was_compiled_on_the_way_can_be_dropped(machine, monkeypatch):
    from tagweave.llm import token_machine

    rng = random.Random(2)
    words = ["".join(rng.choice("qxzkvwjy") for _ in range(12)).encode() for _ in range(300)]
    want = machine.counts(words).tolist()
    monkeypatch.setattr(token_machine, "MORE", 50)
    monkeypatch.setattr(token_machine, "WORDS", 50)
    again = [machine.counts(words[n : n + 10]).tolist() for n in range(0, 300, 10)]
    assert [n for part in again for n in part] == want
    assert len(machine.steps) == machine.base[1] and len(machine.states) == machine.base[0] == len(machine.numbers)


def test_chunk_maps_compose_to_the_states_of_one_pass():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, OTHER + 1, 64 * 33).astype(np.uint8)
    maps, states, state = [], [], INIT
    for chunk in classes.reshape(-1, 64):
        states.append(state)
        whole = list(range(N_STATES))
        for c in chunk:
            whole = [int(FOLLOWING[s * N_CLASSES + c]) for s in whole]
            state = int(FOLLOWING[state * N_CLASSES + c])
        maps.append(whole)
    assert composed(np.array(maps, np.uint8)).tolist() == states
    assert word_starts(classes)[: 64].tolist() == word_starts(classes[:65])[:64].tolist()


def test_all_rows_are_counted(spark, docs, texts, no_docs, library):
    told = token_count.token_counts(docs, vocabulary_path(), limit=100).collect()
    plain = [t or "" for _, t in texts]
    want = sorted((str(i), len(t.encode()), n, n > 100) for (i, _), t, n in zip(texts, plain, library(plain), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in told) == want
    assert token_count.token_counts(no_docs, vocabulary_path()).count() == 0
