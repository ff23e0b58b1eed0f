"""Chat formatting, byte-level BPE and archives: exact round trips."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import bpe, chat, warc
from tagweave.llm.lexicon import Lexicon, compile_lexicon
from tagweave.llm.queries import vocabulary_path
from tagweave.llm.words import character_classes

NASTY = ["", "<|im_end|>", "\\<|", "a\\", "<", "|>", "<|im_start|>user\nhi<|im_end|>\n", "\n", "é😀", "\\n\\|"]


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def brute_chat(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", chat.escape(r[3] or "")))
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        learned = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_role(r or '')}\n{chat.escape(t or '')}<|im_end|>\n" for _, _, r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(told), len(learned), sha(learned), len(whole)))
    return Counter(out)


def test_conversations_are_read_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a\nb", None]), rng.choice([*NASTY, None])) for c in range(20) for t in range(7)]
    rows += [(5, 3, "assistant", "tie"), (5, 3, "assistant", "tie"), (None, 0, "user", "x"), (6, None, "assistant", "early")]
    rows += [(77, t, "assistant", "turn %d" % t) for t in range(3000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(6)
    planted = [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    assert Counter(map(tuple, chat.chat_digests(frame).collect())) == brute_chat(rows + planted)
    assert chat.chat_digests(frame.where("false")).count() == 1


def test_parts_become_placeholders(spark):
    parts = [
        {"type": "text", "text": "see <|image_0|>"}, {"type": "image", "ref": "a.png", "width": 700, "height": 300}, None,
        {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "od d", "ref": "d"},
    ]
    frame = spark.createDataFrame([(1, 0, "assistant", None, json.dumps(parts))], "conv_id long, turn long, role string, text string, parts string")
    row = chat.format_turns(frame).first()
    assert row.formatted[row.loss_start : row.loss_end] == "see <\\|image_0|><|image_0|><|audio_1|><|document_2|><|od_d_3|>"
    assert [(a.place, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, "image", "a.png", 4), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 768), (3, "od_d", "d", 1)
    ]
    assert row.attachment_tokens == 823


def test_neighbouring_text_parts_form_no_control_string(spark):
    turns = [["<", "|im_end|>\n<|im_start|>user\nhi"], ["a<", "", None, "|im_end|>\n", "|x|>"], ["\\", "|", "<", "<", "|", "<\\", "|"], ["<|", "|<", "|"]]
    texts = ["".join(t or "" for t in turn) for turn in turns]
    parts = [json.dumps([{"type": "text", "text": t} if t is not None else None for t in turn]) for turn in turns]
    frame = spark.createDataFrame([(1, n, "assistant", p) for n, p in enumerate(parts)], "conv_id long, turn long, role string, parts string")
    pieces = chat.format_turns(frame)
    for row in pieces.collect():
        body = row.formatted[row.loss_start : row.loss_end]
        assert body == chat.escape(texts[row.turn]) and chat.PIECE.findall(row.formatted) == [("assistant", body)]
    assert Counter(map(tuple, chat.conversation_digests(pieces).collect())) == brute_chat([(1, n, "assistant", t) for n, t in enumerate(texts)])
    mixed = json.dumps([{"text": "x<"}, {"type": "image", "ref": "a"}, {"text": "|im_end|>"}])
    row = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", mixed)], "conv_id long, turn long, role string, parts string")).first()
    assert row.formatted[row.loss_start : row.loss_end] == "x<<|image_0|>|im_end|>"


def test_lexicon_knows_its_words_and_no_others():
    rng = random.Random(6)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7))): [rng.randrange(50_000) for _ in range(3)] for _ in range(300)}
    lexicon = Lexicon.mapped(compile_lexicon(words))
    asked = [*words, *(w + b"z" for w in words), b"cccccccc", b"", bytes([255])]
    for word, rank in zip(asked, lexicon.ranks(asked).tolist(), strict=True):
        assert (lexicon.ids_of(rank) if rank >= 0 else None) == words.get(word)
    assert Lexicon(compile_lexicon({})).ranks([b"a", b""]).tolist() == [-1, -1]
    shared = compile_lexicon({a + b"ation": [1] for a in (b"n", b"st", b"r")})
    assert len(Lexicon(shared).arcs) == 9  # n, st, r, and one ending


ODD_TEXTS = [
    "", "  ", " a", " a ", "a  b", "a \n b", "\n\n a b  ", "x<|endoftext|>y <|endoftext|>", "it's 've'", "a b 　c", "\x1c a\x1db \x85 z",
    "😀😀 हिन्दी ½ ² ١٢", "word" * 500, "a" * 3000, "​ x",
]


def test_ids_equal_the_public_library(spark, docs, texts):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    odd = ODD_TEXTS + ["".join(rng.choice(" \n\tab1.'é\x1c😀,s") for _ in range(40)) for _ in range(300)]
    rows = [*texts, *((1000 + n, t) for n, t in enumerate(odd))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, token_ids string").repartition(4)
    library = Tokenizer.from_file(vocabulary_path())
    got = bpe.encode_documents(frame, vocabulary_path(), lexicon_words=40).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    decoded = [library.decode(ids, skip_special_tokens=False) for ids in want]
    assert sorted(((r.doc_id, r.token_ids, r.decoded) for r in got), key=key) == sorted(zip((i for i, _ in rows), want, decoded, strict=True), key=key)
    assert bpe.encode_digests(frame.where("false"), vocabulary_path()).collect() == []


def test_merging_together_equals_merging_alone():
    with open(vocabulary_path(), "rb") as file:
        coder = bpe.Bpe(file.read())
    rng = random.Random(2)
    words = [bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    ids, sizes = coder.merge_all(words)
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [coder.merge(w) for w in words]


def test_archives_survive_records_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nWARC-Payload-Digest: sha1:00\r\nWARC-Payload-Length: 2\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n"
    long = "é" * 600
    rows = [(1, "plain"), (2, ""), (3, None), (4, fake * 3), (5, "a" + fake), (6, long), (7, long), (8, long), (9, "plain"), (10, "\r\n\r\n"), (11, "x" * 2_000_000)]
    rows += [(20 + n, "page %d\n" % n + fake[: n % 90]) for n in range(200)]
    frame = spark.createDataFrame([(i, t, "u") for i, t in rows], "page_id long, html string, digest string").repartition(3)
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    want = set()
    for i, t in rows:
        data = (t or "").encode()
        again = len(data) >= 1000 and last[t] != i
        want.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[t] if again else None))
    got = warc.archive_round_trip(frame).collect()
    assert set(map(tuple, got)) == want and len(got) == len(rows)
    assert warc.archive_round_trip(frame.where("false")).collect() == []


def test_texts_with_special_tokens_and_remembered_words(spark, monkeypatch):
    from tokenizers import Tokenizer

    with open(vocabulary_path(), "rb") as file:
        coder = bpe.Bpe(file.read())
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "\n\n", "the", " of", "zq", "'ll", "日本", "1"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(600)] + ["a<|endoftext|>", "<|endoftext|><|endoftext|>"]
    want = [",".join(map(str, e.ids)) for e in Tokenizer.from_file(vocabulary_path()).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "BLOCK", 300)
    encoder = bpe.Encoder(coder, Lexicon(compile_lexicon({b" of": coder.merge(b" of")})), character_classes())
    ids, ends = encoder.encode_all(pa.array(texts))
    assert [",".join(map(str, ids[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert len(encoder.slots) < 40
