"""The pipeline, stage by stage, against plain Python on what the stage before has kept."""

import math
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tagweave.llm import decontaminate, toxicity
from tagweave.llm.common import span_hashes
from tagweave.llm.queries import vocabulary_path

from .conftest import prose
from .test_dedup import between, brute_lines, brute_near, sha


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(44)
    texts = [prose(rng, rng.randrange(30, 150)) for _ in range(240)]
    items = [(n, prose(rng, 25).replace("\n", " ")) for n in range(6)]
    rows, labels = [], []
    for i, text in enumerate(texts):
        toxic = int(rng.random() < 0.25)
        if toxic:
            text += f"\nSuch {rng.choice(['scumlike', 'vileish', 'foulest'])} people {i}."
        rows.append([i, text])
        labels.append((i, int(rng.random() < 0.8), toxic))
    rows += [[300 + k, texts[k]] for k in range(10)]
    rows += [[320 + k, texts[k].replace(texts[k].split()[9], "Another")] for k in range(10, 20)]
    rows += [[340 + k, prose(rng, 40) + " " + text + " " + prose(rng, 40)] for k, text in items]
    rows += [[360 + k, prose(rng, 30) + "\nThe same long footer of many documents\n" + prose(rng, 30)] for k in range(12)]
    lines = [prose(rng, 120).replace("\n", " ") for _ in range(5)]  # alike, but no line is the same
    rows += [[400 + k, text] for k, text in enumerate(lines)] + [[410 + k, text.replace(text.split()[60], "Other", 1)] for k, text in enumerate(lines)]
    rows += [[380, None], [381, ""], [382, "short"]]
    path = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_does_its_part(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names, given = [name for name, _ in corpus_pipeline.STAGES], docs.columns

    def written(df, name):
        df.write.parquet(f"{folder}/out-{name}")
        return spark.read.parquet(f"{folder}/out-{name}")

    before, kept = docs, {}
    for name, apply in corpus_pipeline.STAGES:
        after = written(apply(spark, before, folder), name)
        if name != names[-1]:
            assert after.columns == given
        kept[name] = (before, after)
        before = after

    old, new = kept["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(old, labels).collect() if r.predicted}
    assert rows_of(new) == [r for r in rows_of(old) if r[0] not in bad] and 40 <= len(bad) <= 80

    old, new = kept["line_dedup"]
    assert sorted((i, sha(t or "")) for i, t in rows_of(new)) == sorted((i, digest) for i, _, _, digest in brute_lines(rows_of(old)))
    assert all(r.n_chars == len(r.text) for r in new.collect() if r.text is not None)

    old, new = kept["near_dedup"]
    stay = {i for i, _, _, good in brute_near(rows_of(old)) if good}
    assert rows_of(new) == [r for r in rows_of(old) if r[0] in stay] and new.count() < old.count()

    old, new = kept["decontamination"]
    held = {r.doc_id for r in decontaminate.contamination(old, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() if r.contaminated}
    assert rows_of(new) == [r for r in rows_of(old) if r[0] not in held] and held >= {340 + k for k in range(6)} - bad and len(held) <= 6

    old, new = kept["bpe"]
    library = Tokenizer.from_file(vocabulary_path())
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows_of(old))
    assert sorted((r.doc_id, r.token_ids) for r in new.collect()) == want
    assert all(r.n_tokens == len(r.token_ids) for r in new.collect())

    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.token_ids) for r in whole.collect()) == want


def test_near_copies_between_0_80_and_0_85_go(spark, folder):
    rng = random.Random(45)
    rows = [(2 * k + n, text) for k in range(30) for n, text in enumerate(between(rng, k))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stay = {i for i, _, _, good in brute_near(rows, 80) if good}
    assert stay == {2 * k for k in range(30)}
    assert rows_of(corpus_pipeline.without_near_duplicates(spark, docs, folder)) == [r for r in rows if r[0] in stay]


def all_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])


def plain_sentences(text):
    """The features of each sentence that has words: words and their prefixes of 4 and 5 bytes, lower case."""
    out = []
    for part in re.split(rb"[.!?\n]", (text or "").encode()):
        words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", part)]
        out.append({(w[:n], len(w) > n and n) for w in words for n in (10**9, 4, 5)})
    return [s for s in out if s]


def test_toxicity_is_learned_in_a_task(spark, folder, monkeypatch):
    """The texts that train never reach the driver."""
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))

    def fit(*_):
        raise AssertionError("learned by the driver")

    monkeypatch.setattr(toxicity, "fit", fit)
    model = toxicity.train(docs, labels)
    assert len(model.words) == len(model.weights) > 0 and model.words.dtype == np.uint64
    nothing = toxicity.train(docs, labels.limit(0))
    assert len(nothing.words) == len(nothing.weights) == 0


def test_toxicity_stage_equals_plain_scoring(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))

    def weight(feature):
        word, cut = feature
        data = np.frombuffer(word, np.uint8)
        key = int(span_hashes(data, np.array([0]), np.array([len(data)]), 61)[0])
        return weights.get((key + {False: 0, 4: 1, 5: 2}[cut]) % 2**64, 0.0)

    known = {}
    stay = []
    for i, text in all_rows(docs):
        clean = 1.0
        for sentence in plain_sentences(text):
            logit = toxicity.PRIOR + sum(known.setdefault(f, weight(f)) for f in sentence)
            clean *= 1 / (1 + math.exp(logit))
        if 1 - clean < toxicity.THRESHOLD:
            stay.append((i, text))
    assert len(weights) > 2 and 0 < len(stay) < docs.count()
    assert all_rows(corpus_pipeline.without_toxic(spark, docs, folder)) == stay


def plain_distance(item, text):
    """The least edit distance between the item and any stretch of the text, in words."""
    row = [0] * (len(text) + 1)
    for n, word in enumerate(item, 1):
        new = [n]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (word != other), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_stage_equals_every_edit_distance(spark, folder):
    rng = random.Random(46)
    items = [r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(k, " ".join(prose(rng, rng.randrange(10, 80)).split())) for k in range(20)]
    for k in range(60):
        words = list(items[k % 6])
        for _ in range(k % 9):  # five edits are allowed
            at = rng.randrange(len(words))
            words[at : at + (k % 2 or rng.randrange(2))] = ["other%d" % k] if k % 4 < 3 else []
        rows.append((100 + k, " ".join([*prose(rng, k % 3 * 10).split(), *words, *prose(rng, k % 4 * 9).split()])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lower = [[w.lower() for w in item] for item in items]
    stay = [(i, t) for i, t in rows if all(plain_distance(w, t.lower().split()) > len(w) // 5 for w in lower)]
    assert 25 <= len(stay) <= 70
    assert rows_of(corpus_pipeline.without_benchmark(spark, docs, folder)) == stay


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, keep string, token_ids string, component_id long"


@pytest.mark.parametrize("rows", [
    [],
    [(None, "a line of a document without an id\nand more of it"), (None, "a line of a document without an id\nand more of it"), (5, None), (5, ""),
     (6, "twice the same row " * 20), (6, "twice the same row " * 20), (7, "one id, " * 30), (7, "two texts " * 30)],
], ids=["empty", "odd"])
def test_odd_tables_and_clashing_names(spark, tmp_path, rows):
    """No rows; null ids, null and empty texts, repeated rows and ids; columns that stages use themselves. Rows without an id
    are never copies of others; equal rows and rows of one id stay or go together."""
    full = [(i, t, None, "s", None, 1, "r", "k", "x", 2) for i, t in rows]
    spark.createDataFrame(full, EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    assert all(r.n_tokens == len(r.token_ids) for r in out)
