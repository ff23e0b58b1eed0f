"""The audit and the vectors under it against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagweave.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, lang string, source string, text string, term string, index int, `a b.c` int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(rows, min_df, top):
    df, sums = defaultdict(Counter), defaultdict(Counter)
    for _, lang, source, text in rows:
        df[lang or ""].update(set(terms_of(text)))
        sums[lang or "", source or ""].update(terms_of(text))
    out = []
    for lang in df.keys() | {g[0] for g in sums}:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        groups = {s: c for (g, s), c in sums.items() if g == lang}

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            parts = {
                "pair": [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s],
                "term": [(t, gap(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return Counter(out)


def mixed():
    rng = random.Random(6)
    words = ["Alpha", "beta's", "ÉTÉ", "été", "x1y", "日本", "z_z", "mid-dle", "tail"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(400):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "", "só"])
        text = rng.choice([None, "", " 12 ", *[" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(9)]])
        rows.append((k, rng.choice(["en", "en", "de", None, ""]), source, text))
    rows += [(1, "one", "only", "alone alone")] * 12 + [(None, "no", "a", None), (None, "no", "b", "few"), (7, "en", "late", "12"), (8, "en", "s1", "alpha " * 90_000)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in mixed()], SCHEMA).repartition(6)


@pytest.mark.parametrize("min_df, top", [(10, 10), (1, 2), (10_000, 3)])
def test_audit_equals_plain_python(frame, min_df, top):
    assert Counter(map(tuple, divergence.divergence_audit(frame, min_df, top).collect())) == brute(mixed(), min_df, top)


@pytest.mark.parametrize("list_terms", [divergence.TERMS, 3])
def test_vectors_hold_every_count(frame, list_terms):
    vectors = divergence.document_vectors(frame, 10, list_terms)
    names = {(r.lang, r["index"]): r.term for r in vectors.vocabulary.collect()}
    per_lang = Counter(lang for lang, _ in names)
    assert all(sorted(i for g, i in names if g == lang) == list(range(n)) for lang, n in per_lang.items())
    got = Counter()
    for r in vectors.documents().collect():
        assert r.indices == sorted(set(r.indices))
        got[r.doc_id, r.lang, r.source, tuple((names[r.lang, i], n) for i, n in zip(r.indices, r["counts"], strict=True))] += 1
    known = {(lang, term) for (lang, _), term in names.items()}
    want = Counter()
    for doc, lang, source, text in mixed():
        counts = Counter(t for t in terms_of(text) if (lang or "", t) in known)
        want[doc, lang or "", source or "", tuple(sorted(counts.items(), key=lambda c: c[0].encode()))] += 1
    assert got == want


def test_an_empty_table_gives_no_rows(spark):
    assert divergence.divergence_audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_cells_do_not_matter(monkeypatch):
    """Small blocks in this process: the pair sums are the same."""
    import pyarrow as pa

    cells = pa.array([[{"source": s, "n": n, "total": 50} for s, n in row] for row in ([("a", 3), ("b", 4)], [("b", 1)], [("c", 2), ("a", 5)])])
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "en"]), cells], ["lang", "cells"])

    def told():
        out = Counter()
        for part in divergence._pairs_of_terms(iter([batch])):
            for row in part.to_pylist():
                out[row["a"], row["b"]] += row["value"]
        return out

    whole = told()
    monkeypatch.setattr(divergence, "CELLS", 1)
    assert told() == whole and whole["a", "b"] != 0


def test_shares_are_exact_beyond_64_bits():
    counts, total = [0, 5, 10**13, 7 * 10**14], 9 * 10**14
    assert divergence.shares(np.array(counts), np.int64(total)).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]
    assert divergence.shares(np.array([2]), np.int64(4)).tolist() == [10**9 + 1]
