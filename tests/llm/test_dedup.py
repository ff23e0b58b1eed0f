"""Suffix, line and near-duplicate removal against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagweave.llm import line_dedup, near_dup, suffix_dedup
from tagweave.llm.bwt import repeated_suffixes
from tagweave.llm.components import connected_components


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def brute_repeats(texts, width=suffix_dedup.WINDOW):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[s : s + width] for d in data for s in range(len(d) - width + 1))
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - width + 1):
            if seen[d[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, sha(bytes(np.frombuffer(d, np.uint8)[~gone]))))
    return Counter(out)


@pytest.mark.parametrize("hot_classes", [suffix_dedup.HOT_CLASSES, 1])
def test_removed_bytes_equal_brute_force(docs, texts, hot_classes):
    found = suffix_dedup.remove_repeats(docs, hot_classes=hot_classes).drop("kept", "spans").collect()
    assert Counter(map(tuple, found)) == brute_repeats(texts)


def test_no_anchor_of_the_last_round_has_many_classes(spark, monkeypatch):
    """A passage of more than 192 bytes, with different bytes around it in every text."""
    rng = random.Random(33)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, most, sort = noise(208), [], suffix_dedup.sort_segments
    rows = [(k, noise(30) + passage + noise(30)) for k in range(60)]

    def watched(segments, level=0, hot_classes=suffix_dedup.HOT_CLASSES):
        most.append(max((r["count"] for r in segments.groupBy("anchor").count().collect()), default=0))
        return sort(segments, level, hot_classes)

    monkeypatch.setattr(suffix_dedup, "sort_segments", watched)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = suffix_dedup.remove_repeats(frame, hot_classes=8).drop("kept", "spans").collect()
    assert Counter(map(tuple, found)) == brute_repeats(rows)
    assert most[0] > 8 and most[-1] <= 8


def test_removal_of_nothing(no_docs):
    assert suffix_dedup.repeat_digests(no_docs).collect() == []


def test_very_long_text_is_cut_into_overlapping_pieces(spark):
    rng = random.Random(2)
    noise = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    passage = noise[1_048_400:1_048_900]  # across the border of two pieces
    frame = spark.createDataFrame([(1, noise), (2, "x" + passage + "y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeat_digests(frame).collect()}
    assert got == {1: (500, 1), 2: (500, 1)}


def test_column_wise_construction_finds_what_sorting_finds():
    rng = random.Random(1)
    for least in (1, 2, 4):
        strands = [[rng.randrange(3) for _ in range(rng.randrange(0, 12))] for _ in range(30)]
        bounds = np.cumsum([0, *map(len, strands)])
        copies = np.array([rng.choice([1, 1, 1, 2]) for _ in strands])
        owners, lengths = repeated_suffixes(np.array([x for s in strands for x in s]), bounds, least, copies)
        heads = Counter(tuple(s[k : k + least]) for s, c in zip(strands, copies, strict=True) for k in range(len(s) - least + 1) for _ in range(c))
        want = {(i, len(s) - k) for i, s in enumerate(strands) for k in range(len(s) - least + 1) if heads[tuple(s[k : k + least])] > 1}
        assert set(zip(owners.tolist(), lengths.tolist(), strict=True)) == want


def brute_lines(texts):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    first = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def test_kept_lines_equal_brute_force(docs, texts):
    assert Counter(map(tuple, line_dedup.line_digests(docs).collect())) == brute_lines(texts)


def test_a_line_that_fills_many_tasks(spark):
    rows = [(i, "The very same line\nown line number %d\n  the VERY same line" % i) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, line_dedup.line_digests(frame).collect())) == brute_lines(rows)


def test_lines_leave_other_columns_alone(docs, texts, no_docs):
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert {(r.h, r.row, r.label, r.keep, r["a b.c"]) for r in out.collect()} == {(1, "r", None, "k", 2)}
    assert line_dedup.line_digests(no_docs).collect() == [] and line_dedup.drop_repeated_lines(no_docs).collect() == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_near(texts, percent=85):
    sets = [(i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return Counter((i, len(s), find(i), i is None or find(i) == i) for i, s in sets)


def test_components_equal_brute_force(docs, texts):
    assert Counter(map(tuple, near_dup.near_duplicate_digests(docs).collect())) == brute_near(texts)


def test_chain_of_copies_is_one_component(spark):
    """Neighbours are alike, the ends are not."""
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for k in range(40):
        words = list(words)
        words[(k * 37) % 120] = "new%d" % k
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[3][1]) for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_dup.near_duplicate_digests(frame).collect())) == brute_near(rows)


def test_group_of_copies_that_are_alike_through_others_only(spark):
    """Copies of one text, changed little or much: some are linked with few others, some with none."""
    rng = random.Random(18)
    original = ["w%d" % rng.randrange(10**6) for _ in range(150)]
    rows = []
    for k in range(150):
        words = list(original)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
        del words[: rng.randrange(3)]
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert 1 < sum(n for (_, _, _, kept), n in want.items() if kept) < 150
    assert Counter(map(tuple, near_dup.near_duplicate_digests(frame).collect())) == want


def test_one_of_each_group_stays(docs, texts, no_docs):
    out = near_dup.drop_near_duplicates(docs)
    want = Counter(i for (i, _, _, kept), n in brute_near(texts).items() for _ in range(n) if kept)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == want
    assert near_dup.near_duplicate_digests(no_docs).collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    """Ids with two texts, that are linked with different others or the least of two classes, and with an empty text."""
    rng = random.Random(51)
    text = [" ".join("w%d" % rng.randrange(10**6) for _ in range(90)) for _ in range(40)]
    near = lambda t, k: t.replace(t.split()[30], "new%d" % k)
    rows = []
    for k in range(0, 20, 2):
        base = 100 * k
        rows += [(base + 1, text[k]), (base + 1, text[k + 1]), (base + 5, near(text[k], k)), (base + 6, near(text[k + 1], k))]
    rows += [(5000, text[20]), (5001, text[20]), (5001, text[21]), (5002, text[21]), (5002, ""), (5002, None), (5003, ""), (5003, text[22]), (5004, None)]
    rows += [(6009, text[23]), (6009, text[24]), (6001, near(text[23], 1)), (6002, near(text[24], 2)), (6009, "")]
    rows += [(None, text[0]), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_near(rows)
    assert (6009, 0, 6001, False) in want and (5002, 0, 5000, False) in want
    assert Counter(map(tuple, near_dup.near_duplicate_digests(frame).collect())) == want


def between(rng, k):
    """A text and a near copy whose similarity lies between 0.80 and 0.85: 100 to 108 shingles, two separate words changed."""
    words = ["w%d" % rng.randrange(10**6) for _ in range(104 + k % 9)]
    other = list(words)
    other[30], other[60] = "one%d" % k, "two%d" % k
    return " ".join(words), " ".join(other)


def test_operator_links_from_0_80_on_and_the_query_from_0_85(spark):
    rng = random.Random(28)
    rows = [(2 * k + n, text) for k in range(60) for n, text in enumerate(between(rng, k))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    stay = {i for i, _, _, kept in brute_near(rows, 80) if kept}
    assert stay == {2 * k for k in range(60)}
    assert {r.doc_id for r in near_dup.drop_near_duplicates(frame, percent=80).collect()} == stay
    assert Counter(map(tuple, near_dup.near_duplicate_digests(frame).collect())) == brute_near(rows, 85)
    for percent in (80, 85, 90):
        bands, size = near_dup.bands_and_rows(percent)
        assert (1 - (percent / 100) ** size) ** bands <= near_dup.MISSED


def test_star_steps_connect(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5), (None, 3)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in near:
        reach, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - reach:
                reach.add(x)
                todo.append(x)
        if min(reach) != node:
            want[node] = min(reach)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
