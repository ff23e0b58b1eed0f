"""Cases that once gave wrong answers: strings made to collide, ids beyond 2**53, priors of paths, repeated labelled rows."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.llm import chat, decontaminate, line_dedup, near_dup, quality_rules, site_quality, suffix_dedup
from tagweave.llm.labelled import sample_labelled


def thue_morse(n, a="a", b="b"):
    """A word of n letters and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


PAIRS = [thue_morse(n) for n in (1024, 2048)]


@pytest.mark.parametrize("one, other", PAIRS)
def test_lines_words_and_segments_made_to_collide(spark, one, other):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    dropped = line_dedup.line_digests(make([(1, one), (2, other), (3, one)]))
    assert {r.doc_id: r.n_dropped for r in dropped.collect()} == {1: 0, 2: 0, 3: 1}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    counts = quality_rules.quality(make([(1, f"{one}\n{other}"), (2, f"{one}\n{one}"), (3, f"{one} a b {other} a b")]), labels).collect()
    assert {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in counts} == {1: (0, 0), 2: (1, 0), 3: (0, 0)}
    words = " ".join(f"w{k}" for k in range(4))
    near = near_dup.near_duplicate_digests(make([(1, f"{words} {one}"), (2, f"{words} {other}"), (3, f"{words} {one}")])).collect()
    assert {r.doc_id: r.component_id for r in near} == {1: 1, 2: 2, 3: 1}
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digests(make([(1, one), (2, "x" + other[:150]), (3, "y" + one)])).collect()}
    brute = {}
    texts = {1: one, 2: "x" + other[:150], 3: "y" + one}
    windows = [(d, i, t[i : i + 200]) for d, t in texts.items() for i in range(len(t) - 199)]
    seen = {}
    for _, _, w in windows:
        seen[w] = seen.get(w, 0) + 1
    for d, t in texts.items():
        gone = set()
        for e, i, w in windows:
            if e == d and seen[w] > 1:
                gone.update(range(i, i + 200))
        brute[d] = len(gone)
    assert removed == brute


def test_words_of_items_made_to_collide(spark):
    one, other = PAIRS[0]
    item = " ".join([one, "which", "word", "comes", one])  # of fewer than eight words: no edits
    docs = spark.createDataFrame([(1, f"so {item} end"), (2, f"so {item.replace(one, other)} end")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r.doc_id: r.n_items for r in decontaminate.contamination(docs, items).collect()} == {1: 1, 2: 0}


def test_large_ids_beside_null_ids(spark):
    rows = [(2**53, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (None, 0, "user", "c"), (2**62 + 1, None, "assistant", "d")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    found = {r.conv_id: r.n_turns for r in chat.chat_digests(frame).collect()}
    assert found == {2**53: 1, 2**53 + 1: 1, None: 1, 2**62 + 1: 1, -1: 2}
    assert {r.conv_id for r in chat.format_turns(frame).collect()} == {r[0] for r in rows}


def plain_strength(parts):
    """``parts``: of each group above, the documents' values of each part."""
    most = beyond = 0.0
    for group in parts:
        group = [p for p in group if len(p) > 1]
        n_all = sum(map(len, group))
        if not n_all:
            continue
        mean = sum(map(sum, group)) / n_all
        room = n_all - sum(len(p) ** 2 for p in group) / n_all
        spread = expected = 0.0
        for p in group:
            m = sum(p) / len(p)
            v = sum((x - m) ** 2 for x in p) / (len(p) - 1)
            spread += len(p) * (m - mean) ** 2
            expected += (1 - len(p) / n_all) * v
        most += room * mean * (1 - mean)
        beyond += spread - expected
    return min(max(most / beyond - 1, 1.0), 1e6) if beyond > 0 else 1e6



def test_strength_of_paths_is_measured_around_their_host(spark):

    rng = random.Random(8)
    cases = {
        "hosts differ, paths do not": [(f"h{h}", f"p{p}", rng.uniform(0, 0.4) + 0.6 * (h % 2)) for h in range(40) for p in range(5) for _ in range(20)],
        "paths differ": [(f"h{h}", f"p{p}", rng.uniform(0, 0.4) + 0.6 * (p % 2)) for h in range(20) for p in range(6) for _ in range(15)],
        "sparse": [(f"h{rng.randrange(9)}", f"p{rng.randrange(30)}", rng.random()) for _ in range(300)],
    }
    found = {}
    for name, rows in cases.items():
        frame = spark.createDataFrame(rows, "host string, path string, p double")
        paths = frame.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") ** 2).alias("squares"))
        groups = {}
        for host, path, p in rows:
            groups.setdefault(host, {}).setdefault(path, []).append(p)
        found[name] = site_quality._strength(paths, ["host"])
        assert math.isclose(found[name], plain_strength([list(g.values()) for g in groups.values()]), rel_tol=1e-6), name
    assert found["hosts differ, paths do not"] > 100 and found["paths differ"] < 10


def test_rates_equal_a_plain_posterior(spark):
    """Evidence, host and path rates and score of every document from the written formulas."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None]), " ".join(rng.choices(["good", "bad", "##", "1"], k=30))) for k in range(200)]
    rows += [(300, "alone", "x", "good words"), (None, "a", "x", None), (1, "a", "x", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, text string, host int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    out = site_quality.site_quality(docs, labels).collect()
    assert len(out) == len(rows)
    weights = site_quality._train(docs, labels, site_quality.SAMPLE)

    logit = site_quality.features(site_quality.measure(pa.array([r[3] or "" for r in rows]))) @ weights
    p = [min(max(1 / (1 + math.exp(-x)), 1e-4), 1 - 1e-4) for x in logit]
    hosts, paths = {}, {}
    for (_, host, path, _), x in zip(rows, p, strict=True):
        hosts.setdefault(host, []).append(x)
        paths.setdefault(host, {}).setdefault(path, []).append(x)
    mean = sum(p) / len(p)
    k_host, k_path = plain_strength([list(hosts.values())]), plain_strength([list(g.values()) for g in paths.values()])
    want = []
    for (doc, host, path, _), x in zip(rows, p, strict=True):
        h = (sum(hosts[host]) - x + k_host * mean) / (len(hosts[host]) - 1 + k_host)
        q = (sum(paths[host][path]) - x + k_path * h) / (len(paths[host][path]) - 1 + k_path)
        score = 1 / (1 + math.exp(-(math.log(x / (1 - x)) + math.log(q / (1 - q)) - math.log(mean / (1 - mean)))))
        want.append((str(doc), x, h, q, score))
    got = sorted((str(r.doc_id), r.evidence, r.host_rate, r.path_rate, r.score) for r in out)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[0] == w[0] and all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(g[1:], w[1:], strict=True)), (g, w)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(500)] + [(8, "other"), (9, "b" * 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(t for t, *_ in sample_labelled(docs, labels, "quality", 10))[:1] == ["b" * 1000]
    assert len(sample_labelled(docs, labels, "quality", 10)) == 3
    assert sum(len(t) for t, *_ in sample_labelled(docs, labels, "quality", 10, max_bytes=900)) <= 900


@pytest.mark.parametrize("kind", ["substituted", "inserted", "deleted", "mixed"])
@pytest.mark.parametrize("size", [10, 20, 59, 120, 250])
def test_sampling_alone_finds_edited_items_wherever_they_lie(size, kind):
    """No exact search stands behind it; a fifth of the words is edited, at the beginning, in the middle and at the end."""
    rng = random.Random(size * 7 + len(kind))
    known = [f"w{k}" for k in range(3000)]
    n = 60 if size < 200 else 20
    items = [[rng.choice(known) for _ in range(size)] for _ in range(n)]
    built = decontaminate.build_items(list(range(n)), [" ".join(i) for i in items])
    for before, after in ((0, 80), (80, 80), (80, 0)):
        texts = []
        for item in items:
            words = list(item)
            for _ in range(decontaminate.edits_allowed(size)):
                how = rng.choice(["substituted", "inserted", "deleted"]) if kind == "mixed" else kind
                at = rng.randrange(len(words))
                words[at : at + (how != "inserted")] = [] if how == "deleted" else [f"x{rng.randrange(10**6)}"]
            texts.append(" ".join([*rng.choices(known, k=before), *words, *rng.choices(known, k=after)]))
        found = decontaminate.leaks(built, *decontaminate._words(pa.array(texts)))
        assert len({(t, i) for t, i, *_ in found if t == i}) >= 0.95 * n, (size, kind, before)
        assert all(edits <= decontaminate.edits_allowed(size) for *_, edits in found)


def test_items_of_very_different_sizes_share_a_block(spark):
    """Short items beside a long one; the long one is found with a tenth of its words gone from a text's beginning."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(2000)}" for _ in range(600)]
    short = [[f"v{rng.randrange(300)}" for _ in range(12)] for _ in range(30)]
    items = spark.createDataFrame([(0, " ".join(long)), *[(k + 1, " ".join(s)) for k, s in enumerate(short)]], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(long[60:])), (2, " ".join(["a", *short[3], "b"])), (3, " ".join(long[200:]))], "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, items).collect()} == {1: [0], 2: [4], 3: []}
